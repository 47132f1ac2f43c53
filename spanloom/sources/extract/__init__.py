"""Extraction by file ending."""

from __future__ import annotations

from . import graphql, outline, python, script
from .base import FILE, Edge, Extraction, Symbol

__all__ = ["EXTRACTORS", "FILE", "Edge", "Extraction", "Symbol", "extract"]

#: Endings (lower case) and what reads them; register others here.
EXTRACTORS = {
    "py": lambda s, p: python.extract(s),
    **dict.fromkeys(("tsx",), lambda s, p: script.extract(s, True, True)),
    **dict.fromkeys(("jsx",), lambda s, p: script.extract(s, True, True)),
    "ts": lambda s, p: script.extract(s, True, False),
    **dict.fromkeys(("js", "mjs", "cjs"), lambda s, p: script.extract(s, False, False)),
    **dict.fromkeys(("md", "mdx"), outline.markdown),
    **dict.fromkeys(("css", "scss"), lambda s, p: outline.stylesheet(s)),
    "json": lambda s, p: outline.json_keys(s),
    **dict.fromkeys(("yaml", "yml"), lambda s, p: outline.yaml_keys(s)),
    **dict.fromkeys(("graphql", "gql"), lambda s, p: graphql.extract(s)),
}


def extract(path: str, source: str) -> Extraction:
    """Symbols and edges of a file; a file that no extractor reads has none, and a failing extractor gives status error."""
    name = path.rsplit("/", 1)[-1]
    of = EXTRACTORS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
    if of is None:
        return Extraction("file")
    try:
        return of(source, path)
    except Exception:  # one file must not fail an index
        return Extraction("error")
