"""Outlines: markdown headings and decisions, stylesheet selectors, keys of JSON and YAML."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from .base import Edge, Extraction, Places, Symbol

MAX_DECISION_LINES = 80
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*")
_ADR_NAME = re.compile(r"adr[-_ ]?[0-9]+")
_SUPERSEDES = re.compile(r"supersedes\s+ADR-?\s*([0-9]+)", re.I)
_LINK = re.compile(r"\[[^\]]+\]\(([^)]+)\)")


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[: name.rindex(".")] if name.rfind(".") > 0 else name


def is_decision_path(path: str) -> bool:
    """In a folder of decisions, or named adr and a number."""
    parts = path.replace("\\", "/").lower().split("/")
    return any(p in ("adr", "adrs", "decisions") for p in parts) or bool(_ADR_NAME.match(parts[-1]))


def markdown(source: str, path: str) -> Extraction:
    places, out = Places(source), Extraction("outline")
    lines = source.split("\n")
    heads: list[tuple[int, int, str]] = []  # level, line, name
    for n, line in enumerate(lines, 1):
        if (m := _HEADING.fullmatch(line)) and (name := m[2].strip()):
            heads.append((len(m[1]), n, name))
            start = places.starts[n - 1]
            out.symbols.append(Symbol(name, "heading", n, n, places.byte(start), places.byte(start + len(line))))
    if source and is_decision_path(path):
        name = next((x for level, _, x in heads if level == 1), stem(path))
        first, last = _decision_lines(heads, len(lines))
        if name:
            end = places.starts[last - 1] + len(lines[last - 1])
            out.symbols.append(Symbol(name, "decision", first, last, places.byte(places.starts[first - 1]), places.byte(end)))
            targets = [f"ADR-{m[1]}" for m in _SUPERSEDES.finditer(source)]
            targets += [stem(t) for m in _LINK.finditer(source) if (t := _link_target(m[1])) and is_decision_path(t)]
            out.edges += [Edge(name, t, "supersedes", "low") for t in targets if t]
    return out


def _decision_lines(heads: list[tuple[int, int, str]], n: int) -> tuple[int, int]:
    """The Decision section; else the first chapter, else the file, these two to a limit."""
    until = lambda line, level: next((at - 1 for lv, at, _ in heads if at > line and lv <= level), n)
    for level, line, name in heads:
        if name.strip().lower() == "decision":
            return line, until(line, level)
    for level, line, _ in heads:
        if level == 1:
            return line, min(until(line, 1), line + MAX_DECISION_LINES - 1)
    return 1, min(n, MAX_DECISION_LINES)


def _link_target(raw: str) -> str:
    raw = raw.strip()
    if raw.startswith("<") and raw.endswith(">"):
        raw = raw[1:-1].strip()
    if raw[:1] in "\"'" and raw:
        return raw[1:].split(raw[0])[0].strip()
    return raw.split()[0] if raw.split() else ""


def _urls(source: str) -> tuple[list[int], list[int]]:
    """Where each url() begins and ends, in order."""
    begins, ends, opening, at = [], [], re.compile(r"url\(", re.I), 0
    while (m := opening.search(source, at)) and (at := source.find(")", m.end()) + 1):
        begins.append(m.start())
        ends.append(at)
    return begins, ends


def stylesheet(source: str) -> Extraction:
    """Classes, then ids, then custom properties, sigils kept; nothing inside url()."""
    places, out = Places(source), Extraction("outline")
    begins, ends = _urls(source)
    for sigil in (r"\.", "#", "--"):
        for m in re.finditer(sigil + r"[A-Za-z_][\w-]*", source):
            k = bisect_right(begins, m.start())
            if not k or m.end() > ends[k - 1]:
                line = places.line(m.start())
                out.symbols.append(Symbol(m[0], "selector", line, line, places.byte(m.start()), places.byte(m.end())))
    return out


def _key(places: Places, name: str, start: int, end: int) -> Symbol:
    return places.symbol(name, "heading", start, end, "key")


_JSON = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<s>"(?:\\.|[^"\\])*")|(?P<p>[{}\[\]:,])|(?P<x>[^\s{}\[\]:,"/]+|/)""", re.S)


def json_keys(source: str) -> Extraction:
    """Keys of the root object and of the objects in it; comments are passed over, broken pairs left out."""
    tokens = [(m[0], m.start(), m.end()) for m in _JSON.finditer(source) if m.lastgroup]
    if not tokens or tokens[0][0] in ("{", "[") and _skip(tokens, 0) is None:
        return Extraction("error")
    places, out = Places(source), Extraction("outline")
    if tokens[0][0] == "{":
        _object(tokens, 0, "", 2, places, out)
    return out


def _skip(tokens: list, k: int) -> int | None:
    """The index after the value at ``k``, or None if it has no end."""
    if k >= len(tokens) or tokens[k][0] in ("}", "]", ":", ","):
        return None
    if tokens[k][0] not in ("{", "["):
        return k + 1
    depth = 0
    while k < len(tokens):
        depth += (tokens[k][0] in ("{", "[")) - (tokens[k][0] in ("}", "]"))
        k += 1
        if not depth:
            return k
    return None


def _object(tokens: list, k: int, above: str, levels: int, places: Places, out: Extraction) -> None:
    k += 1
    while k < len(tokens) and tokens[k][0] != "}":
        text, start, _ = tokens[k]
        if text.startswith('"') and k + 1 < len(tokens) and tokens[k + 1][0] == ":" and (end := _skip(tokens, k + 2)) is not None:
            if name := text[1:-1].strip():
                out.symbols.append(_key(places, above + name, start, tokens[end - 1][2]))
                if levels > 1 and tokens[k + 2][0] == "{":
                    _object(tokens, k + 2, f"{above}{name}.", levels - 1, places, out)
            k = end
        else:
            k += 1


def yaml_keys(source: str) -> Extraction:
    """Keys of every document's root mapping and of the mappings in it, without merges and aliases."""
    if not source.strip():
        return Extraction("error")
    places, out = Places(source), Extraction("outline")
    try:
        import yaml
    except ImportError:
        return _yaml_by_indent(source, places, out)
    try:
        for root in _roots(yaml, source):
            _mapping(root, "", 2, places, out, source)
    except yaml.YAMLError:
        out.symbols.clear()
        return _yaml_by_indent(source, places, out)
    return out


#: Of a YAML node: id, text of a scalar, begin, end, and pairs of a mapping whose keys are asked for.
_Node = tuple[str, str | None, int, int, list | None]


def _roots(yaml, source: str) -> Iterator[_Node]:
    """Every document's root.  Events are read one by one, and of what no key is taken from only the place is kept."""
    events, anchors = yaml.parse(source, Loader=yaml.SafeLoader), {}

    def node(event, levels: int) -> _Node:
        begin = event.start_mark.index
        if isinstance(event, yaml.AliasEvent):
            if event.anchor not in anchors:
                raise yaml.YAMLError(f"undefined alias {event.anchor}")
            return anchors[event.anchor]
        if event.anchor is not None:
            if event.anchor in anchors:
                raise yaml.YAMLError(f"duplicate anchor {event.anchor}")
            levels = 2  # wherever an alias may put it
        if isinstance(event, yaml.ScalarEvent):
            got = ("scalar", event.value, begin, event.end_mark.index, None)
            if event.anchor is not None:
                anchors[event.anchor] = got
            return got
        mapping, pairs = isinstance(event, yaml.MappingStartEvent), [] if levels > 0 else None
        anchor, key, got = event.anchor, None, ("mapping" if mapping else "sequence", None, begin, begin, pairs if mapping else None)
        if anchor is not None:
            anchors[anchor] = got
        for event in events:
            if isinstance(event, yaml.MappingEndEvent | yaml.SequenceEndEvent):
                break
            child = node(event, levels - 1 if mapping else 0)
            if mapping and pairs is not None:
                if key is not None:
                    pairs.append((key, child))
                key = child if key is None else None
        got = (*got[:3], event.end_mark.index, got[4])
        if anchor is not None:
            anchors[anchor] = got
        return got

    for event in events:
        if isinstance(event, yaml.DocumentStartEvent):
            yield node(next(events), 2)
            anchors.clear()


def _mapping(root: _Node, above: str, levels: int, places: Places, out: Extraction, source: str) -> None:
    for (kind, text, start, after, _), value in root[4] or []:
        if kind != "scalar" or text.strip() in ("", "<<") or source[start : start + 1] == "*":
            continue
        name = text.strip()
        alias = value[2] < start  # an alias shows its anchor's place
        end = after if alias else value[3]
        while end > after and source[end - 1 : end].isspace():
            end -= 1
        out.symbols.append(_key(places, above + name, start, end))
        if levels > 1 and not alias:
            _mapping(value, f"{above}{name}.", levels - 1, places, out, source)


def _yaml_by_indent(source: str, places: Places, out: Extraction) -> Extraction:
    """Block mappings of two levels by indentation, for files that are no proper YAML or where no YAML library is."""
    marks = [0, *(at for m in re.finditer(r"^(?:---|\.\.\.)(?=\s|$)", source, re.M) for at in (m.start(), m.end())), len(source)]
    for begin, stop in zip(marks[::2], marks[1::2], strict=True):  # no key goes over a document's mark
        _document_by_indent(source, begin, stop, places, out)
    return out


def _document_by_indent(source: str, begin: int, stop: int, places: Places, out: Extraction) -> None:
    found: list[tuple[int, str, int]] = []
    for m in re.compile(r"^([ ]*)(\"[^\"\n]+\"|'[^'\n]+'|[^\s#\-*{\[&!|>][^:\n#]*?)[ ]*:(?=\s|$)", re.M).finditer(source, begin, stop):
        if (name := m[2].strip("\"'")) != "<<":
            found.append((len(m[1]), name, m.start(2)))
    ends, above = [stop] * len(found), []  # a key goes to the next that is indented no more
    for k, (indent, _, start) in enumerate(found):
        while above and found[above[-1]][0] >= indent:
            ends[above.pop()] = start
        above.append(k)
    parent, child = "", None
    for (indent, name, start), end in zip(found, ends, strict=True):
        end = start + len(source[start:end].rstrip())
        if indent == 0:
            parent, child = name, None
            out.symbols.append(_key(places, name, start, end))
        elif parent and child in (None, indent):
            child = indent
            out.symbols.append(_key(places, f"{parent}.{name}", start, end))
