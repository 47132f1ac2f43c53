"""Python: definitions, imports and calls from the standard library's parser; line patterns where it refuses a file."""

from __future__ import annotations

import ast
import re
import warnings
from array import array
from collections.abc import Iterable, Iterator

from .base import FILE, Edge, Extraction, Places

_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", re.M)
#: Lines as the parser counts them: form feeds and other separators of Unicode end none.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import[ \t]+([\w, \t]+)|import[ \t]+([\w., \t]+))", re.M)


#: Characters of a long source that are parsed at once.
PIECE = 1 << 18

#: Statements, lines before them, and the class that they are further members of.
_Piece = tuple[list[ast.stmt], int, ast.ClassDef | None]


def extract(source: str) -> Extraction:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for pieces in (_pieces, lambda s: [(ast.parse(s).body, 0, None)]):
            try:
                return _read(source, pieces(source))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                pass
    return _by_lines(source)


def _cuts(source: str, begin: int, end: int, indent: str) -> list[int]:
    """``begin``, ``end``, and between them definitions indented by ``indent``, ``PIECE`` characters or more apart."""
    head, out = re.compile(rf"^{indent}(?:(?:def|class|async)\b|@)", re.M), [begin]
    while m := head.search(source, out[-1] + PIECE, end):
        out.append(m.start())
    return [*out, end]


def _pieces(source: str) -> Iterator[_Piece]:
    """A source piece by piece, so that its tree is never whole: cut between statements, and between the members of a long class.

    What ends inside a string, brackets or a statement does not parse alone.
    Where it is not sure that the pieces are what the whole is, it is a SyntaxError.
    """
    before, cuts = 0, _cuts(source, 0, len(source), "")
    for begin, end in zip(cuts, cuts[1:], strict=False):
        member = re.compile(r"^class\b.*\n(?:[ \t]*\n)*([ \t]+)(?:(?:def|async)\b|@)", re.M).search(source, begin, end) if end - begin > 2 * PIECE else None
        inner = _cuts(source, begin, end, member[1]) if member else [begin, end]
        owner = None
        for k, (a, z) in enumerate(zip(inner, inner[1:], strict=False)):
            text = source[a:z]
            body = ast.parse("class _:\n" + text if k else text).body
            if k:
                if len(body) > 1 and k + 2 < len(inner):
                    raise SyntaxError("members of more than one class")
                yield body[0].body, before - 1, owner
                if body[1:]:
                    yield body[1:], before - 1, None
            else:
                if len(inner) > 2:
                    owner = body[-1]
                    if not isinstance(owner, ast.ClassDef) or owner.decorator_list or owner.type_params or owner.body[0].col_offset != len(member[1]) or not _LINE.findall(text)[owner.body[0].lineno - 1].startswith(member[1]):
                        raise SyntaxError("no class that goes on")
                yield body, before, None
            before += sum(1 for _ in _LINE.finditer(text))


def _read(source: str, pieces: Iterable[_Piece]) -> Extraction:
    lines = [*_LINE.findall(source), ""]
    starts, at = array("q"), 0
    for x in lines:
        starts.append(at)
        at += len(x)
    places = Places(source)
    out = Extraction("graph", [places.module()])
    classes: dict[int, tuple[int, int]] = {}  # of the piece at hand, and of a class that goes on: place among symbols, begin

    def offset(line: int, byte: int) -> int:
        text = lines[line - 1]
        return starts[line - 1] + (byte if text.isascii() else len(text.encode()[:byte].decode("utf-8", "ignore")))

    for body, before, outer in pieces:
        if outer is None:
            classes.clear()
        else:
            k, start = classes[id(outer)]
            out.symbols[k] = places.symbol(outer.name, "class", start, offset(before + body[-1].end_lineno, body[-1].end_col_offset))
        # (node, name of the innermost definition, whether that is a class)
        todo = [(n, outer.name if outer else FILE, outer is not None) for n in reversed(body)]
        while todo:
            node, owner, in_class = todo.pop()
            inner, is_class = owner, in_class
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                start = offset(before + node.lineno, node.col_offset)
                if is_class and not node.col_offset:
                    classes[id(node)] = len(out.symbols), start
                out.symbols.append(places.symbol(node.name, kind, start, offset(before + node.end_lineno, node.end_col_offset)))
                inner = node.name
            elif isinstance(node, ast.Import):
                out.edges += [Edge(FILE, a.name, "import", "high") for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                names = ["." * node.level + (node.module or ""), *(a.name for a in node.names if a.name != "*")]
                out.edges += [Edge(FILE, n, "import", "high") for n in names if n]
            elif isinstance(node, ast.Call):
                callee = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
                if callee:
                    out.edges.append(Edge(owner, callee, "call", "low"))
            todo += [(c, inner, is_class) for c in reversed([*ast.iter_child_nodes(node)])]
    out.symbols[1:] = sorted(out.symbols[1:], key=lambda s: s.start_byte)
    return out


def _by_lines(source: str) -> Extraction:
    """Definitions end where a line is indented no more than they are; calls are not looked for."""
    places = Places(source)
    out = Extraction("graph", [places.module()])
    classes: list[int] = []
    for m in _DEF.finditer(source):
        indent = len(m[1].expandtabs(8))
        classes = [c for c in classes if c < indent]
        end = re.compile(rf"\n(?![ \t]{{{len(m[1]) + 1},}}|[ \t]*(?:\n|#|$))").search(source, m.end())
        kind = "class" if m[2] == "class" else "method" if classes else "function"
        out.symbols.append(places.symbol(m[3], kind, m.start(2), end.start() if end else len(source)))
        if m[2] == "class":
            classes.append(indent)
    for m in _IMPORT.finditer(source):
        names = [m[1], *re.split(r"[,\s]+", m[2])] if m[1] else [re.split(r"\s", n.strip())[0] for n in m[3].split(",")]
        out.edges += [Edge(FILE, n, "import", "high") for n in names if n and n != "as"]
    return out
