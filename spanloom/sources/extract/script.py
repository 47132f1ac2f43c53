"""JavaScript and TypeScript: a tolerant token scan with matched braces, and on it a reading of heads, types, members and elements."""

from __future__ import annotations

import re
from array import array
from heapq import heappop, heappush
from itertools import accumulate

from .base import FILE, Edge, Extraction, Places

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<tick>`)
    |(?P<name>\#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<op>\?\.|\.\.\.|[^\s])""",
    re.X | re.S,
)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: Names before "(" that are no calls, and none of whose braces is a method's body.
_KEYWORDS = frozenset("if for while switch catch return typeof await yield new function super import export delete void in of instanceof throw case do else try finally with".split())
#: After these a slash begins a regular expression.
_BEFORE_REGEX = frozenset("( [ { } , ; : ? = ! & | + - * % < > ~ ^ => return typeof case in of delete void throw new else do".split())


#: After these (or at the begin) "<" begins an element.
_BEFORE_ELEMENT = frozenset("( [ { } , ; : ? = & | => return default".split())
_MARKUP = re.compile("[<{]")
_ELEMENT = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>])(?!\s*(?:,|extends\s|=[^\"'{])))")


class Mates:
    """Token indexes to those of their closing brackets, as a dictionary's methods give them."""

    def __init__(self, n: int):
        self.at = array("q", [-1]) * n

    def __setitem__(self, k: int, close: int) -> None:
        self.at[k] = close

    def __contains__(self, k: int) -> bool:
        return 0 <= k < len(self.at) and self.at[k] >= 0

    def __getitem__(self, k: int) -> int:
        return self.at[k]

    def get(self, k: int, default: int) -> int:
        return self.at[k] if 0 <= k < len(self.at) and self.at[k] >= 0 else default


class Scan:
    """Tokens of a source: kinds, texts, starts and ends; ``mate`` maps an opening bracket's index to its closing one's.

    ``jsx``: elements are read as such, so their text is no code.
    """

    def __init__(self, source: str, jsx: bool = False):
        self.source, self.jsx = source, jsx
        self.kinds, self.texts, self.starts, self.ends, self._known = [], [], array("q"), array("q"), {}
        self._read(0)
        self.mate, stack, open_ = Mates(len(self.texts)), [], dict.fromkeys(_CLOSE.values(), 0)
        for k, (kind, t) in enumerate(zip(self.kinds, self.texts, strict=True)):
            if kind != "op":
                continue
            if t in _CLOSE:
                stack.append((_CLOSE[t], k))
                open_[_CLOSE[t]] += 1
            elif open_.get(t):
                while True:  # what was opened inside and not closed has no mate
                    closes, at = stack.pop()
                    open_[closes] -= 1
                    if closes == t:
                        self.mate[at] = k
                        break

    def __len__(self) -> int:
        return len(self.texts)

    def _add(self, kind: str, text: str, start: int, end: int) -> None:
        self.kinds.append(kind)
        self.texts.append(self._known.setdefault(text, text))  # equal texts are one
        self.starts.append(start)
        self.ends.append(end)

    def _read(self, at: int, inside: bool = False) -> int:
        """Tokens from ``at`` on, to the end or, ``inside`` braces, to the one that closes them; where it ended."""
        source, depth = self.source, 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            if m is None:
                return len(source)
            if inside and m[0] == "}" and not depth:
                return m.start()
            at = m.end()
            before = self.texts[-1] if self.texts else ";"
            if m.lastgroup == "comment":
                continue
            if m.lastgroup == "tick":
                at = self._template(m.start())
                continue
            if m[0] == "/" and before in _BEFORE_REGEX:
                r = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(source, m.start())
                if r:
                    self._add("regex", r[0], r.start(), r.end())
                    at = r.end()
                    continue
            if m[0] == "<" and self.jsx and before in _BEFORE_ELEMENT and _ELEMENT.match(source, m.start()):
                at = self._element(m.start())
                continue
            depth += (m[0] == "{") - (m[0] == "}")
            self._add(m.lastgroup, m[0], m.start(), m.end())
        return at

    def _braces(self, at: int) -> int:
        """Past braces at ``at`` whose content is code."""
        self._add("op", "{", at, at + 1)
        at = self._read(at + 1, True)
        if at < len(self.source):
            self._add("op", "}", at, at + 1)
        return at + 1

    def _template(self, at: int) -> int:
        """Past a template literal; what stands in its ${...} is read as code."""
        start, at = at, at + 1
        while at < len(self.source) and self.source[at] != "`":
            if self.source[at] == "\\":
                at += 2
            elif self.source.startswith("${", at):
                at = self._read(at + 2, True) + 1
            else:
                at += 1
        self._add("template", "`", start, min(at + 1, len(self.source)))
        return at + 1

    def _element(self, at: int) -> int:
        """Past an element and its children; code stands in braces only, in attributes and between tags."""
        source, depth = self.source, 0
        self._add("element", "<>", at, at + 1)
        while at < len(source):
            if source[at] == "{":
                at = self._braces(at)
            elif source[at] == "<":
                closing = source.startswith("</", at)
                at += 1 + closing
                while at < len(source) and source[at] != ">":  # a tag
                    if source[at] == "{":
                        at = self._braces(at)
                    elif source[at] in "\"'":
                        at = (source.find(source[at], at + 1) + 1) or len(source)
                    else:
                        at += 1
                depth += -1 if closing else 0 if source[at - 1] == "/" else 1
                at += 1
                if depth <= 0:
                    break
            else:
                m = _MARKUP.search(source, at)
                at = m.start() if m else len(source)
        at = min(at, len(source))
        self._add("element", "</>", at - 1, at)
        return at

    def text(self, k: int) -> str:
        return self.texts[k] if 0 <= k < len(self.texts) else ""

    def breaks(self, k: int) -> bool:
        """Whether a line ends before token ``k``."""
        return 0 < k < len(self) and self.source.find("\n", self.ends[k - 1], self.starts[k]) >= 0

    def kind(self, k: int) -> str:
        return self.kinds[k] if 0 <= k < len(self.kinds) else ""


def _after_angles(s: Scan, k: int) -> int:
    """Past type parameters or arguments, if there are any at ``k``."""
    if s.text(k) != "<":
        return k
    depth = 0
    while k < len(s):
        depth += (s.text(k) == "<") - (s.text(k) == ">")
        if not depth:
            return k + 1
        if s.text(k) == ";":
            break
        k = s.mate.get(k, k) + 1
    return k


_TYPE_PREFIX = frozenset("keyof typeof readonly unique infer asserts new abstract".split())


def _after_type(s: Scan, k: int) -> int:
    """Past a type."""
    while True:
        while s.text(k) in ("|", "&") or s.text(k) in _TYPE_PREFIX and (s.kind(k + 1) == "name" or s.text(k + 1) in ("(", "<", "{", "[")):
            k += 1
        k = _after_angles(s, k)
        if s.text(k) == "(" and k in s.mate:
            k = s.mate[k] + 1
        elif s.text(k) in ("{", "[") and k in s.mate:
            k = s.mate[k] + 1
        elif s.kind(k) in ("name", "string", "number", "template"):
            k += 1
            while s.text(k) == "." and s.kind(k + 1) == "name":
                k += 2
            if s.text(k - 1) == "import" and s.text(k) == "(":
                k = s.mate.get(k, k) + 1
            k = _after_angles(s, k)
        elif s.text(k) == "-":
            k += 2
        else:
            return k
        while s.text(k) == "[" and k in s.mate and not s.breaks(k):
            k = s.mate[k] + 1
        if s.text(k) == "is" and not s.breaks(k) or s.kind(k) == "arrow" or s.text(k) in ("|", "&"):
            k += 1
        elif s.text(k) == "extends" and not s.breaks(k):
            k = _after_type(s, k + 1)
            if s.text(k) != "?":
                return k
            k = _after_type(s, k + 1)
            if s.text(k) != ":":
                return k
            k += 1
        else:
            return k


def _signature(s: Scan, k: int) -> int | None:
    """Past type parameters, parameters and result type that begin at ``k``; None if there are no parameters."""
    k = _after_angles(s, k)
    if s.text(k) != "(" or k not in s.mate:
        return None
    k = s.mate[k] + 1
    return _after_type(s, k + 1) if s.text(k) == ":" else k


def _function_body(s: Scan, k: int) -> int | None:
    """Index of the "{" of a function whose signature begins at ``k``; None if it has no body."""
    k = _signature(s, k)
    return k if k is not None and s.text(k) == "{" else None


def _class_body(s: Scan, k: int) -> int | None:
    """Index of the "{" of a class or interface, behind type parameters and what it extends."""
    k = _after_angles(s, k)
    while s.text(k) in ("extends", "implements"):
        k += 1
        while True:
            if s.text(k) == "{" and s.text(k - 1) in ("extends", "implements", ",") and k in s.mate:
                k = s.mate[k] + 1
            while s.kind(k) == "name" and s.text(k) not in ("extends", "implements") or s.text(k) in (".", "?.") or s.text(k) in ("(", "[") and k in s.mate:
                k = s.mate.get(k, k) + 1
            k = _after_angles(s, k)
            if s.text(k) in ("(", ".", "["):
                continue
            if s.text(k) != ",":
                break
            k += 1
    return k if s.text(k) == "{" else None


def _result_type(s: Scan, k: int) -> int | None:
    """Index of the arrow behind an arrow function's result type, which may itself be a function type in parentheses."""
    while k < len(s) and s.kind(k) != "arrow" and s.text(k) not in (";", "=", ")", "}"):
        k = _after_angles(s, k) if s.text(k) == "<" else s.mate.get(k, k) + 1
    return k if s.kind(k) == "arrow" else None


def _function_value(s: Scan, k: int) -> int | None:
    """If tokens at ``k`` are a function or arrow function, the index of its last token."""
    if s.text(k) == "async":
        k += 1
    if s.text(k) == "function":
        k += 1 + (s.text(k + 1) == "*")
        body = _function_body(s, k + (s.kind(k) == "name"))
        return s.mate.get(body, len(s) - 1) if body is not None else None
    k = _after_angles(s, k)
    if s.text(k) == "(" and k in s.mate:
        k = s.mate[k] + 1
        if s.text(k) == ":" and (end := _result_type(s, k + 1)) is not None:
            k = end
    elif s.kind(k) == "name":
        k += 1
    if s.kind(k) != "arrow":
        return None
    k += 1
    if s.text(k) == "{":
        return s.mate.get(k, len(s) - 1)
    last = k
    while k < len(s) and s.text(k) not in (";", ",", ")", "}", "]"):
        if k > last and s.source.count("\n", s.ends[k - 1], s.starts[k]) and s.text(k) in ("export", "const", "let", "var", "function", "class", "import"):
            break
        last = s.mate.get(k, k)
        k = last + 1
    return last


def extract(source: str, typed: bool, jsx: bool) -> Extraction:
    """``typed``: interfaces and type aliases too; ``jsx``: capitalised functions are components."""
    s, places = Scan(source, jsx), Places(source)
    out = Extraction("graph", [places.module()])
    owners: list[tuple[int, int, str]] = []  # (first token, last token, name)

    def add(name: str, kind: str, first: int, last: int) -> None:
        if kind == "function" and jsx and name[:1].isascii() and name[:1].isupper():
            kind = "component"
        out.symbols.append(places.symbol(name, kind, s.starts[first], s.ends[last]))
        owners.append((first, last, name))

    class_bodies: dict[int, int] = {}
    types: list[tuple[int, int]] = []  # tokens that are types, where nothing is called
    for k, (kind, t) in enumerate(zip(s.kinds, s.texts, strict=True)):
        before = s.text(k - 1)
        if kind != "name" or before in (".", "?."):
            continue
        if t == "function":
            n = k + 1 + (s.text(k + 1) == "*")
            named = s.kind(n) == "name"
            body = _function_body(s, n + named)
            if named and body is not None:
                first = k - 1 if before == "async" else k
                add(s.text(n), "function", first, s.mate.get(body, len(s) - 1))
            _annotations(s, n + named, types)
        elif t == "class" and s.text(k + 1) != ":":
            named = s.kind(k + 1) == "name" and s.text(k + 1) not in ("extends", "implements")
            body = _class_body(s, k + 1 + named)
            if body is not None:
                class_bodies[body] = s.mate.get(body, len(s) - 1)
                if named:
                    add(s.text(k + 1), "class", k - 1 if before == "abstract" else k, class_bodies[body])
        elif typed and t == "interface" and s.kind(k + 1) == "name" and not s.breaks(k + 1):
            body = _class_body(s, k + 2)
            if body is not None:
                end = s.mate.get(body, len(s) - 1)
                add(s.text(k + 1), "interface", k, end)
                types.append((body, end))
        elif typed and t == "type" and s.kind(k + 1) == "name" and s.text(n := _after_angles(s, k + 2)) == "=" and before not in ("import", "{", ","):
            last = _after_type(s, n + 1) - 1
            types.append((k + 2, last))
            add(s.text(k + 1), "type", k, min(last + (s.text(last + 1) == ";"), len(s) - 1))
        elif t in ("const", "let", "var"):
            _declarators(s, k, add)
        elif t == "import" and s.text(k + 1) not in ("(", "."):
            _imports(s, k, out)
    for body, end in class_bodies.items():
        _methods(s, body, end, add, types)
    _object_methods(s, class_bodies, add, types)
    named: dict[int, list[str]] = {}
    for first, _, name in owners:
        named.setdefault(first, []).append(name)
    typed_at, owner_at = _covered(len(s), types), _Innermost(owners)
    for k, (kind, t) in enumerate(zip(s.kinds, s.texts, strict=True)):
        if kind != "name" or t in _KEYWORDS or typed_at[k] or s.text(k - 1) in ("function", "class") or s.text(k - 1) == "*" and s.text(k - 2) in ("function", "{", "}", ";", ",", "async", "static"):
            continue
        n = k + 1 + (s.text(k + 1) == "?.")
        if s.text(n) != "(" or t == "async" and s.kind(s.mate.get(n, n) + 1) == "arrow" or t == "async" and s.text(s.mate.get(n, n) + 1) == ":" or any(t in named.get(f, ()) and _is_head(s, f, k) for f in range(max(0, k - 5), k + 1)):
            continue
        out.edges.append(Edge(owner_at(k), t, "call", "low"))
    out.symbols[1:] = sorted(out.symbols[1:], key=lambda x: (x.start_byte, -x.end_byte))
    return out


def _covered(n: int, ranges: list[tuple[int, int]]) -> bytearray:
    """For each of ``n`` tokens whether one of the ranges, both ends in them, holds it."""
    steps = array("q", bytes(8 * (n + 1)))
    for a, b in ranges:
        if (a := max(a, 0)) <= (b := min(b, n - 1)):
            steps[a] += 1
            steps[b + 1] -= 1
    return bytearray(depth > 0 for depth in accumulate(steps))


class _Innermost:
    """The name of the shortest of ``owners`` (first, last, name) that holds a token; tokens are asked for in order."""

    def __init__(self, owners: list[tuple[int, int, str]]):
        self.todo = sorted(((first, last - first, k) for k, (first, last, _) in enumerate(owners)), reverse=True)
        self.owners, self.open = owners, []

    def __call__(self, token: int) -> str:
        while self.todo and self.todo[-1][0] <= token:
            _, length, k = self.todo.pop()
            heappush(self.open, (length, k))
        while self.open and self.owners[self.open[0][1]][1] < token:
            heappop(self.open)
        return self.owners[self.open[0][1]][2] if self.open else FILE


def _is_head(s: Scan, first: int, k: int) -> bool:
    """Whether the name at ``k`` is the one that the definition from ``first`` gives (a method's name before its parameters)."""
    return all(s.kind(j) == "name" or s.text(j) in ("*",) for j in range(first, k)) and k - first <= 5


def _annotations(s: Scan, k: int, types: list[tuple[int, int]]) -> None:
    """Notes what of a signature at ``k`` is a type: type parameters, what stands behind ":" in parameters, the result."""
    start, k = k, _after_angles(s, k)
    if k > start:
        types.append((start, k - 1))
    if s.text(k) != "(" or k not in s.mate:
        return
    end, k = s.mate[k], k + 1
    while k < end:
        if s.text(k) == ":":
            after = _after_type(s, k + 1)
            types.append((k, min(after, end) - 1))
            k = max(after, k + 1)
        elif s.text(k) == "=":  # a default value goes to the next comma
            while k < end and s.text(k) != ",":
                k = s.mate.get(k, k) + 1
        else:
            k = s.mate.get(k, k) + 1
    if s.text(end + 1) == ":" and (after := _after_type(s, end + 2)) > end + 2:
        types.append((end + 1, after - 1))


def _declarators(s: Scan, k: int, add) -> None:
    k += 1
    while s.kind(k) == "name":
        first, at = k, k + 1
        if s.text(at) == "!":
            at += 1
        if s.text(at) == ":":
            at = _after_type(s, at + 1)
        if s.text(at) == "=" and (last := _function_value(s, at + 1)) is not None:
            add(s.text(first), "function", first, last)
            at = last + 1
        while at < len(s) and s.text(at) not in (",", ";", "}", ")") and not (s.kind(at) == "name" and s.text(at) in ("const", "let", "var", "function", "class", "export", "import")):
            at = s.mate.get(at, at) + 1
        if s.text(at) != ",":
            return
        k = at + 1


_MODIFIERS = frozenset("async static get set public private protected readonly override abstract declare accessor *".split())


def _methods(s: Scan, body: int, end: int, add, types: list[tuple[int, int]]) -> None:
    """Methods of a class; heads without a body are signatures, and what they say is types."""
    k = body + 1
    while k < end:
        n = k + 1 + (s.text(k + 1) in ("?", "!"))
        if s.kind(k) == "name" and s.text(n) in ("(", "<") and s.text(k - 1) not in (".", "?.", "=", "new", "@"):
            after, first = _signature(s, n), k
            while s.text(first - 1) in _MODIFIERS and first - 1 > body:
                first -= 1
            begins = s.text(first - 1) in ("{", "}", ";", ")") or s.breaks(first)
            if after is not None and s.text(after) == "{" and (begins or first < k):
                last = s.mate.get(after, end)
                while s.text(first) in ("abstract", "declare"):
                    first += 1
                add(s.text(k), "method", first, last)
                _annotations(s, n, types)
                k = last
            elif after is not None and begins and s.kind(after) != "arrow" and (s.text(after) in (";", "}") or s.breaks(after)):
                types.append((k, after - 1))
                k = after - 1
        k = s.mate.get(k, k) + 1


def _object_methods(s: Scan, class_bodies: dict[int, int], add, types: list[tuple[int, int]]) -> None:
    """Shorthand methods of object literals: a name, parameters and a body right after "{" or ","."""
    for k in range(len(s)):
        if s.kind(k) != "name" or s.text(k) in _KEYWORDS or s.text(k + 1) not in ("(", "<") or s.text(k - 1) not in ("{", ",", "async", "get", "set", "*"):
            continue
        first = k - (s.text(k - 1) in ("async", "get", "set", "*"))
        if s.text(first - 1) not in ("{", ",") or (first - 1) in class_bodies or s.text(first - 2) not in ("=", "(", ":", "return", ",", "[", "?", "}", "=>", ""):
            continue
        body = _function_body(s, k + 1)
        if body is not None and body in s.mate:
            add(s.text(k), "method", first, s.mate[body])
            _annotations(s, k + 1, types)


def _imports(s: Scan, k: int, out: Extraction) -> None:
    names, at = [], k + 1
    while at < len(s) and s.kind(at) != "string" and s.text(at) != ";":
        t = s.text(at)
        if s.kind(at) == "name" and t not in ("from", "type", "as") and s.text(at - 1) != "as":
            names.append(t)
        elif s.kind(at) == "name" and s.text(at - 1) == "as" and s.text(at - 2) == "*":
            names.append(t)
        at += 1
    out.edges += [Edge(FILE, n, "import", "high") for n in names]
    if s.kind(at) == "string" and (spec := s.text(at).strip("'\"")):
        out.edges.append(Edge(FILE, spec, "import", "high"))
