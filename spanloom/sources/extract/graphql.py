"""GraphQL: type definitions with their members, named operations and fragments."""

from __future__ import annotations

import re

from .base import Edge, Extraction, Places

_TOKEN = re.compile(r'#[^\n]*|"""(?:\\"""|.)*?(?:"""|\Z)|(?P<s>"(?:\\.|[^"\\\n])*")|(?P<n>[A-Za-z_]\w*)|(?P<p>\.\.\.|[{}()\[\]:=|&!@$,])|(?P<x>[^\s,#"{}()\[\]:=|&!@$]+)', re.S)
#: Kind of symbol by keyword; the keyword is the signature.
_TYPES = {"type": "type", "interface": "interface", "input": "type", "enum": "type", "union": "type", "scalar": "type"}
_ROOTS = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}


def extract(source: str) -> Extraction:
    tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(source) if m.lastgroup in ("s", "n", "p", "x") and m[0] != ","]
    if not tokens:
        return Extraction("error")
    places = Places(source)
    out = Extraction("graph", [places.module()])
    k = 0
    while k < len(tokens):
        word = tokens[k][0]
        if word == "extend":
            k = _definition_end(tokens, k + 2)
        elif word == "directive":
            k += 1
            while k < len(tokens) and tokens[k][0] not in _TYPES | _ROOTS | {"fragment": "", "extend": "", "schema": "", "directive": ""}:
                k += 1
        elif word in _TYPES and _is_name(tokens, k + 1):
            k = _type(tokens, k, places, out)
        elif word in _ROOTS and _is_name(tokens, k + 1):
            k = _operation(tokens, k, places, out)
        elif word == "fragment" and _is_name(tokens, k + 1) and k + 3 < len(tokens) and tokens[k + 2][0] == "on":
            end = _definition_end(tokens, k + 3)
            if _closed(tokens, k, end):
                out.symbols.append(places.symbol(tokens[k + 1][0], "type", tokens[k][1], tokens[end - 1][2], "fragment"))
                out.edges.append(Edge(tokens[k + 1][0], tokens[k + 3][0], "import", "high"))
            k = end
        else:
            k = _definition_end(tokens, k + (word != "{"))
    return out


def _is_name(tokens: list, k: int) -> bool:
    return k < len(tokens) and bool(re.fullmatch(r"[A-Za-z_]\w*", tokens[k][0]))


def _close(tokens: list, k: int) -> int:
    """The index after the bracket that closes the one at ``k``."""
    pairs, depth = {"{": "}", "(": ")", "[": "]"}, 0
    a, b = tokens[k][0], pairs[tokens[k][0]]
    while k < len(tokens):
        depth += (tokens[k][0] == a) - (tokens[k][0] == b)
        k += 1
        if not depth:
            return k
    return k


def _closed(tokens: list, k: int, end: int) -> bool:
    words = [t for t, *_ in tokens[k:end]]
    return words.count("{") == words.count("}") and words.count("(") == words.count(")") and "{" in words


def _definition_end(tokens: list, k: int) -> int:
    """Past the rest of a definition: its braces, or all before the next keyword."""
    starts = {*_TYPES, *_ROOTS, "fragment", "extend", "directive", "schema"}
    while k < len(tokens):
        if tokens[k][0] == "{":
            return _close(tokens, k)
        if tokens[k][0] in starts and tokens[k - 1][0] not in (":", "|", "=", "&", "@", "implements", "on"):
            return k
        k = _close(tokens, k) if tokens[k][0] in ("(", "[") else k + 1
    return k


def _type(tokens: list, k: int, places: Places, out: Extraction) -> int:
    keyword, name = tokens[k][0], tokens[k + 1][0]
    end = _definition_end(tokens, k + 2)
    body = next((j for j in range(k + 2, end) if tokens[j][0] == "{"), end)
    if body < end and not _closed(tokens, k, end):
        return end
    out.symbols.append(places.symbol(name, _TYPES[keyword], tokens[k][1], tokens[end - 1][2], keyword))
    if k + 2 < body and tokens[k + 2][0] == "implements":
        for j in range(k + 3, body):
            if tokens[j][0] == "@":
                break
            if _is_name(tokens, j):
                out.edges.append(Edge(name, tokens[j][0], "import", "high"))
    j = body + 1
    while j < end - 1:
        first = j
        if not _is_name(tokens, j):
            j += 1
            continue
        j += 1
        if keyword != "enum":
            if j < end and tokens[j][0] == "(":
                j = _close(tokens, j)
            if j < end and tokens[j][0] == ":":
                j += 1
                j = _close(tokens, j) if tokens[j][0] == "[" else j + 1
                while j < end and tokens[j][0] == "!":
                    j += 1
                if j < end and tokens[j][0] == "=":
                    j = _close(tokens, j + 1) if tokens[j + 1][0] in ("[", "{") else j + 2
        while j < end and tokens[j][0] == "@":
            j += 2
            if j < end and tokens[j][0] == "(":
                j = _close(tokens, j)
        out.symbols.append(places.symbol(f"{name}.{tokens[first][0]}", "method", tokens[first][1], tokens[j - 1][2], "enum_value" if keyword == "enum" else "field"))
    return end


def _operation(tokens: list, k: int, places: Places, out: Extraction) -> int:
    keyword, name = tokens[k][0], tokens[k + 1][0]
    end = _definition_end(tokens, k + 2)
    if not _closed(tokens, k, end):
        return end
    out.symbols.append(places.symbol(name, "function", tokens[k][1], tokens[end - 1][2], keyword))
    body = next(j for j in range(k, end) if tokens[j][0] == "{")
    if _is_name(tokens, body + 1):
        field = body + 3 if tokens[body + 2][0] == ":" else body + 1
        out.edges.append(Edge(name, f"{_ROOTS[keyword]}.{tokens[field][0]}", "call", "low"))
    return end
