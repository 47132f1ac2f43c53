"""From the words of a question to lookups: symbol terms, path hints, full-text expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import TRIMMED
from .match import COMMIT_COLUMNS, MatchError, Phrase, parse_match

# Words that are not searched for.
STOPWORDS = frozenset(["the", "a", "an", "is", "in", "for", "of", "where", "how", "what"])
_IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
_QUOTED = re.compile(r'"([^"]*)"')
_HINT = re.compile(r".*/|\.[A-Za-z]", re.S)
_SYMBOL = re.compile(rf"{_IDENT}(?:\.{_IDENT})+|(?=\w*[A-Z_]){_IDENT}", re.A)


@dataclass
class QueryPlan:
    symbol_terms: list[str] = field(default_factory=list)
    path_hints: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)

    @property
    def fts_query(self) -> str:
        return " ".join(self.words)

    @property
    def terms(self) -> list[str]:
        """Symbol terms, then words, each once."""
        return list(dict.fromkeys([*self.symbol_terms, *self.words]))


def plan_query(query: str) -> QueryPlan:
    """Quoted strings and identifiers with capitals or underscores are symbols, paths are hints, other words are searched in texts."""
    plan = QueryPlan()
    symbols = [q.strip() for q in _QUOTED.findall(query) if q.strip()]
    hints = []
    for raw in _QUOTED.sub(" ", query).split():
        word = raw.strip(TRIMMED)
        if not word:
            continue
        if _HINT.match(word):
            hints.append(word)
        elif _SYMBOL.fullmatch(word):
            symbols.append(word)
        elif word.lower() not in STOPWORDS:
            plan.words.append(word)
    plan.symbol_terms, plan.path_hints = list(dict.fromkeys(symbols)), list(dict.fromkeys(hints))
    return plan


def ladder(text: str) -> list[Phrase]:
    """The expression itself; if it is none, all of it as one phrase."""
    try:
        return parse_match(text)
    except MatchError:
        return [Phrase(text.replace('"', ""))]


def fallback(text: str) -> list[Phrase]:
    """For texts with hyphens or underscores: their parts as alternatives."""
    parts = re.findall(r"[A-Za-z0-9]+", text) if re.search("[-_]", text) else []
    return parse_match(" OR ".join(parts)) if len(parts) > 1 and not set(parts) & {"AND", "OR", "NOT"} else []


#: The order under which the search of commits is listed.
COMMIT_SEARCH = -1


def commit_search(plan: QueryPlan) -> list[tuple[int, list[Phrase]]]:
    """The search of commits: the words as an expression; words that are none find no commits."""
    try:
        return [(COMMIT_SEARCH, parse_match(plan.fts_query, COMMIT_COLUMNS))]
    except MatchError:
        return []


def searches(plan: QueryPlan) -> list[tuple[int, list[Phrase]]]:
    """(order, expression) of the text searches of a plan: its words, then each symbol term, each with its fallback after it."""
    texts = [plan.fts_query, *plan.symbol_terms]
    each = [(2 * k + rung, e) for k, t in enumerate(texts) if t.strip() for rung, e in enumerate((ladder(t), fallback(t))) if e]
    return each


__all__ = ["COMMIT_SEARCH", "MatchError", "Phrase", "QueryPlan", "commit_search", "fallback", "ladder", "parse_match", "plan_query", "searches"]
