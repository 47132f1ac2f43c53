"""Which characters every Unicode version since 3.2 puts in the same class.

The tokenizer library, tiktoken and Python's ``regex`` carry tables of
different Unicode versions.  On texts made of stable characters their letter,
number and space classes agree; any other text is left to the library itself.
"""

from __future__ import annotations

import unicodedata

_old = unicodedata.ucd_3_2_0


class _Unstable(dict):
    """char -> True if some table may see it otherwise."""

    def __missing__(self, c: str) -> bool:
        old, new = _old.category(c), unicodedata.category(c)
        bad = old == "Cn" or old[0] != new[0] or c in "\x1c\x1d\x1e\x1f᠎​\x85"
        self[c] = bad
        return bad


_unstable = _Unstable()


def is_stable(text: str) -> bool:
    if text.isascii():
        return not any(map(text.__contains__, "\x1c\x1d\x1e\x1f"))
    return not any(map(_unstable.__getitem__, set(text)))
