"""Many names at once: one Aho-Corasick automaton, over Arrow batches.

A name matches literally, without regard to case, and as whole words: neither a letter
nor a digit stands before or behind it.  Of names that overlap the first one
counts, of those that start together the longest.  The cost of a text follows its length and not
the number of names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Fold(dict):
    """Each character in one case; only where that is one character, so places in the text stay."""

    def __missing__(self, code: int) -> int:
        low = chr(code).upper().lower()
        self[code] = ord(low) if len(low) == 1 else code
        return self[code]


_FOLD = _Fold()


class Names:
    """An automaton over names, each with the tag that replaces it; the first list that has a name counts."""

    def __init__(self, lists: Mapping[str, tuple[str, ...]]):
        self.automaton = ahocorasick.Automaton()
        for tag, names in lists.items():
            for name in names:
                folded = name.translate(_FOLD)
                if folded and folded not in self.automaton:
                    self.automaton.add_word(folded, (len(folded), tag))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def redact(self, text: str | None) -> str | None:
        if not text or not self.any:
            return text
        found = []
        for end, (size, tag) in self.automaton.iter(text.translate(_FOLD)):
            start = end + 1 - size
            if not (start and text[start - 1].isalnum()) and not text[end + 1 : end + 2].isalnum():
                found.append((start, -size, tag))
        if not found:
            return text
        parts, at = [], 0
        for start, size, tag in sorted(found):
            if start >= at:
                parts += (text[at:start], tag)
                at = start - size
        return "".join([*parts, text[at:]])


_KNOWN: dict[int, tuple[tuple, Names]] = {}


def _names(key: tuple) -> Names:
    """The automaton of a worker for these lists; a worker keeps the last ones it used."""
    own = _KNOWN.get(hash(key))
    if own is None or own[0] != key:
        if len(_KNOWN) >= 4:
            _KNOWN.pop(next(iter(_KNOWN)))
        own = _KNOWN[hash(key)] = (key, Names(dict(key)))
    return own[1]


def names_redactor(lists: Mapping[str, tuple[str, ...]], listed: bool = False) -> Callable[[Column], Column]:
    """A column function that puts tags in place of names; ``listed`` for arrays of texts."""
    key = tuple(lists.items())

    if listed:

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            names = _names(key)
            return texts.map(lambda each: None if each is None else [names.redact(t) for t in each])

    else:

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(_names(key).redact)

    return run
