"""Column expressions for cleaning, splitting, counting and rewriting text.

Every function takes and returns a ``Column``; all of them stay in the JVM.
White space means what Python's ``str.isspace`` means, written out as an
explicit character class: Java's ``\\s`` is ASCII only, and its Unicode mode is
a slightly different set.  The class tests a bit table first and one range
next, so letters are passed over in two steps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
WS_CLASS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SENTENCE_END = r"[.!?;:]"
SENTENCE_START = "[A-ZÁÉÍÓÚÂÊÎÔÛÃÕÀÄËÏÖÜÇ0-9]"
SENTENCE_BREAK = f"(?<={SENTENCE_END}){WS_CLASS}+(?={SENTENCE_START})"
#: Broken-word repairs, applied in this order, each on the last result.
HYPHEN_REPAIRS = (
    r"- ([A-Za-zÀ-ÖØ-öø-ÿ])- ",
    r"- ([a-zà-öø-ÿ])- ",
    r"- ([A-Za-zÀ-ÖØ-öø-ÿ])-",
    r"- ([a-zà-öø-ÿ])-",
)
# --------------------------------------------------------------------------


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` evaluated once.

    A column used several times is several copies of its expression, and
    Catalyst shares them only where all are certain to run.  Binding it to a
    lambda variable makes the sharing explicit.
    """
    return F.get(F.transform(F.array(c), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.length(trim_ws(c)) == 0, F.lit(True))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def split_sentences(c: Column, pattern: str | None = None) -> Column:
    """Sentences of a text in order; blank text gives an empty array.

    The default pattern breaks only where white space stands between an end
    mark and a sentence start, so parts need no further trimming.  A custom
    pattern may leave blank parts, which are trimmed and dropped.
    """
    body = trim_ws(c)
    if pattern is None:
        parts = F.split(body, SENTENCE_BREAK)
    else:
        parts = F.filter(F.transform(F.split(body, pattern), trim_ws), lambda s: s != "")
    return F.when(is_blank(c), empty_strings()).otherwise(parts)


def clean_text(c: Column) -> Column:
    """Repair broken words, drop hyphens and NULs, collapse white space."""
    repaired = c
    for rule in HYPHEN_REPAIRS:
        repaired = F.regexp_replace(repaired, rule, "$1")
    repaired = F.regexp_replace(repaired, "-+", " ")
    body = F.when(F.contains(c, F.lit("-")), repaired).otherwise(c)
    body = F.translate(body, "\x00", " ")
    return F.coalesce(trim_ws(F.regexp_replace(body, WS_CLASS + "+", " ")), F.lit(""))


def tokens(c: Column) -> Column:
    """White-space tokens of a text; blank text gives an empty array."""
    return F.when(is_blank(c), empty_strings()).otherwise(F.split(trim_ws(c), WS_CLASS + "+"))


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def collapse_ws(c: Column) -> Column:
    """Two or more white-space characters become one space; then trim."""
    return trim_ws(F.regexp_replace(c, WS_CLASS + "{2,}", " "))


def quote_pattern(literal: str) -> str:
    """A regular expression that matches ``literal`` and nothing else."""
    return re.escape(literal)


def quote_replacement(literal: str) -> str:
    """A Java replacement string that stands for ``literal``."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def apply_custom_rules(c: Column, rules: Mapping[str, str] | None) -> Column:
    """Case-insensitive literal replacements, each on the last result."""
    for literal, replacement in (rules or {}).items():
        c = F.regexp_replace(c, "(?iu)" + quote_pattern(literal), quote_replacement(replacement))
    return c


def line_list(c: Column, limit: int | None = None) -> Column:
    """Non-blank lines, trimmed, optionally the first ``limit`` of them."""
    lines = F.filter(F.transform(F.split(c, "\n"), trim_ws), lambda s: s != "")
    return lines if limit is None else F.slice(lines, 1, limit)


def truncate_tokens(c: Column, limit: int) -> Column:
    """Keep the last ``limit`` white-space tokens, joined by one space.

    A text within the limit comes back unchanged, as a tokenizer that does
    not have to cut would leave it.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return let(
        tokens(c),
        lambda toks: F.when(F.size(toks) <= limit, c).otherwise(F.array_join(F.slice(toks, -limit, limit), " ")),
    )


def row_as_text(*cols: Column | str) -> Column:
    """All given columns of a row rendered as one JSON text."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def as_id(c: Column) -> Column:
    """Identifiers are compared as text, whatever type they were read with."""
    return c.cast("string")
