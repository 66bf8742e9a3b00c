"""Rule-based redaction: tags in place of personal details.

This is the deterministic stand-in for a model that hides personal details.
Contacts and numbers are patterns; names, places and organisations come from
gazetteers the caller supplies, found by one automaton for all names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.names import names_redactor
from textloom.functions.prompts import DETAIL_TAGS, Redaction
from textloom.functions.text import apply_custom_rules, collapse_ws, let

# Patterns without look-around, so any engine can repeat them ---
_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL = f"{_LOCAL}+@{_DOMAIN}"
ID = r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{11,19}"
PHONE = r"(?:\+[0-9]{1,3}[ -]?)?\(?[0-9]{2,3}\)?[ -]?[0-9]{3,5}-[0-9]{4}"
# -----------------------------------------------------------------------------
#: The same matches for an engine that tries every start: only the head of a run is one, or the place where the last match
#: ended, and a run is not given back.  So a long unbroken run costs its length.
_EMAIL_FROM_HEAD = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}"


@dataclass(frozen=True)
class Gazetteers:
    """Known names; literal, case-insensitive, whole words, longest first."""

    persons: Sequence[str] = ()
    locations: Sequence[str] = ()
    organizations: Sequence[str] = ()


def redaction_steps(wanted: Redaction) -> list[tuple[str, str, str]]:
    """``(kind, pattern, tag)`` of the active patterns in the order they are applied."""
    email, phone = DETAIL_TAGS["contact"]
    steps = [("contact", "email", _EMAIL_FROM_HEAD, email), ("number", "id", ID, DETAIL_TAGS["number"][0]), ("contact", "phone", PHONE, phone)]
    return [(name, pattern, tag) for kind, name, pattern, tag in steps if kind in wanted.hide]


def _name_lists(wanted: Redaction, gazetteers: Gazetteers) -> dict[str, tuple[str, ...]]:
    """Tag to names, of the active kinds that have any."""
    lists = {"person": gazetteers.persons, "organization": gazetteers.organizations, "place": gazetteers.locations}
    return {DETAIL_TAGS[kind][0]: tuple(names) for kind, names in lists.items() if kind in wanted.hide and names}


def _replace(c: Column, kind: str, pattern: str, tag: str) -> Column:
    """Replace one kind; a cheap test spares the pattern where it cannot match."""
    possible = {
        "email": lambda x: F.contains(x, F.lit("@")),
        "id": lambda x: x.rlike("[0-9]{3}"),
        "phone": lambda x: F.contains(x, F.lit("-")),
    }[kind]
    return let(c, lambda x: F.when(possible(x), F.regexp_replace(x, pattern, tag)).otherwise(x))


def _patterns(c: Column, wanted: Redaction) -> Column:
    for step in redaction_steps(wanted):
        c = _replace(c, *step)
    return c


def redact(c: Column, wanted: Redaction | None = None, gazetteers: Gazetteers = Gazetteers()) -> Column:
    """Patterns first, then names; with gazetteers not inside a higher-order function."""
    wanted = wanted or Redaction()
    names = _name_lists(wanted, gazetteers)
    return names_redactor(names)(_patterns(c, wanted)) if names else _patterns(c, wanted)


def redact_all(c: Column, wanted: Redaction | None = None, gazetteers: Gazetteers = Gazetteers()) -> Column:
    """:func:`redact` for every member of an ``array<string>``."""
    wanted = wanted or Redaction()
    names = _name_lists(wanted, gazetteers)
    done = F.transform(c, lambda s: _patterns(s, wanted))
    return names_redactor(names, listed=True)(done) if names else done


def redaction_counts(c: Column, wanted: Redaction | None = None, gazetteers: Gazetteers = Gazetteers()) -> Column:
    """``struct`` with the number of replacements of each active kind."""
    wanted = wanted or Redaction()
    counts = []
    for kind, pattern, tag in redaction_steps(wanted):
        counts.append(F.regexp_count(c, F.lit(pattern)).cast("bigint").alias(kind))
        c = _replace(c, kind, pattern, tag)
    names = _name_lists(wanted, gazetteers)
    after = names_redactor(names)(c) if names else c
    for tag in names:
        times = F.regexp_count(after, F.lit(tag)) - F.regexp_count(c, F.lit(tag))
        counts.append(times.cast("bigint").alias(tag.strip("<>").lower()))
    return F.struct(*counts)


def postprocess(c: Column, wanted: Redaction | None = None) -> Column:
    """The caller's own replacements in their given order, then white space."""
    return collapse_ws(apply_custom_rules(c, (wanted or Redaction()).replace))
