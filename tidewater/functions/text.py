"""Strings as Python sees them: its white space, strip, and transcripts split into turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that Python's str.isspace accepts, as a Java class. Spark's \s and trim know fewer.
PY_WS = "[\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Fixed value: what begins a turn of a two-party transcript.
TURN = "(?:^|\\n\\n)(Human|Assistant): "


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PY_WS}+|{PY_WS}+$", "")


def squash(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{PY_WS}+", " "))


def parse_transcript(c: Column) -> Column:
    """array<struct<role, content>> of a transcript: text before the first marker and empty turns go. Null for null."""
    safe = F.translate(c, "\u0001\u0002", "")
    parts = F.split(F.regexp_replace(safe, TURN, "\u0001$1\u0002"), "\u0001")
    turns = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, "\u0002"))
    named = F.transform(turns, lambda t: F.struct(F.when(t[0] == "Human", "user").otherwise("assistant").alias("role"), strip(t[1]).alias("content")))
    return F.filter(named, lambda m: m["content"] != "")


def has_turn(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(TURN)), F.lit(False))


def is_raw_pair(chosen: Column, rejected: Column) -> Column:
    """Whether both strings look like transcripts; looser than the turn pattern, which wants a space after the colon."""
    tests = [F.coalesce(F.contains(c, F.lit(m)), F.lit(False)) for c in (chosen, rejected) for m in ("Human:", "Assistant:")]
    return tests[0] & tests[1] & tests[2] & tests[3]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)
