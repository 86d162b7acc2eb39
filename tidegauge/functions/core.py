"""Column functions that the operators share. Durations are fractional; clocks are columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_EPIC, OFF_BOARD = "(no epic)", "(not on the board)"
NO_KEYS = "cast(array() as array<string>)"


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def days_between(start, end) -> Column:
    return (micros(end) - micros(start)) / 86_400e6


def hours_between(start, end) -> Column:
    """Null where either is missing or the end comes first."""
    h = (micros(end) - micros(start)) / 3_600e6
    return F.when(h >= 0, h)


def done(c: str = "category") -> Column:
    return F.col(c) == "Done"


def exact(value, p: float) -> Column:
    """Percentile by linear interpolation between closest ranks; null of nothing."""
    return F.round(F.percentile(value, F.lit(p)), 6)


def js_round(x: Column, places: int = 0) -> Column:
    """Half up, also below zero."""
    return F.floor(x * 10**places + 0.5) / 10**places


def points(c: str = "points") -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


#: Fixed value: what an issue key looks like.
ISSUE_KEY = r"(?:^|[^A-Za-z0-9])([A-Z][A-Z0-9]*-\d+)"


def issue_keys(*texts: Column) -> Column:
    """Distinct issue keys in the texts, sorted."""
    found = [F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(ISSUE_KEY), F.lit(1)) for t in texts]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def collapse(s: Column) -> Column:
    """The lines of a text that are not blank, joined by middle dots, with single spaces."""
    lines = F.transform(F.split(s, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), " · ")


def excerpt(raw: Column, most: int) -> Column:
    """struct(text, truncated): cut at most characters, at the last space if that is late."""
    text = F.nullif(collapse(raw), F.lit(""))
    cut = F.substring(text, 1, most)
    space = F.length(F.regexp_extract(cut, r"(?s)^(.*) ", 1))
    short = F.when(space > 0.7 * most, F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(text.isNotNull(), F.struct(F.when(F.length(text) > most, F.rtrim(short)).otherwise(text).alias("text"), (F.length(text) > most).alias("truncated")))
