"""How far a figure may be trusted, told by its column.

A label is metadata of a column: it goes with it through selections, joins and groupings by
it, and into Parquet and back. A figure made of others has no label until it is given one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: sound: recorded when it was true, or the board as it stands. bounded: nothing is seen
#: before the first day. weak: an approximation that its name does not tell. survivors: only
#: over what got so far. unusable: wrong for closed sprints, where later activity restates it.
LABELS = ("sound", "bounded", "weak", "survivors", "unusable")
KEY = "trust"
#: Columns that name a row or its place and measure nothing.
NAMES = {"sprint_id", "d", "place", "rank", "pos", "turn", "bucket", "level", "n_th", "mr", "first_sprint", "last_sprint"}
#: Columns whose label is not "sound", by query; * stands for all of its figures.
EXCEPT = {
    "sprint_metrics": {"lead_p50": "weak", "lead_p90": "weak", "committed_issues": "unusable", "committed_points": "unusable", "carried_out": "unusable"},
    "team_trends": {"carryover_median": "unusable"}, "slowest_resolved": {"lead": "weak"}, "wip_by_column": {"median_idle": "weak"},
    "epic_rollup": {"progress": "weak"}, "estate_epics": {"progress": "weak"}, "composition": {"*": "weak"}, "people_over_sprints": {"*": "weak"}, "contributors": {"*": "weak"},
    "cycle_times": {"cycle_days": "bounded", "lead_days": "weak"}, "cycle_summary": {"p50": "bounded", "p90": "bounded", "median_wait": "weak"}, "recent_cycles": {"cycle_days": "bounded"},
    "column_dwell": {"dwell_days": "bounded"}, "column_dwell_summary": {"p50": "bounded", "p90": "bounded"},
    "review_metrics": {c: "survivors" for c in ("first_p50", "first_p90", "bot_p50", "lag_p50", "lag_p90", "merge_p50", "merge_p90")}, "latency_histogram": {"*": "survivors"},
}


def label(df: DataFrame, trust: str, *columns: str) -> DataFrame:
    """df with the columns labelled; other metadata of theirs stays."""
    if trust not in LABELS:
        raise ValueError(f"{trust} is none of {', '.join(LABELS)}")
    for c in columns:
        df = df.withMetadata(c, {**df.schema[c].metadata, KEY: trust})
    return df


def labels(df: DataFrame) -> dict[str, str]:
    """The labels of a table's columns."""
    return {f.name: f.metadata[KEY] for f in df.schema if KEY in f.metadata}


def figures(df: DataFrame) -> list[str]:
    """Columns that measure something: numbers and truths that are no names."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in NAMES]


def unlabelled(df: DataFrame) -> list[str]:
    have = labels(df)
    return [c for c in figures(df) if c not in have]


def published(name: str, df: DataFrame) -> DataFrame:
    """A query's table with a label on each of its figures."""
    other = EXCEPT.get(name, {})
    by: dict[str, list[str]] = {}
    for c in unlabelled(df):
        by.setdefault(other.get(c, other.get("*", "sound")), []).append(c)
    for trust, columns in by.items():
        df = label(df, trust, *columns)
    return df
