"""Verdicts and text rules: sprint outlook, team health, blockers in comments, normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import days_between
from .delivery import COVERAGE


def blocker_phrase(bodies: Column, blocking: list[str], resolving: list[str]) -> Column:
    """The first phrase (in list order) in the newest comment that has any; null if that
    comment or a newer one has a resolving phrase. bodies: newest first, null if unread."""
    low = F.transform(bodies, lambda b: F.lower(b))
    has = lambda b, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(b, w))
    hits = F.transform(low, lambda b, i: F.struct(i.alias("i"), b.alias("b"), has(b, blocking).alias("hit"), has(b, resolving).alias("ok")))
    first = F.try_element_at(F.filter(hits, lambda h: h["hit"]), F.lit(1))
    vetoed = F.exists(hits, lambda h: h["ok"] & (h["i"] <= first["i"]))
    phrase = F.try_element_at(F.filter(F.array(*map(F.lit, blocking)), lambda w: F.contains(first["b"], w)), F.lit(1))
    return F.when(first.isNotNull() & ~vetoed, phrase)


def sprint_outlook(load: DataFrame, fc: DataFrame, lengths: DataFrame, active: DataFrame, as_of: Column) -> DataFrame:
    """Whether a team's active work lands: the pace it needs against the pace it had.
    load(team, issues, points, unestimated, done_points), fc(team, p50), lengths(team,
    median_days), active(team, end_ts)."""
    end = active.groupBy("team").agg(F.min("end_ts").alias("end_ts"))
    j = load.join(end, "team", "left").join(fc.select("team", "p50"), "team", "left").join(lengths, "team", "left")
    left = days_between(as_of, "end_ts")
    remaining, covered = F.col("points") - F.col("done_points"), (F.col("issues") - F.col("unestimated")) / F.col("issues")
    need = remaining / F.greatest(left, F.lit(0.5))
    ratio = need / (F.col("p50") / F.col("median_days"))
    known = F.col("p50").isNotNull() & F.col("median_days").isNotNull() & left.isNotNull()
    verdict = F.when(~known, "unknown").when(covered < COVERAGE, F.when(ratio > 1.75, "will-not-land").otherwise("unknown")).when((remaining <= 0) | (ratio <= 1), "on-track").when(ratio <= 1.75, "at-risk").otherwise("will-not-land")
    return j.select("team", remaining.alias("remaining"), F.round(left, 6).alias("days_left"), F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


def band(v: Column, watch: float, poor: float) -> Column:
    return F.when(v.isNull(), "unknown").when(v >= poor, "poor").when(v >= watch, "watch").otherwise("good")


def team_health(signals: DataFrame) -> DataFrame:
    """signals(team, review, carryover, estimation, spread[, outlook]): shares, a relative
    spread, and the verdict of the sprint's outlook where there is one."""
    limits = {"review": (0.2, 0.4), "carryover": (0.25, 0.5), "estimation": (0.2, 0.34), "spread": (1.0, 2.0)}
    tones = [band(F.col(c), *w).alias(c) for c, w in limits.items()]
    if "outlook" in signals.columns:
        o = F.col("outlook")
        tones.append(F.when(o == "on-track", "good").when(o == "at-risk", "watch").when(o == "will-not-land", "poor").otherwise("unknown").alias("outlook"))
    rows = signals.select("team", *tones)
    n = lambda tone: sum(((F.col(c) == tone).cast("int") for c in rows.columns[1:]), F.lit(0))
    head = F.when(n("unknown") == len(tones), "unknown").when(n("poor") >= 2, "poor").when((n("poor") == 1) | (n("watch") >= 2), "watch").otherwise("good")
    return rows.withColumn("health", head)


def triage(health: DataFrame) -> DataFrame:
    """Teams in the order in which they need a look: poor ones first, then those to watch,
    unknown and good ones; of equal ones the one with more poor signals. One row a team, so
    one task can put them in order."""
    from pyspark.sql import Window as W

    signals = [c for c in health.columns if c not in ("team", "health")]
    poor = sum(((F.col(c) == "poor").cast("int") for c in signals), F.lit(0))
    tone = F.array_position(F.lit(["poor", "watch", "unknown", "good"]), F.col("health"))
    rows = health.select("team", "health", poor.alias("poor"), tone.alias("tone"))
    return rows.withColumn("rank", F.row_number().over(W.orderBy("tone", F.desc("poor"), "team"))).drop("tone")


def identity(team: Column, kind: Column, key: Column, issue_keys: Column) -> Column:
    """A finding's name from day to day: its own key, or its first three issues'."""
    return F.concat_ws("|", team, kind, F.coalesce(key, F.array_join(F.slice(F.array_sort(issue_keys), 1, 3), ",")))


def parse_sprint(v: Column) -> Column:
    """A legacy sprint value `...[id=1,name=x,state=ACTIVE]` as a struct; <null> is null."""
    m = F.str_to_map(F.regexp_extract(v, r"\[(.*)\]\s*$", 1), F.lit(","), F.lit("="))
    get = lambda k: F.nullif(F.nullif(F.try_element_at(m, F.lit(k)), F.lit("<null>")), F.lit(""))
    return F.struct(get("id").try_cast("bigint").alias("id"), get("name").alias("name"), F.lower(get("state")).alias("state"), get("goal").alias("goal"), get("startDate").alias("startDate"), get("endDate").alias("endDate"), get("completeDate").alias("completeDate"))


def blockers(links: Column) -> Column:
    """Links array<struct<type, key>> as struct(blocked_by, blocks), distinct and sorted."""
    text = lambda x: F.lower(x["type"])
    keys = lambda p: F.array_sort(F.array_distinct(F.transform(F.filter(links, p), lambda x: x["key"])))
    by = lambda x: F.contains(text(x), F.lit("blocked by"))
    return F.struct(keys(by).alias("blocked_by"), keys(lambda x: F.contains(text(x), F.lit("block")) & ~by(x)).alias("blocks"))


def sprint_ids(csv: Column) -> Column:
    """`"6145,5462"` as distinct ids; blank or null: none."""
    ids = F.filter(F.transform(F.split(csv, ","), lambda t: F.trim(t).try_cast("bigint")), lambda i: i.isNotNull())
    return F.coalesce(F.array_distinct(ids), F.expr("cast(array() as array<bigint>)"))
