"""What charts draw, as long tables (team, series, x, y): they compute nothing that an
operator has not. x is text, so that all charts have one shape; a chart that has too little
to show gives no rows for its team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delivery import last_closed

ESTATE = "(all)"


def long(rows: DataFrame, x: str, series: dict[str, str], team: str | None = "team") -> DataFrame:
    """A row for each series (its name by its column) of each row; missing values are none."""
    who = F.col(team) if team else F.lit(ESTATE)
    pairs = F.array(*(F.struct(F.lit(name).alias("series"), F.col(c).cast("double").alias("y")) for c, name in series.items()))
    out = rows.select(who.alias("team"), F.col(x).cast("string").alias("x"), F.explode(pairs).alias("s"))
    return out.select("team", "s.series", "x", F.round("s.y", 6).alias("y")).where("y is not null")


def _enough(rows: DataFrame, x: str, least: int) -> DataFrame:
    """The rows of teams that have so many different x."""
    n = rows.groupBy("team").agg(F.count_distinct(x).alias("n")).where(F.col("n") >= least)
    return rows.join(n.select("team"), "team", "left_semi")


def delivery(metrics: DataFrame, forecast: DataFrame) -> DataFrame:
    """Completed points of the last closed sprints, what active ones took on, and what is
    usual and the most that is likely."""
    closed = last_closed(metrics).join(forecast.select("team", "p50", "p90"), "team", "left")
    active = metrics.where("state = 'active'")
    return long(closed, "sprint_id", {"completed_points": "completed", "p50": "p50", "p90": "p90"}).union(long(active, "sprint_id", {"committed_points": "committed"}))


def portfolio(forecast: DataFrame, load: DataFrame) -> DataFrame:
    rows = forecast.join(load.select("team", "points"), "team", "full")
    return long(rows, "team", {"p50": "p50", "p90": "p90", "points": "committed"})


def burndown(days: DataFrame, primary: DataFrame) -> DataFrame:
    """Of each team's primary sprint, if it was seen on two days."""
    rows = days.join(primary.select("team", "sprint_id"), ["team", "sprint_id"], "left_semi")
    return long(_enough(rows, "d", 2), "d", {"remaining": "remaining", "ideal": "ideal", "committed": "committed"})


def practice(people: DataFrame, n: int = 20) -> DataFrame:
    """The people who opened most, of all teams."""
    rows = people.where("authored > 0 or given > 0").orderBy(F.desc("authored"), F.desc("given"), "person").limit(n)
    rows = rows.withColumn("seen", F.col("merged_known") - F.col("merged_unreviewed"))
    return long(rows, "person", {"seen": "merged with review", "merged_unreviewed": "merged without", "given": "reviews given"}, None)


def wip(columns: DataFrame) -> DataFrame:
    rows = columns.where("issues > 0").withColumn("moving", F.col("issues") - F.col("stale"))
    return long(rows, "col", {"moving": "moving", "stale": "stale"})


def composition(sprints: DataFrame) -> DataFrame:
    return long(_enough(sprints, "sprint_id", 2), "sprint_id", {"points": "points", "contributors": "people"})


def column_ageing(summary: DataFrame) -> DataFrame:
    """Only of columns whose figures rest on enough."""
    return long(summary.where("reportable"), "col", {"p50": "median", "p90": "p90"})


def epics(active: DataFrame, n: int = 10) -> DataFrame:
    """The first active epics of each team; active: ranked, with their rank."""
    rows = active.where(F.col("rank") <= n).withColumn("still", F.col("active_issues") - F.col("active_done"))
    return long(rows, "epic", {"active_done": "done", "still": "open", "backlog_issues": "queued"})


def flow(days: DataFrame) -> DataFrame:
    """Issues by day, a series for each column."""
    rows = _enough(days, "d", 2)
    return rows.select("team", F.col("col").alias("series"), F.col("d").cast("string").alias("x"), F.col("n").cast("double").alias("y"))


def cycle_scatter(cycles: DataFrame, least: int = 3) -> DataFrame:
    """Cycle days by days since a team's first resolution; cycles whose start was not seen are
    a series of their own. Issues that share a day are told apart by their key."""
    first = cycles.groupBy("team").agg(F.to_date(F.min("resolved")).alias("first"), F.count("*").alias("n")).where(F.col("n") >= least)
    rows = cycles.join(first, "team")
    x = F.concat_ws(":", F.date_diff(F.to_date("resolved"), "first").cast("string"), "key")
    return rows.select("team", F.when(F.col("censored"), "start unseen").otherwise("seen").alias("series"), x.alias("x"), F.round("cycle_days", 2).alias("y"))


def review_latency(histogram: DataFrame, metrics: DataFrame) -> DataFrame:
    """The buckets of hours, and those that nobody looked at."""
    buckets = long(histogram, "bucket", {"n": "requests"})
    rows = buckets.union(long(metrics.withColumn("x", F.lit("never")), "x", {"never_reviewed": "requests"}))
    some = rows.groupBy("team").agg(F.sum("y").alias("all")).where(F.col("all") > 0)
    return rows.join(some.select("team"), "team", "left_semi")


def cross_team_load(roster: DataFrame, n: int = 14) -> DataFrame:
    """Open active work by board of the people who have some on several, most boards first."""
    own = roster.where("open_in_active > 0")
    many = own.groupBy("person").agg(F.count("*").alias("boards"), F.sum("open_in_active").alias("open")).where("boards > 1")
    first = many.orderBy(F.desc("boards"), F.desc("open"), "person").limit(n)
    rows = own.join(first.select("person"), "person", "left_semi")
    return rows.select(F.lit(ESTATE).alias("team"), F.col("team").alias("series"), F.col("person").alias("x"), F.col("open_in_active").cast("double").alias("y"))


def estate_epics(epics: DataFrame, n: int = 12) -> DataFrame:
    """The epics with most left to do, over all teams, in four parts."""
    left = F.col("issues") - F.col("done_issues")
    rows = epics.where("issues > 0").orderBy(F.desc(left), F.desc("issues"), "epic").limit(n)
    return long(rows, "epic", {"done_issues": "done", "active_open": "active", "backlog_open": "queued", "open_elsewhere": "elsewhere"}, None)
