"""Sprints: metrics, forecasts, load, backlog and composition of teams.

Tables: issue, issue_sprint (all sprints of an issue), sprint; all keyed by team. An issue may
bring the ids of its sprints along in an array, sprint_ids; then issue_sprint is not read, and
the sprints of a board, which are few, come to its issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import count_if, days_between, done, exact, points, total
from ..functions.ranks import percentiles

#: Closed sprints that forecasts look back on, and the estimate coverage a verdict needs.
WINDOW, COVERAGE = 12, 2 / 3


def in_order(sprint: DataFrame) -> DataFrame:
    """Sprints with their place in time: by start, those without one last, then by id."""
    return sprint.withColumn("place", F.row_number().over(W.partitionBy("team").orderBy(F.asc_nulls_last("start_ts"), "sprint_id")))


def members(issue: DataFrame, issue_sprint: DataFrame, sprint: DataFrame) -> DataFrame:
    """A row for each issue in each of sprint(team, sprint_id, ...), with the columns of both."""
    if "sprint_ids" in issue.columns:
        rows = issue.withColumn("sprint_id", F.explode("sprint_ids")).drop("sprint_ids")
        return rows.join(F.broadcast(sprint), ["team", "sprint_id"])
    return issue_sprint.join(sprint, ["team", "sprint_id"]).join(issue, ["team", "key"])


def counted(issue: DataFrame, issue_sprint: DataFrame) -> DataFrame:
    """issue with sprint_count, how many sprints it is in (null: none)."""
    if "sprint_ids" in issue.columns:
        return issue.withColumn("sprint_count", F.nullif(F.size("sprint_ids"), F.lit(0)).cast("long"))
    return issue.join(sprint_counts(issue_sprint), ["team", "key"], "left")


def inside(issue: DataFrame, issue_sprint: DataFrame, sprint: DataFrame, name: str = "inside") -> DataFrame:
    """issue with a column that tells whether it is in any of sprint(team, sprint_id)."""
    if "sprint_ids" in issue.columns:
        ids = sprint.groupBy("team").agg(F.collect_set("sprint_id").alias("__ids"))
        is_in = F.coalesce(F.arrays_overlap("sprint_ids", "__ids"), F.lit(False))
        return issue.join(F.broadcast(ids), "team", "left").select(*issue.columns, is_in.alias(name))
    keys = issue_sprint.join(sprint, ["team", "sprint_id"], "left_semi").select("team", "key", F.lit(True).alias(name)).distinct()
    return issue.join(keys, ["team", "key"], "left").select(*issue.columns, F.coalesce(name, F.lit(False)).alias(name))


def sprint_members(issue: DataFrame, issue_sprint: DataFrame, sprint: DataFrame) -> DataFrame:
    """Each issue of each sprint, whether it was resolved within the sprint's window, and
    whether it is in a later sprint too."""
    s = in_order(sprint)
    if "sprint_ids" in issue.columns:
        place = s.where("sprint_id is not null").groupBy("team", "sprint_id").agg(F.max("place").alias("place"))
        places = place.groupBy("team").agg(F.map_from_entries(F.collect_list(F.struct("sprint_id", "place"))).alias("places"))
        last = F.array_max(F.transform("sprint_ids", lambda i: F.try_element_at("places", i)))
        rows = members(issue.join(F.broadcast(places), "team").withColumn("last", last).drop("places"), issue_sprint, s)
    else:
        rows = members(issue, issue_sprint, s).withColumn("last", F.max("place").over(W.partitionBy("team", "key")))
    end = F.coalesce("complete_ts", "end_ts")
    within = F.coalesce((F.col("resolved") >= F.col("start_ts")) & (F.col("resolved") <= end), F.lit(False))
    return rows.withColumn("within", within).withColumn("carried", F.col("last") > F.col("place")).drop("last")


def sprint_metrics(issue: DataFrame, issue_sprint: DataFrame, sprint: DataFrame) -> DataFrame:
    """Committed and completed work of every sprint, empty ones included."""
    rows = sprint_members(issue, issue_sprint, sprint)
    lead = F.when(F.col("within") & (days_between("created", "resolved") >= 0), days_between("created", "resolved"))
    m = rows.groupBy("team", "sprint_id").agg(
        F.count("*").alias("committed_issues"), total(points()).alias("committed_points"), count_if(F.col("within")).alias("completed_issues"),
        total(F.when(F.col("within"), points())).alias("completed_points"), count_if(F.col("points").isNull()).alias("unestimated"),
        count_if(F.col("carried")).alias("carried_out"), exact(lead, 0.5).alias("lead_p50"), exact(lead, 0.9).alias("lead_p90"),
    )
    late = F.round(days_between("end_ts", "complete_ts"), 6).alias("days_late")
    return in_order(sprint).select("team", "sprint_id", "state", "place", late).join(m, ["team", "sprint_id"], "left").fillna(0, ["committed_issues", "committed_points", "completed_issues", "completed_points", "unestimated", "carried_out"])


def completed_by_type(issue, issue_sprint, sprint) -> DataFrame:
    return sprint_members(issue, issue_sprint, sprint).where("within").groupBy("team", "sprint_id", "issue_type").agg(F.count("*").alias("n"))


def last_closed(metrics: DataFrame, window: int = WINDOW) -> DataFrame:
    r = F.row_number().over(W.partitionBy("team").orderBy(F.desc("place")))
    return metrics.where("state = 'closed'").withColumn("r", r).where(F.col("r") <= window)


def _forecast(pick: Column, name: str = "") -> list[Column]:
    v = F.when(pick > 0, pick)
    p = {n: exact(v, x) for n, x in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))}
    spread = F.round((p["p90"] - p["p10"]) / p["p50"], 6)
    return [F.count(v).alias(f"{name}basis"), *(c.alias(f"{name}{n}") for n, c in p.items()), spread.alias(f"{name}spread")]


def forecast(metrics: DataFrame, pick: Column, window: int = WINDOW) -> DataFrame:
    """Percentiles of the last closed sprints; those that yielded nothing do not count."""
    return last_closed(metrics, window).groupBy("team").agg(*_forecast(pick))


def team_trends(metrics: DataFrame, window: int = WINDOW) -> DataFrame:
    """Both forecasts and the median share of issues that were carried out of a sprint, in
    one grouping of the metrics."""
    rate = F.when(F.col("committed_issues") > 0, F.col("carried_out") / F.col("committed_issues"))
    figures = [*_forecast(F.col("completed_points"), "points_"), *_forecast(F.col("completed_issues"), "issues_")]
    return last_closed(metrics, window).groupBy("team").agg(*figures, exact(rate, 0.5).alias("carryover_median"))


def in_active(issue: DataFrame, issue_sprint: DataFrame, sprint: DataFrame) -> DataFrame:
    """Issues in any active sprint, each once."""
    return inside(issue, issue_sprint, sprint.where("state = 'active'"), "__in").where("__in").drop("__in")


def active_load(issue, issue_sprint, sprint) -> DataFrame:
    rows = in_active(issue, issue_sprint, sprint)
    return rows.groupBy("team").agg(F.count("*").alias("issues"), total(points()).alias("points"), count_if(F.col("points").isNull()).alias("unestimated"), count_if(done()).alias("done_issues"))


def load_verdict(load: DataFrame, fc: DataFrame) -> DataFrame:
    """A warning needs no coverage; a reassurance needs two thirds estimated."""
    covered = F.col("estimated") / F.col("issues") >= COVERAGE
    j = load.join(fc, "team", "left").withColumn("estimated", F.col("issues") - F.col("unestimated"))
    verdict = F.when(F.col("issues") == 0, "none").when(F.col("p90").isNull(), "no-forecast").when(F.col("points") > F.col("p90"), "over").when(~covered, "unknown").otherwise("within")
    return j.select("team", "issues", "points", "p90", verdict.alias("verdict"))


def backlog_summary(issue: DataFrame, as_of: Column) -> DataFrame:
    age = days_between("created", as_of)
    rows = issue.where(F.col("in_backlog") & ~done())
    g = rows.groupBy("team").agg(F.count("*").alias("issues"), total(points()).alias("points"), count_if(F.col("points").isNull()).alias("unestimated"), count_if(age > 90).alias("older_than_90"))
    return g.join(percentiles(rows, ["team"], {"age": (age, {"median_age": 0.5})}), "team", "left")


def top(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of each team in an order that ends in a unique key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("team").orderBy(*order))).where(F.col("rank") <= n)


def backlog_next_up(issue: DataFrame, n: int = 12) -> DataFrame:
    return top(issue.where(F.col("in_backlog") & ~done()), n, F.asc_nulls_last("priority"), "pos").select("team", "rank", "key", "priority", "points")


def sprint_counts(issue_sprint: DataFrame) -> DataFrame:
    return issue_sprint.groupBy("team", "key").agg(F.count("*").alias("sprint_count"))


def carryover_leaders(issue, issue_sprint, sprint, n: int = 6) -> DataFrame:
    """Open issues of the latest-started active sprint in most sprints."""
    latest = top(sprint.where("state = 'active'"), 1, F.desc("start_ts"), "sprint_id")
    rows = counted(inside(issue.where(~done()), issue_sprint, latest.select("team", "sprint_id")).where("inside"), issue_sprint)
    return top(rows, n, F.desc("sprint_count"), "pos").select("team", "rank", "key", "sprint_count")


def sprint_length(sprint: DataFrame) -> DataFrame:
    d = days_between("start_ts", F.coalesce("complete_ts", "end_ts"))
    return sprint.where("state = 'closed'").groupBy("team").agg(exact(F.when(d > 0, d), 0.5).alias("median_days"))


def slowest_resolved(issue: DataFrame, n: int = 15) -> DataFrame:
    lead = days_between("created", "resolved")
    rows = issue.withColumn("lead", F.round(lead, 6)).where("lead >= 0")
    return top(rows, n, F.desc("lead"), "pos").select("team", "rank", "key", "lead")


def primary_sprint(metrics: DataFrame) -> DataFrame:
    """Of several active sprints the one with the most committed points, then the first."""
    return top(metrics.where("state = 'active'"), 1, F.desc("committed_points"), "place").select("team", "sprint_id", "committed_points")


def log_scope(issue_sprint: DataFrame, sprint: DataFrame, window: int = WINDOW) -> DataFrame:
    """Issues whose log is worth reading: those of the last closed sprints and of all that
    are not closed."""
    s = in_order(sprint)
    scope = last_closed(s, window).select("team", "sprint_id").union(s.where("state != 'closed'").select("team", "sprint_id"))
    return issue_sprint.join(scope, ["team", "sprint_id"], "left_semi").select("team", "key").distinct()
