"""Dated boards: churn, burndown, cycle time, dwell and flow over a team's days.

Tables, all keyed by team and d, which numbers the days on which the team was collected, so
that a day without it is skipped and d - 1 is the day before:

    day(team, d, date, seen)                                  seen: when it was captured
    day_issue(team, d, key, status_id, category, created, resolved, points)
    day_member(team, d, key, sprint_id)
    day_sprint(team, d, sprint_id, state, start_ts, end_ts)
    day_column(team, d, col_pos, col, status_id)

A day_member may bring the columns of its issues' day_issue along, each row once; it is then
not joined with day_issue. A day's active sprints are few, so tables of them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import OFF_BOARD, count_if, days_between, done, hours_between, js_round, points, total
from ..functions.ranks import percentiles

SPRINT = ["team", "sprint_id"]
#: Observations that a column's percentiles need, and its oldest issues that are named.
LEAST_BASIS, OLDEST = 3, 5


def spans(day: DataFrame) -> DataFrame:
    """First and last day of each team. Spans are aggregated and joined, since a window over
    a team would bring all its rows to one task."""
    return day.groupBy("team").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))


def active_sprints(day: DataFrame, day_sprint: DataFrame) -> DataFrame:
    """The sprints that are active on their team's last day, with their dates then."""
    last = day_sprint.join(spans(day), "team").where("d = hi and state = 'active'")
    return last.select("team", "sprint_id", "start_ts", "end_ts")


def members(day_issue: DataFrame, day_member: DataFrame, sprints: DataFrame) -> DataFrame:
    """The issues of some sprints, day by day."""
    inside = day_member.join(F.broadcast(sprints.select(*SPRINT)), SPRINT, "left_semi")
    if "category" in day_member.columns:
        return inside
    inside = inside.dropDuplicates(["team", "d", "key", "sprint_id"])
    return inside.join(day_issue, ["team", "d", "key"])


def primary_sprints(day: DataFrame, day_issue: DataFrame, day_member: DataFrame, day_sprint: DataFrame) -> DataFrame:
    """Of several active sprints of a team the one with most points on its last day; of
    equal ones the smaller id."""
    active = active_sprints(day, day_sprint)
    last = members(day_issue, day_member, active).join(spans(day), "team").where("d = hi")
    held = active.join(last.groupBy(*SPRINT).agg(total(points()).alias("committed")), SPRINT, "left").fillna(0, ["committed"])
    rank = F.row_number().over(W.partitionBy("team").orderBy(F.desc("committed"), "sprint_id"))
    return held.withColumn("r", rank).where("r = 1").drop("r")


def compared(day: DataFrame, day_sprint: DataFrame) -> DataFrame:
    """The days d of each active sprint that are compared with the day before: those before
    which it was there already, since its opening is no change."""
    existed = day_sprint.join(active_sprints(day, day_sprint).select(*SPRINT), SPRINT, "left_semi")
    rows = existed.select(*SPRINT, (F.col("d") + 1).alias("d")).distinct().join(spans(day), "team")
    return rows.where("d <= hi").select(*SPRINT, "d")


def sprint_changes(day, day_issue, day_member, day_sprint) -> DataFrame:
    """What each issue of an active sprint did between a day and the one before."""
    rows = members(day_issue, day_member, active_sprints(day, day_sprint))
    return changes_of(rows, compared(day, day_sprint))


def changes_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows: the issues of sprints by day; pairs(team, sprint_id, d): what is compared with
    the day before. Each row stands for its day and for the next one's past, and both meet in
    one grouping, since a join of the days would move them twice."""
    at = [*SPRINT, "d", "key"]
    now = F.struct(points().alias("points"), F.col("points").alias("stated"), "category")
    none = F.lit(None).cast(rows.select(now.alias("x")).schema["x"].dataType)
    today, past = rows.select(*at, none.alias("was"), now.alias("now")), rows.select(*SPRINT, (F.col("d") + 1).alias("d"), "key", now.alias("was"), none.alias("now"))
    both = today.union(past).groupBy(*at).agg(F.max("was").alias("was"), F.max("now").alias("now")).join(pairs, [*SPRINT, "d"], "left_semi")
    kind = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(~F.col("was.stated").eqNullSafe(F.col("now.stated")), "reestimated").otherwise("same")
    )
    resolved = F.coalesce((F.col("was.category") != "Done") & (F.col("now.category") == "Done"), F.lit(False))
    least = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select(*at, kind.alias("kind"), least(F.col("was.points")).alias("was"), least(F.col("now.points")).alias("now"), resolved.alias("resolved"))


def _change_sums() -> dict[str, Column]:
    k = F.col("kind")
    return {
        "added_points": F.when(k == "added", F.col("now")), "removed_points": F.when(k == "removed", F.col("was")),
        "reestimated_points": F.when(k == "reestimated", F.col("now") - F.col("was")),
    }


def sprint_delta(day, day_issue, day_member, day_sprint) -> DataFrame:
    """Scope added, removed and re-estimated in each active sprint from day to day; pairs of
    days without a change are there with zeros."""
    return delta_of(sprint_changes(day, day_issue, day_member, day_sprint), compared(day, day_sprint))


def delta_of(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    kinds = ("added", "removed", "reestimated")
    found = changes.groupBy(*SPRINT, "d").agg(*(count_if(F.col("kind") == x).alias(x) for x in kinds), count_if(F.col("resolved")).alias("resolved"), *(total(v).alias(n) for n, v in _change_sums().items()))
    rows = pairs.join(found, [*SPRINT, "d"], "left").fillna(0)
    return rows.withColumn("net_points", F.col("added_points") - F.col("removed_points") + F.col("reestimated_points"))


def opening_points(day_issue, day_member, day_sprint, sprints: DataFrame) -> DataFrame:
    """Points of each sprint on the first day on which it was there."""
    first = day_sprint.join(sprints.select(*SPRINT), SPRINT, "left_semi").groupBy(*SPRINT).agg(F.min("d").alias("d"))
    held = members(day_issue, day_member, sprints).join(first, [*SPRINT, "d"], "left_semi").groupBy(*SPRINT).agg(total(points()).alias("opening"))
    return first.join(held, SPRINT, "left").select(*SPRINT, F.coalesce("opening", F.lit(0)).alias("opening"))


def churn_summary(day, day_issue, day_member, day_sprint) -> DataFrame:
    """Sums over all pairs of days of each active sprint, the rate over the opening points,
    and how many late additions stayed: those that no day removed."""
    opening = opening_points(day_issue, day_member, day_sprint, active_sprints(day, day_sprint))
    return churn_of(sprint_changes(day, day_issue, day_member, day_sprint), compared(day, day_sprint), opening)


def churn_of(changes: DataFrame, pairs: DataFrame, opening: DataFrame) -> DataFrame:
    """Changes are read once: summed by issue, then by sprint."""
    is_ = lambda k: F.col("kind") == k
    names = list(_change_sums())
    by_key = changes.groupBy(*SPRINT, "key").agg(*(count_if(is_(k)).alias(k) for k in ("added", "removed")), *(total(v).alias(n) for n, v in _change_sums().items()))
    s = by_key.groupBy(*SPRINT).agg(*(F.sum(n).alias(n) for n in names), F.sum("added").alias("added_issues"), F.sum("removed").alias("removed_issues"), count_if((F.col("added") > 0) & (F.col("removed") == 0)).alias("late_additions"))
    n = pairs.groupBy(*SPRINT).agg(F.count("*").alias("observations"))
    j = n.join(s, SPRINT, "left").fillna(0).join(opening, SPRINT)
    churn = F.col("added_points") + F.col("removed_points") + F.abs("reestimated_points")
    j = j.withColumn("net_points", F.col("added_points") - F.col("removed_points") + F.col("reestimated_points"))
    return j.withColumn("churn_rate", F.round(F.when(F.col("opening") > 0, churn / F.col("opening")), 6))


def burndown(day, day_issue, day_member, day_sprint) -> DataFrame:
    """Committed, done and remaining work of each active sprint on each day on which it was
    there or had issues, and what an even pace would leave (null without usable dates)."""
    active = active_sprints(day, day_sprint)
    there = day_sprint.join(active.select(*SPRINT), SPRINT, "left_semi").select(*SPRINT, "d")
    rows = members(day_issue, day_member, active)
    g = rows.groupBy(*SPRINT, "d").agg(total(points()).alias("committed"), total(F.when(done(), points())).alias("done"), F.count("*").alias("issues"), count_if(~done()).alias("open_issues"))
    g = there.union(rows.select(*SPRINT, "d")).distinct().join(g, [*SPRINT, "d"], "left").fillna(0)
    g = g.join(active, SPRINT).join(day.select("team", "d", "seen"), ["team", "d"])
    gone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), days_between("start_ts", "seen") / days_between("start_ts", "end_ts")))
    ideal = F.when(F.col("end_ts") > F.col("start_ts"), F.col("committed") * (1 - gone))
    return g.select(*SPRINT, "d", "committed", "done", (F.col("committed") - F.col("done")).alias("remaining"), "issues", "open_issues", F.round(ideal, 6).alias("ideal"))


def cycle_times(day, day_issue) -> DataFrame:
    """From the start of the first day seen in progress to the resolution, of the issues of
    a team's last day; censored if that first day is the first of the series."""
    rows = day_issue.join(spans(day), "team").join(day.select("team", "d", "date"), ["team", "d"])
    last = F.col("d") == F.col("hi")
    g = rows.groupBy("team", "key").agg(
        F.min(F.when(F.col("category") == "In Progress", F.struct("d", "date"))).alias("first"), F.first("lo").alias("lo"),
        F.max(F.when(last, F.col("resolved"))).alias("resolved"), F.max(F.when(last, F.col("created"))).alias("created"),
    )
    cycle = days_between(F.col("first.date").cast("timestamp_ntz"), "resolved")
    lead = F.round(days_between("created", "resolved"), 6).alias("lead_days")
    out = g.select("team", "key", F.round(cycle, 6).alias("cycle_days"), lead, (F.col("first.d") == F.col("lo")).alias("censored"), "resolved")
    return out.where("cycle_days >= 0")


def cycle_summary(cycles: DataFrame) -> DataFrame:
    seen = lambda c: F.when(~F.col("censored"), F.col(c))
    wait = F.when(F.col("lead_days") >= F.col("cycle_days"), F.col("lead_days") - F.col("cycle_days"))
    g = cycles.groupBy("team").agg(F.count(seen("cycle_days")).alias("basis"), count_if(F.col("censored")).alias("censored"))
    p = percentiles(cycles, ["team"], {"cycle": (seen("cycle_days"), {"p50": 0.5, "p90": 0.9}), "wait": (F.when(~F.col("censored"), wait), {"median_wait": 0.5})})
    return g.join(p, "team", "left")


def recent_cycles(cycles: DataFrame, n: int = 300) -> DataFrame:
    """The latest n resolved of each team, with how many earlier ones are left out."""
    by = W.partitionBy("team").orderBy(F.desc("resolved"), F.desc("cycle_days"), "key")
    kept = cycles.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
    left_out = cycles.groupBy("team").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("omitted"))
    return kept.join(left_out, "team").select("team", "rank", "key", F.round("cycle_days", 2).alias("cycle_days"), "censored", "omitted")


def placed(day_issue: DataFrame, day_column: DataFrame) -> DataFrame:
    """Issues with their column as of each day: the first that claims their status, the
    status itself on a board without columns, else off the board."""
    claimed = day_column.groupBy("team", "d", "status_id").agg(F.min_by("col", "col_pos").alias("claimed"))
    has = day_column.select("team", "d").distinct().withColumn("has", F.lit(True))
    rows = day_issue.join(claimed, ["team", "d", "status_id"], "left").join(has, ["team", "d"], "left")
    return rows.withColumn("col", F.when(F.col("has").isNull(), F.col("status_id")).otherwise(F.coalesce("claimed", F.lit(OFF_BOARD))))


def column_dwell(day, day_issue, day_member, day_sprint, day_column) -> DataFrame:
    """How long each open issue of an active sprint has been in its column: since the start
    of the first day of the run of days that ends on the last one. A day without the issue
    ends the run; one that reaches the first day of several is censored. An issue's days are
    gathered once and walked back from the last."""
    ends = active_sprints(day, day_sprint).join(spans(day), "team").select(*SPRINT, F.col("hi").alias("d"))
    last = day_member.join(F.broadcast(ends), [*SPRINT, "d"], "left_semi").select("team", "key").distinct()
    rows = placed(day_issue.join(last, ["team", "key"], "left_semi"), day_column)
    days = F.reverse(F.array_sort(F.collect_list(F.struct("d", "col", done().alias("done")))))
    g = rows.groupBy("team", "key").agg(days.alias("days")).join(spans(day), "team").where("days[0].d = hi and not days[0].done")
    same = lambda x, i: (x["d"] == F.col("hi") - i) & (x["col"] == F.col("days")[0]["col"])
    first_other = F.array_position(F.transform("days", lambda x, i: ~F.coalesce(same(x, i), F.lit(False))), True)
    run = F.when(first_other == 0, F.size("days")).otherwise(first_other - 1).cast("int")
    g = g.select("team", "key", F.col("days")[0]["col"].alias("col"), "lo", "hi", (F.col("hi") - run + 1).alias("d"))
    at = day.select("team", "d", F.col("date").alias("since"))
    g = g.join(at, ["team", "d"]).join(day.select("team", F.col("d").alias("hi"), F.col("seen").alias("now")), ["team", "hi"])
    censored = (F.col("d") == F.col("lo")) & (F.col("hi") > F.col("lo"))
    return g.select("team", "key", "col", F.round(days_between(F.col("since").cast("timestamp_ntz"), "now"), 6).alias("dwell_days"), censored.alias("censored"))


def column_ages(dwell: DataFrame) -> DataFrame:
    """Ageing of each column, without its issues."""
    v = F.when(~F.col("censored"), F.col("dwell_days"))
    g = dwell.groupBy("team", "col").agg(F.count("*").alias("n"), F.count(v).alias("basis"), count_if(F.col("censored")).alias("censored"))
    g = g.join(percentiles(dwell, ["team", "col"], {"dwell": (v, {"p50": 0.5, "p90": 0.9})}), ["team", "col"], "left")
    return g.withColumn("reportable", F.col("p50").isNotNull() & (F.col("basis") >= LEAST_BASIS))


def column_dwell_summary(dwell: DataFrame) -> DataFrame:
    """Ageing of each column, with its oldest issues, the longest there first."""
    g = column_ages(dwell)
    rank = F.row_number().over(W.partitionBy("team", "col").orderBy(F.desc("dwell_days"), "key"))
    first = dwell.withColumn("r", rank).where(F.col("r") <= OLDEST).groupBy("team", "col")
    oldest = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda x: x["key"]), ",").alias("oldest"))
    return g.join(oldest, ["team", "col"]).select(*(c for c in g.columns if c != "reportable"), "oldest", "reportable")


def cumulative_flow(day, day_issue, day_member, day_sprint, day_column) -> DataFrame:
    """Issues of each team's primary sprint by day and column, on the axis of the last day's
    columns, empty ones included. What has no place there is off the board, a band that is
    left out where it stays empty. Teams without columns have no flow. The issues of all active
    sprints are read once, counted by day and column, and gathered as a row for each sprint, of
    which the one with most points on the last day is the primary one, as in primary_sprints."""
    active = active_sprints(day, day_sprint).select(*SPRINT)
    axis = day_column.join(spans(day), "team").where("d = hi").groupBy("team", "col").agg(F.min("col_pos").alias("col_pos"))
    on_axis = placed(members(day_issue, day_member, active), day_column).join(F.broadcast(axis.select("team", "col", F.lit(True).alias("known"))), ["team", "col"], "left")
    at = F.when(F.col("known"), F.col("col")).otherwise(F.lit(OFF_BOARD)).alias("col")
    n = on_axis.groupBy(*SPRINT, "d", at).agg(F.count("*").alias("n"), total(points()).alias("points"))
    there = day_sprint.join(F.broadcast(active), SPRINT, "left_semi").select(*SPRINT, "d", F.lit(None).cast("string").alias("col"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("points"))
    by_day = n.union(there).groupBy(*SPRINT, "d").agg(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "n"))).alias("found"), F.sum("points").alias("points"))

    held = by_day.join(F.broadcast(spans(day)), "team").groupBy(*SPRINT).agg(F.sum(F.when(F.col("d") == F.col("hi"), F.col("points")).otherwise(0)).alias("committed"), F.collect_list(F.struct("d", "found")).alias("days"))
    rank = F.row_number().over(W.partitionBy("team").orderBy(F.desc("committed"), "sprint_id"))
    primary = held.withColumn("r", rank).where("r = 1").select(*SPRINT, "days")
    bands = axis.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("col_pos", "col"))).alias("bands"))
    off = F.struct(F.lit(2**31 - 1).alias("col_pos"), F.lit(OFF_BOARD).alias("col"))
    used = F.exists("days", lambda x: F.exists(x["found"], lambda y: y["col"] == OFF_BOARD))
    grid = primary.join(bands, "team").withColumn("bands", F.when(used, F.concat("bands", F.array(off))).otherwise(F.col("bands")))
    ranks = F.array_sort(F.array_distinct(F.transform("bands", lambda b: b["col_pos"])))
    grid = grid.withColumn("ranks", ranks).withColumn("day", F.explode("days")).withColumn("band", F.explode("bands"))
    count = F.coalesce(F.get(F.filter(F.col("day.found"), lambda y: y["col"] == F.col("band.col")), F.lit(0))["n"], F.lit(0)).cast("long")
    return grid.select(*SPRINT, F.col("day.d").alias("d"), F.array_position("ranks", F.col("band.col_pos")).cast("int").alias("place"), F.col("band.col").alias("col"), count.alias("n"))


def flow_on(axis: DataFrame, there: DataFrame, n: DataFrame) -> DataFrame:
    """Counts n(team, sprint_id, d, col, n) of the days that are there, on the axis of columns
    (team, col, col_pos); empty ones are there with zero."""
    bands = axis.union(axis.select("team", F.lit(OFF_BOARD), F.lit(2**31 - 1)).distinct())
    grid = there.join(bands, "team").join(n, [*SPRINT, "d", "col"], "left").fillna(0, ["n"])
    used = n.select("team", "col").distinct().withColumn("used", F.lit(True))
    kept = grid.join(used, ["team", "col"], "left").where((F.col("col") != OFF_BOARD) | F.col("used"))
    place = F.dense_rank().over(W.partitionBy("team").orderBy("col_pos"))
    return kept.withColumn("place", place).select(*SPRINT, "d", "place", "col", "n")


def flow_growth(flow: DataFrame) -> DataFrame:
    """The column before the last of the board that grew most from the first day of a flow
    to its last, and how much the scope grew. A team's flow, which is small, is read once."""
    w, d = W.partitionBy("team"), F.col("d")
    ends = flow.withColumn("lo", F.min("d").over(w)).withColumn("hi", F.max("d").over(w)).withColumn("end", F.max(F.when(F.col("col") != OFF_BOARD, F.col("place"))).over(w))
    change = F.when(d == F.col("hi"), F.col("n")).otherwise(0) - F.when(d == F.col("lo"), F.col("n")).otherwise(0)
    g = ends.where("end is not null").groupBy("team", "col", "place", "end").agg(F.sum(change).alias("grew"))
    most = F.max(F.when(F.col("place") < F.col("end"), F.struct("grew", (-F.col("place")).alias("p"), "col")))
    return g.groupBy("team").agg(most.alias("m"), F.sum("grew").alias("scope")).select("team", F.col("m.col").alias("col"), F.col("m.grew").alias("grew"), "scope")


def team_history(day, day_issue, day_member, day_sprint, day_column, slowest: int = 10) -> DataFrame:
    """A row for each team: the days it was seen, the hours between its first and last
    capture, its primary sprint with churn and flow, and its cycle times."""
    ends = day.groupBy("team").agg(F.count("*").alias("days"), F.min(F.struct("d", "date", "seen")).alias("a"), F.max(F.struct("d", "date", "seen")).alias("b"))
    hours = F.when(F.col("days") > 1, js_round(hours_between("a.seen", "b.seen"), 1))
    rows = ends.select("team", "days", F.col("a.date").alias("observed_from"), F.col("b.date").alias("observed_to"), hours.alias("observed_hours"))
    primary = primary_sprints(day, day_issue, day_member, day_sprint).select(*SPRINT)
    churn = churn_summary(day, day_issue, day_member, day_sprint).join(primary, SPRINT, "left_semi")
    flow = cumulative_flow(day, day_issue, day_member, day_sprint, day_column).groupBy("team").agg((F.min("d") == 0).alias("flow_censored"))
    cycles = cycle_times(day, day_issue)
    rank = F.row_number().over(W.partitionBy("team").orderBy(F.desc("cycle_days"), "key"))
    worst = cycles.where(~F.col("censored")).withColumn("r", rank).where(F.col("r") <= slowest).groupBy("team")
    worst = worst.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda x: x["key"]), ",").alias("slowest"))
    summary = cycle_summary(cycles).select("team", F.col("p50").alias("cycle_p50"), F.col("basis").alias("cycle_basis"))
    out = rows.join(primary, "team", "left").join(churn.select(*SPRINT, "observations", "churn_rate", "net_points", "late_additions"), SPRINT, "left")
    return out.join(flow, "team", "left").join(summary, "team", "left").join(worst, "team", "left")
