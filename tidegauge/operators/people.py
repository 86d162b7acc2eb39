"""People across the issue tracker and the forge, met by their trimmed name in lower case.

Tables: merge_request(mr, team, author, bot, merged, reviewed, project), given(mr, team,
person): humans who commented on or approved another's merge request, once each; or, with a
column given, how many requests that were, mr being the first where its spelling matters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import count_if, days_between, done, points, total
from .delivery import in_active

MEASURES = ("open_assigned", "open_in_active", "open_points", "flagged", "resolved_recently", "reported_recently", "authored", "merged", "reviews_given")


def name_key(name: Column | str) -> Column:
    return F.lower(F.trim(name))


def _rows(df: DataFrame, name: str, pos: Column, tracker: bool, project: Column | None = None, **measures: Column) -> DataFrame:
    n = [F.coalesce(measures[m].cast("long"), F.lit(0)).alias(m) if m in measures else F.lit(0).cast("long").alias(m) for m in MEASURES]
    named = df.where(F.trim(name) != "")
    return named.select("team", F.col(name).alias("name"), pos.cast("long").alias("pos"), F.lit(tracker).alias("tracker"), (F.lit(None).cast("string") if project is None else project).alias("project"), *n)


def roster(issue, issue_sprint, sprint, mr: DataFrame, given: DataFrame, as_of: Column, recent_days: int = 30) -> DataFrame:
    """What each person of a team is assigned, resolved, reported, authored and reviewed.
    All sources become rows with the same measures, so one grouping by name joins them.
    issue has a reporter. A person's name is spelled as it is met first."""
    active = in_active(issue, issue_sprint, sprint).select("team", "key", F.lit(True).alias("active"))
    rows = issue.join(active, ["team", "key"], "left")
    recent = lambda c: F.coalesce(days_between(c, as_of) <= recent_days, F.lit(False))
    is_open, at = ~done(), F.col("pos")
    parts = [
        _rows(rows, "assignee", at, True, open_assigned=is_open, open_in_active=is_open & F.col("active"), open_points=F.when(is_open, points()), flagged=is_open & F.col("flagged"), resolved_recently=done() & recent("resolved")),
        _rows(rows.where(recent("created")), "reporter", at, True, reported_recently=F.lit(1)),
        _rows(mr.where(~F.col("bot")), "author", F.col("mr"), False, F.col("project"), authored=F.lit(1), merged=F.col("merged").isNotNull()),
        _rows(given, "person", F.col("mr"), False, reviews_given=F.col("given") if "given" in given.columns else F.lit(1)),
    ]
    g = reduce(DataFrame.unionByName, parts).groupBy("team", name_key("name").alias("person")).agg(
        F.min(F.struct(~F.col("tracker"), "pos", "name"))["name"].alias("name"), *(F.sum(m).alias(m) for m in MEASURES),
        F.bool_or("tracker").alias("on_board"), F.bool_or(~F.col("tracker")).alias("on_forge"), F.count_distinct("project").alias("projects"),
    )
    return g.withColumn("tracker_only", ~F.col("on_forge")).withColumn("forge_only", ~F.col("on_board")).drop("on_board", "on_forge")


def roster_totals(members: DataFrame, issue, issue_sprint, sprint) -> DataFrame:
    """People with active work, and open active work that is nobody's."""
    n = members.groupBy("team").agg(F.count("*").alias("people"), count_if(F.col("open_in_active") > 0).alias("active_people"))
    free = in_active(issue, issue_sprint, sprint).where(~done() & F.col("assignee").isNull()).groupBy("team").agg(F.count("*").alias("unassigned"))
    return n.join(free, "team", "left").fillna(0, ["unassigned"])


def estate_people(members: DataFrame, mr: DataFrame, given: DataFrame) -> DataFrame:
    """People over all boards. Issue counts add up over boards; points do not, since boards
    size work by scales of their own. Merge requests count once, whichever board has them."""
    once = mr.groupBy("mr").agg(F.min(F.struct("author", "bot", "merged", "reviewed")).alias("m")).select("mr", "m.*").where(~F.col("bot") & (F.trim("author") != ""))
    own = once.groupBy(name_key("author").alias("person")).agg(F.count("*").alias("authored"), count_if(F.col("merged").isNotNull()).alias("merged"), count_if(F.col("merged").isNotNull() & ~F.col("reviewed")).alias("merged_unreviewed"))
    reviews = given.where(F.trim("person") != "").groupBy(name_key("person").alias("person")).agg((F.sum("given") if "given" in given.columns else F.count_distinct("mr")).alias("reviews_given"))
    forge = own.join(reviews, "person", "full").withColumn("on_forge", F.lit(True))
    sums = ("open_assigned", "open_in_active", "flagged", "resolved_recently", "reported_recently")
    board = members.groupBy("person").agg(F.count("*").alias("boards"), count_if(F.col("open_in_active") > 0).alias("active_boards"), count_if(F.col("open_assigned") > 0).alias("boards_with_work"), *(total(F.col(c)).alias(c) for c in sums)).withColumn("on_board", F.lit(True))
    j = board.join(forge, "person", "full").fillna(0).fillna(False, ["on_board", "on_forge"])
    return j.withColumn("tracker_only", ~F.col("on_forge")).withColumn("forge_only", ~F.col("on_board")).drop("on_board", "on_forge")


def most_discussed(issue: DataFrame, n: int = 10) -> DataFrame:
    """Open issues by their comments; those whose comments are unknown or none are left out."""
    from .delivery import top

    rows = issue.where(~done() & (F.col("comment_count") > 0))
    return top(rows, n, F.desc("comment_count"), "key").select("team", "rank", "key", "comment_count")
