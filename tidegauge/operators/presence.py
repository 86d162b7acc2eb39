"""Who was there over sprints, as runs: of each person the stretches of sprints in a row in
which they completed something. No sprint's people are gathered in one place.

Only the last closed sprints count, numbered 1, 2, ... by time in each team.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import exact, points, total
from .delivery import WINDOW, in_order, last_closed, sprint_members


def numbered(sprint: DataFrame, window: int = WINDOW) -> DataFrame:
    """team, sprint_id and n of the last closed sprints."""
    n = F.row_number().over(W.partitionBy("team").orderBy("place"))
    return last_closed(in_order(sprint), window).select("team", "sprint_id", n.alias("n"))


def present(issue, issue_sprint, sprint, closed: DataFrame) -> DataFrame:
    """team, n and person, once each. Issues that are nobody's say nothing of people."""
    rows = sprint_members(issue, issue_sprint, sprint).where("within and assignee is not null")
    return rows.join(closed, ["team", "sprint_id"]).select("team", "n", F.col("assignee").alias("person")).distinct()


def runs(there: DataFrame) -> DataFrame:
    """team, person, first and last of each run of sprints in a row; a person has at most as
    many as there are sprints in the window."""
    island = F.col("n") - F.row_number().over(W.partitionBy("team", "person").orderBy("n"))
    return there.withColumn("island", island).groupBy("team", "person", "island").agg(F.min("n").alias("first"), F.max("n").alias("last")).drop("island")


def composition(issue, issue_sprint, sprint, window: int = WINDOW) -> DataFrame:
    """Contributors and points of each of the last closed sprints; who joined and left since
    the one before. Nobody joins in the first."""
    closed = numbered(sprint, window)
    there = present(issue, issue_sprint, sprint, closed)
    each = runs(there)
    people = there.groupBy("team", "n").agg(F.count("*").alias("contributors"))
    joined = each.where("first > 1").groupBy("team", F.col("first").alias("n")).agg(F.count("*").alias("joined"))
    left = each.groupBy("team", (F.col("last") + 1).alias("n")).agg(F.count("*").alias("left_"))
    done = sprint_members(issue, issue_sprint, sprint).where("within").groupBy("team", "sprint_id").agg(total(points()).alias("points"))
    out = closed.join(people, ["team", "n"], "left").join(joined, ["team", "n"], "left").join(left, ["team", "n"], "left").join(done, ["team", "sprint_id"], "left")
    return out.fillna(0).select("team", "sprint_id", "contributors", "points", "joined", "left_")


def people_over_sprints(issue, issue_sprint, sprint, window: int = WINDOW) -> DataFrame:
    """Of each person: the sprints in which they completed something, the first and the last
    of them, runs, and whether they are in the latest."""
    closed = numbered(sprint, window)
    at = F.col("last") - F.col("first") + 1
    g = runs(present(issue, issue_sprint, sprint, closed)).groupBy("team", "person").agg(F.sum(at).alias("sprints"), F.count("*").alias("runs"), F.min("first").alias("first"), F.max("last").alias("last"))
    latest = closed.groupBy("team").agg(F.max("n").alias("latest"))
    name = lambda n, c: closed.select("team", F.col("n").alias(n), F.col("sprint_id").alias(c))
    j = g.join(latest, "team").join(name("first", "first_sprint"), ["team", "first"]).join(name("last", "last_sprint"), ["team", "last"])
    return j.select("team", "person", "sprints", "runs", "first_sprint", "last_sprint", (F.col("last") == F.col("latest")).alias("current"))


def contributors(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """The median of a team's contributors, over sprints that had any (at most a window's),
    and those of the latest. rows: composition."""
    n = rows.join(closed, ["team", "sprint_id"])
    some = F.when(F.col("contributors") > 0, F.col("contributors"))
    return n.groupBy("team").agg(exact(some, 0.5).alias("median_contributors"), F.max_by("contributors", "n").alias("latest_contributors"))
