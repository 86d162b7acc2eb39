"""An estate as a tree of groups, by prefixes, with sums that count each person once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = "/"


def tree(board: DataFrame, member: DataFrame, finding: DataFrame, estate: str = "estate") -> DataFrame:
    """node, parent, kind, depth, children, boards, people and acts of each node: the estate,
    its groups, and its boards.

    board(team, path): path holds the names of a board's groups from the top down, and may be
    empty or null. member(team, person), finding(team, severity). A level none of whose groups
    has several children groups nothing and is left out; its children move up. People are
    distinct over all boards below a node; acts are the findings that cannot wait. A board's
    rows meet each of its groups once, so a level costs a row for each board and person, and
    no group's people come together in one place.
    """
    board = board.groupBy("team").agg(F.min(F.coalesce("path", F.array().cast("array<string>"))).alias("path"))
    steps = board.select("team", "path", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("level"))
    at = lambda n: F.slice("path", 1, n)
    steps = steps.select("team", "level", at(F.col("level")).alias("group"), F.when(F.col("level") < F.size("path"), F.array_join(at(F.col("level") + 1), SEP)).otherwise(F.concat(F.lit(":"), "team")).alias("child"))
    fan = steps.groupBy("level", "group").agg(F.count_distinct("child").alias("n"))
    kept = fan.groupBy("level").agg(F.max("n").alias("n")).where("level = 0 or n > 1").select("level")  # a row a level
    kept = kept.agg(F.array_sort(F.collect_list("level")).alias("levels"))
    steps = steps.crossJoin(F.broadcast(kept)).where("array_contains(levels, level)")  # one row

    name = lambda g: F.when(F.size(g) == 0, F.lit(estate)).otherwise(F.concat(F.lit(estate + SEP), F.array_join(g, SEP)))
    above = F.array_max(F.filter("levels", lambda x: x < F.col("level")))
    groups = steps.select("team", "group", "level", above.alias("above"), "levels")
    # boards hang under their deepest group that is drawn
    deepest = groups.groupBy("team").agg(F.max_by("group", "level").alias("group"), F.max("level").alias("above"))
    nodes = groups.select("team", name("group").alias("node"), F.when(F.col("level") > 0, name(F.slice("group", 1, F.coalesce("above", F.lit(0))))).alias("parent"), "level", F.when(F.col("level") == 0, "estate").otherwise("group").alias("kind"))
    leaves = deepest.select("team", F.concat(name("group"), F.lit(":"), "team").alias("node"), name("group").alias("parent"), (F.col("above") + 1).alias("level"), F.lit("board").alias("kind"))
    rows = nodes.union(leaves)

    once = rows.select("team", "node").join(member.where("person is not null").select("team", "person").distinct(), "team").select("node", "person").distinct()
    people = once.groupBy("node").agg(F.count("*").alias("people"))
    loud = finding.where("severity = 'act-now'").groupBy("team").agg(F.count("*").alias("acts"))
    sums = rows.join(loud, "team", "left").groupBy("node", "parent", "kind").agg(F.count("*").alias("boards"), F.coalesce(F.sum("acts"), F.lit(0)).alias("acts"), F.min("level").alias("level"))
    children = sums.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    out = sums.join(people, "node", "left").join(children, "node", "left").fillna(0, ["people", "children"])
    return out.select("node", "parent", "kind", F.col("level").cast("int").alias("level"), "children", "boards", "people", "acts")


def by_prefix(board: DataFrame) -> DataFrame:
    """Groups of boards by prefix, the largest first: prefix, boards, and turn, their order.
    board(team, prefix); boards without one are groups of their own. A row for each group."""
    g = board.groupBy(F.coalesce("prefix", "team").alias("prefix")).agg(F.count_distinct("team").alias("boards"))
    return g.orderBy(F.desc("boards"), "prefix")
