"""Which board a forge group belongs to, by issue keys and by people.

Tables: merge_request(grp, mr, author, bot, title, branch) with grp a path such as a/b;
issue(team, key, assignee, updated). Only pairs with evidence are formed: keys, prefixes and
tokens of names are joined on, groups are never crossed with boards.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from ..functions.core import days_between, issue_keys, total

#: What carries a proposal alone, and what the other axis must show at least.
STRONG_KEYS, STRONG_AUTHORS, MIN_KEYS, MIN_AUTHORS, MIN_SHARE, DOMINANCE = 5, 3, 1, 1, 0.25, 2
RECENT_DAYS, MIN_RECENT = 90, 5


def normal_name(name: Column) -> Column:
    """Without accents and case, other signs as spaces. Spark has no NFKD, so that step is a
    small Arrow function; it is nested so that workers need not import this package."""

    def plain(names: pd.Series) -> pd.Series:
        decomposed = names.str.normalize("NFKD")
        return decomposed.str.replace("[\u0300-\u036f]", "", regex=True)

    bare = F.pandas_udf(plain, StringType())(name)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9 ]+", " "), " +", " "))


def assignees(issue: DataFrame, as_of: Column) -> DataFrame:
    """Each board's people: the recently active ones, or all if those are too few."""
    # The name as a figure of its group: a filter on what a function makes of it stays above the
    # grouping, so that the function is asked for each person and not for each issue.
    names = issue.where("assignee is not null and team is not null").groupBy("team", "assignee")
    names = names.agg(F.max(days_between("updated", as_of) <= RECENT_DAYS).alias("recent"), F.min("assignee").alias("name"))
    n = names.groupBy("team").agg(F.count(F.when(F.col("recent"), F.col("name"))).alias("n"))
    return names.join(n, "team").where((F.col("n") < MIN_RECENT) | F.col("recent")).select("team", "name", F.when(F.col("n") >= MIN_RECENT, "recent").otherwise("all").alias("basis"))


def same_people(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a, b) of normalised names that mean one person: equal, of the same words, or
    sharing two words or more with one's words all in the other. Both tables: name."""

    def words(df, c):
        return df.select(F.col("name").alias(c)).where("name != ''").distinct().withColumn(f"{c}w", F.split(c, " "))

    x, y = words(a, "a"), words(b, "b")
    alike = x.withColumn("s", F.array_sort("aw")).join(y.withColumn("s", F.array_sort("bw")), "s").select("a", "b")

    def couples(df, c):
        w = F.array_sort(F.array_distinct(f"{c}w"))
        both = F.flatten(F.transform(w, lambda s, i: F.transform(F.slice(w, i + 2, F.greatest(F.size(w) - i - 1, F.lit(0))), lambda t: F.concat_ws(" ", s, t))))
        return df.select(c, f"{c}w", F.explode(both).alias("couple"))

    shared = F.size(F.array_intersect("aw", "bw"))
    inside = (shared == F.size(F.array_distinct("aw"))) | (shared == F.size(F.array_distinct("bw")))
    near = couples(x, "a").join(couples(y, "b"), "couple").where(inside).select("a", "b")
    return alike.union(near).distinct()


def axis_scores(mr: DataFrame, issue: DataFrame, people: DataFrame) -> DataFrame:
    """grp, team, key_hits, prefix_hits, authors, share of the pairs with any evidence."""
    keys = mr.select("grp", "mr", F.explode(issue_keys(F.col("title"), F.col("branch"))).alias("key"))
    hits = keys.join(issue.select("team", "key").distinct(), "key").select("grp", "team", "mr").distinct()
    prefix = F.regexp_extract("key", "^(.+)-[^-]*$", 1).alias("prefix")
    boards = issue.select("team", prefix).distinct()
    near = keys.select("grp", "mr", prefix).join(boards, "prefix").select("grp", "team", "mr").distinct().join(hits, ["grp", "team", "mr"], "left_anti")
    human = mr.where(~F.col("bot")).groupBy("grp", "author").agg(F.min("author").alias("said")).select("grp", normal_name(F.col("said")).alias("name")).where("name != ''").distinct()
    staff = people.select("team", normal_name(F.col("name")).alias("name")).distinct()
    pairs = same_people(human, staff)
    met = human.withColumnRenamed("name", "a").join(pairs, "a").join(staff.withColumnRenamed("name", "b"), "b").select("grp", "team", "a").distinct()
    one = lambda df, c: df.select("grp", "team", *(F.lit(int(c == x)).cast("long").alias(x) for x in ("key_hits", "prefix_hits", "authors")))
    rows = one(hits, "key_hits").union(one(near, "prefix_hits")).union(one(met, "authors"))
    g = rows.groupBy("grp", "team").agg(*(total(F.col(c)).alias(c) for c in ("key_hits", "prefix_hits", "authors")))
    n = human.groupBy("grp").agg(F.count("*").alias("humans"))
    return g.join(n, "grp", "left").withColumn("share", F.round(F.coalesce(F.col("authors") / F.col("humans"), F.lit(0.0)), 6)).drop("humans")


def suggest(mr: DataFrame, issue: DataFrame, people: DataFrame) -> DataFrame:
    """A verdict for every group: propose, possible, shared or none, with the best board
    and, for a proposal, the nearest parent group that is proposed for the same board."""
    s = axis_scores(mr, issue, people)
    best = W.partitionBy("grp").orderBy(F.desc("key_hits"), F.desc("authors"), F.desc("share"), "team")
    by_author = W.partitionBy("grp").orderBy(F.desc("authors"), F.desc("share"), "team")
    s = s.withColumn("place", F.row_number().over(best)).withColumn("author_place", F.row_number().over(by_author))
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    g = s.groupBy("grp").agg(
        first("team").alias("best"), first("key_hits").alias("key_hits"), first("authors").alias("authors"), first("share").alias("share"),
        F.max(F.when(F.col("place") == 2, F.col("key_hits"))).alias("next_hits"), F.max(F.when(F.col("author_place") == 1, F.struct("team", "authors"))).alias("top_author"),
        F.count_if((F.col("key_hits") > 0) | (F.col("authors") > 0)).alias("boards"),
        F.min_by(F.when(F.col("key_hits") > 0, F.col("team")), F.when(F.col("key_hits") > 0, F.struct(-F.col("key_hits"), "team"))).alias("top_keys"),
    )
    k, a = F.col("key_hits"), F.col("authors")
    both = (k > 0) & (F.col("top_author.authors") > 0)
    agree = both & (F.col("top_keys") == F.col("top_author.team"))
    clear = F.coalesce(F.col("next_hits"), F.lit(0)) * DOMINANCE <= k
    strong = ((k >= STRONG_KEYS) & (a >= MIN_AUTHORS)) | ((a >= STRONG_AUTHORS) & (k >= MIN_KEYS))
    verdict = F.when((F.col("boards") >= 3) & (k < 3) & (a <= 2), "shared").when(agree & clear & (F.col("share") >= MIN_SHARE) & strong, "propose").when((F.col("boards") > 0), "possible").otherwise("none")
    rows = mr.groupBy("grp").agg(F.count_distinct("mr").alias("mrs")).join(g.withColumn("verdict", verdict), "grp", "left")
    rows = rows.select("grp", "mrs", "best", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("key_hits", "authors", "share")), F.coalesce("verdict", F.lit("none")).alias("verdict"))
    return rows.join(_parents(rows.where("verdict = 'propose'")), "grp", "left")


def _parents(proposed: DataFrame) -> DataFrame:
    """grp, covered_by: the longest proposed path above it, met by equal prefixes."""
    parts = F.split("grp", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = proposed.where(F.contains(F.col("grp"), F.lit("/"))).select("grp", "best", F.explode(above).alias("path"))
    there = proposed.select(F.col("grp").alias("path"), "best")
    return up.join(there, ["path", "best"]).groupBy("grp").agg(F.max_by("path", F.length("path")).alias("covered_by"))


def board_of_prefix(board: DataFrame) -> DataFrame:
    """prefix and team: of the configured boards that have a prefix the first. board(team,
    pos, prefixes): pos is the place of a board in the configuration."""
    each = board.select("team", "pos", F.explode("prefixes").alias("prefix"))
    return each.groupBy("prefix").agg(F.min_by("team", F.struct("pos", "team")).alias("team"))


def prefix_evidence(mr: DataFrame, board: DataFrame) -> DataFrame:
    """grp, prefix, mentions and team: the prefixes that a group's requests name, how often,
    and the first configured board that has each (null: none)."""
    keys = mr.select("grp", "mr", F.explode(issue_keys(F.col("title"), F.col("branch"))).alias("key"))
    n = keys.groupBy("grp", F.regexp_extract("key", "^(.+)-[^-]*$", 1).alias("prefix")).agg(F.count("*").alias("mentions"))
    return n.join(board_of_prefix(board), "prefix", "left").select("grp", "prefix", "mentions", "team")
