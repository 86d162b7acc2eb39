"""Upkeep of snapshots: coverage, teams a rewrite would lose, archiving, logs and messages."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import snapshots

#: The schema that snapshots are written with now, and the names of a day's files.
SCHEMA_VERSION = 4
NAMES = ("jira", "gitlab", "github", "context")
MESSAGE_CHARS = 3800


def schema_status(boards: DataFrame) -> DataFrame:
    """The schema that each day was written with, and whether it is behind."""
    return boards.select("snapshot_date", F.col("schemaVersion").alias("found"), F.lit(SCHEMA_VERSION).alias("expected"), F.coalesce(F.col("schemaVersion") < SCHEMA_VERSION, F.lit(False)).alias("behind"))


CONTEXT = "schemaVersion int, capturedAt string, teams array<struct<key:string,pages:array<struct<id:string>>>>"


def coverage_gaps(boards: DataFrame, requests: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """What a day of the current schema was collected without: titles of issues, detail of
    active issues (null comments; none at all) and epics of boards; reviews of any merge
    request; wiki pages of any team. Counted inside rows."""
    found = _board_gaps(boards)
    n = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    for df, what, items, held in (
        (requests, "reviews", lambda t: t["mergeRequests"], lambda m: m["review"].isNotNull()),
        (context, "pages", lambda t: F.array(t), lambda t: F.coalesce(F.size(t["pages"]), F.lit(0)) > 0),
    ):
        if df is not None:
            known = df.where(F.col("schemaVersion") >= SCHEMA_VERSION - 1) if what == "reviews" else df
            t = known.select("snapshot_date", F.explode("teams").alias("t")).select("snapshot_date", F.lit(what).alias("what"), n(F.filter(items(F.col("t")), held)).alias("present"), n(items(F.col("t"))).alias("total"))
            found = found.unionByName(t.groupBy("snapshot_date", "what").agg(F.sum("present").alias("present"), F.sum("total").alias("total")).where("total > 0 and present = 0"))
    return found


def _board_gaps(boards: DataFrame) -> DataFrame:
    t = boards.where(F.col("schemaVersion") >= SCHEMA_VERSION).select("snapshot_date", F.explode("teams").alias("t")).select("snapshot_date", "t.*")
    active = F.transform(F.filter("sprints", lambda s: F.lower(s["state"]) == "active"), lambda s: s["id"])
    inside = F.filter("issues", lambda i: F.coalesce(F.arrays_overlap(i["sprintIds"], active), F.lit(False)))
    n = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    parts = {
        "titles": (n(F.filter("issues", lambda i: i["summary"].isNotNull())), n(F.col("issues"))),
        "detail": (n(F.filter(inside, lambda i: i["comments"].isNotNull())), n(inside)),
        "epics": (F.col("epics").isNotNull().cast("long"), F.lit(1).cast("long")),
    }
    rows = t.select("snapshot_date", F.explode(F.array(*(F.struct(F.lit(w).alias("what"), p.alias("present"), x.alias("total")) for w, (p, x) in parts.items()))).alias("g")).select("snapshot_date", "g.*")
    g = rows.groupBy("snapshot_date", "what").agg(F.sum("present").alias("present"), F.sum("total").alias("total")).where("total > 0")
    return g.where(F.when(F.col("what") == "detail", F.col("present") == 0).otherwise(F.col("present") < F.col("total")))


def dropped_teams(existing: DataFrame, collecting: DataFrame, key: str = "team") -> DataFrame:
    """Teams of a day that a forced rewrite with other teams would delete."""
    return existing.select(key).distinct().join(collecting.select(key).distinct(), key, "left_anti")


def archive(spark: SparkSession, root: str, as_of: datetime.date, older_than_days: int = 90, dry_run: bool = False) -> list[tuple[str, str, int]]:
    """Compress the plain files of days before the cutoff: (day, name, bytes before). One
    job writes all of them beside the snapshots; then each takes its place by a rename, and
    only then is the plain file deleted, so that a failure leaves every day readable."""
    cutoff = (as_of - datetime.timedelta(days=older_than_days)).isoformat()
    found = []
    for day in snapshots.dates(spark, root):
        for name in NAMES if day < cutoff else ():
            fs, p = snapshots._fs(spark, f"{root}/{day}/{name}.json")
            if fs.exists(p):
                found.append((day, name, fs.getFileStatus(p).getLen()))
    if dry_run or not found:
        return found
    staging = f"{root}/_archiving"
    files = spark.read.text([f"{root}/{d}/{n}.json" for d, n, _ in found], wholetext=True)
    path = F.input_file_name()
    files = files.select("value", F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1).alias("day"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("name"))
    files.write.mode("overwrite").option("compression", "gzip").partitionBy("day", "name").text(staging)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for day, name, _ in found:
        fs, p = snapshots._fs(spark, f"{staging}/day={day}/name={name}")
        part = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
        if fs.rename(part, path_of(f"{root}/{day}/{name}.json.gz")):
            fs.delete(path_of(f"{root}/{day}/{name}.json"), False)
    fs.delete(path_of(staging), True)
    return found


def upsert_log(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A log of findings, worst first: a new row replaces those of its date, team and
    finding at the place of the first; others are appended. Both tables: date, team,
    finding, severity (a number), text, pos (place in its table)."""
    by = ["date", "team", "finding"]
    first = lambda df: df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("pos")))
    new = first(new).where("n = 1").drop("n")
    old = first(existing).join(new.select(*by, F.col("severity").alias("s"), F.col("text").alias("t"), F.lit(True).alias("hit")), by, "left").where("hit is null or n = 1")
    kept = old.select(*by, F.when(F.col("hit"), F.col("s")).otherwise(F.col("severity")).alias("severity"), F.when(F.col("hit"), F.col("t")).otherwise(F.col("text")).alias("text"), F.lit(0).alias("part"), "pos")
    added = new.join(existing, by, "left_anti").select(*by, "severity", "text", F.lit(1).alias("part"), "pos")
    return kept.unionByName(added).orderBy(F.desc("severity"), "part", "pos")


def chunks(text: str, most: int = MESSAGE_CHARS) -> list[str]:
    """A message in parts of at most `most` characters, cut at line ends; a line that is
    longer is cut where it must be."""
    parts, held = [], ""
    for line in text.split("\n"):
        if held and len(held) + 1 + len(line) <= most:
            held += "\n" + line
            continue
        if held:
            parts.append(held)
        cut = max(0, (len(line) - 1) // most) * most
        parts.extend(line[a : a + most] for a in range(0, cut, most))
        held = line[cut:]
    return parts + [held] if held else parts or [text]
