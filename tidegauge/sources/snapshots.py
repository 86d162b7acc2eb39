"""Dated snapshots: immutable partitions of documents, read with one explicit schema.

Layout: <root>/<YYYY-MM-DD>/<name>.json, or .json.gz once archived. Missing fields read as
null; an empty array stays apart from a null one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PERSON = "struct<accountId:string,displayName:string,email:string>"
COMMENT = f"struct<id:string,author:{PERSON},created:string,updated:string,body:string,truncated:boolean>"
ISSUE = f"struct<key:string,id:string,issueType:string,summary:string,description:string,status:string,statusId:string,statusCategory:string,priority:string,resolution:string,resolutionDate:string,created:string,updated:string,dueDate:string,assignee:{PERSON},reporter:{PERSON},storyPoints:double,storyPointsField:string,epicKey:string,epicName:string,parentKey:string,rank:string,flagged:boolean,labels:array<string>,components:array<string>,sprintIds:array<bigint>,links:array<struct<type:string,direction:string,key:string>>,blockedBy:array<string>,blocks:array<string>,comments:array<{COMMENT}>,commentCount:bigint,inBacklog:boolean>"
SPRINT = "struct<id:bigint,name:string,state:string,goal:string,startDate:string,endDate:string,completeDate:string>"
TEAM = f"struct<key:string,boardId:bigint,boardName:string,boardType:string,columns:array<struct<name:string,statusIds:array<string>>>,sprints:array<{SPRINT}>,issues:array<{ISSUE}>,epics:array<struct<id:bigint,key:string,name:string,summary:string,done:boolean>>,errors:array<string>>"
BOARDS = f"schemaVersion int, source string, site string, capturedAt string, individualAttribution boolean, teams array<{TEAM}>"
SIGNALS = f"struct<authorIsAutomation:boolean,firstHumanCommentAt:string,firstAutomatedCommentAt:string,humanCommentCount:bigint,automatedCommentCount:bigint,humanCommenters:array<{PERSON}>,authorCommentCount:bigint,firstHumanApprovalAt:string,firstAutomatedApprovalAt:string,humanApprovalCount:bigint,automatedApprovalCount:bigint,humanApprovals:array<{PERSON}>,reviewerCount:bigint,error:string>"
REQUEST = f"struct<id:bigint,iid:bigint,projectPath:string,title:string,state:string,draft:boolean,createdAt:string,mergedAt:string,closedAt:string,sourceBranch:string,author:{PERSON},issueKeys:array<string>,webUrl:string,review:{SIGNALS}>"
REQUESTS = f"schemaVersion int, source string, capturedAt string, windowDays int, individualAttribution boolean, teams array<struct<key:string,groups:array<string>,mergeRequests:array<{REQUEST}>,errors:array<string>>>"
DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def dates(spark: SparkSession, root: str, up_to: str | None = None) -> list[str]:
    """The days that have a folder, in order; other names are skipped."""
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted(d for d in names if DAY.match(d) and (up_to is None or d <= up_to))


def _file(spark: SparkSession, root: str, day: str, name: str) -> str | None:
    """The day's file, the plain one before the archived one."""
    for end in (".json", ".json.gz"):
        fs, p = _fs(spark, f"{root}/{day}/{name}{end}")
        if fs.exists(p):
            return f"{root}/{day}/{name}{end}"
    return None


def read(spark: SparkSession, root: str, name: str = "jira", schema: str = BOARDS, up_to: str | None = None) -> DataFrame:
    """All days' documents up to a day, with snapshot_date; days without the file are left
    out rather than read as empty."""
    files = [f for d in dates(spark, root, up_to) if (f := _file(spark, root, d, name))]
    if not files:
        return spark.createDataFrame([], schema).withColumn("snapshot_date", F.lit(None).cast("date"))
    rows = spark.read.schema(schema).json(files, multiLine=True)
    return rows.withColumn("snapshot_date", F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1)))


def last_day(spark: SparkSession, root: str, name: str = "jira", before: str | None = None) -> str | None:
    """The latest day with the file, earlier than `before` if that is given: a day that was
    collected without it is no day on which nothing was there. Only names are read."""
    for day in reversed(dates(spark, root)):
        if (before is None or day < before) and _file(spark, root, day, name):
            return day
    return None


def read_day(spark: SparkSession, root: str, day: str, name: str = "jira", schema: str = BOARDS) -> DataFrame:
    """One day's document; no rows if the day has none."""
    file = _file(spark, root, day, name)
    rows = spark.read.schema(schema).json(file, multiLine=True) if file else spark.createDataFrame([], schema)
    return rows.withColumn("snapshot_date", F.lit(day).cast("date"))


def write(df: DataFrame, root: str, day: str, name: str, force: bool = False) -> None:
    """Write a day's document (one row) once, in the form that read() reads. A day that has
    it, plain or archived, is replaced only by force, and its projection with it. The new
    file is whole before the old one goes."""
    spark = df.sparkSession
    old = _file(spark, root, day, name)
    if old and not force:
        raise FileExistsError(f"{old} exists")
    if df.limit(2).count() != 1:
        raise ValueError("a day's document is one row")
    staging = f"{root}/_writing-{uuid.uuid4().hex}"
    df.drop("snapshot_date").coalesce(1).write.json(staging)
    fs, p = _fs(spark, staging)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    fs.mkdirs(path(f"{root}/{day}"))
    for end in (".json", ".json.gz") if old else ():
        fs.delete(path(f"{root}/{day}/{name}{end}"), False)
    fs.rename(part, path(f"{root}/{day}/{name}.json"))
    fs.delete(p, True)
    for t in PROJECTED if name == "jira" else ():
        fs.delete(path(f"{root}/_projected/{t}/snapshot_date={day}"), True)


PROJECTED = ("issues", "members", "sprints", "columns", "days")  # days last: it says that a day is done


def _projection(boards: DataFrame) -> dict[str, DataFrame]:
    """What the series reads of some days, without texts, comments or people."""
    i, at = issues(boards, keep_people=False), ["snapshot_date", "team"]
    captured = boards.select("snapshot_date", _instant("capturedAt").alias("seen"), F.explode("teams.key").alias("team"))
    return {
        "issues": i.select(*at, "key", "status_id", "category", "created", "resolved", "points"), "members": issue_sprints(i), "sprints": sprints(boards),
        "columns": board_columns(boards), "days": captured.groupBy(*at).agg(F.max("seen").alias("seen")),
    }


def project(spark: SparkSession, root: str, up_to: str | None = None) -> list[str]:
    """Bring the Parquet projection up to date: days that it lacks are read, once, and added,
    each table by date. Returns these days."""
    fs, p = _fs(spark, f"{root}/_projected/days")
    have = {s.getPath().getName().removeprefix("snapshot_date=") for s in fs.listStatus(p)} if fs.exists(p) else set()
    new = [d for d in dates(spark, root, up_to) if d not in have and _file(spark, root, d, "jira")]
    if new:
        files = [_file(spark, root, d, "jira") for d in new]
        rows = spark.read.schema(BOARDS).json(files, multiLine=True)
        boards = rows.withColumn("snapshot_date", F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1))).persist()
        tables = _projection(boards)
        for name in PROJECTED:
            tables[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(f"{root}/_projected/{name}")
        boards.unpersist()
    return new


def series(spark: SparkSession, root: str, up_to: str | None = None) -> dict[str, DataFrame]:
    """The tables of operators.series over all collected days up to one: day, day_issue,
    day_member, day_sprint, day_column. A team that a day lacks is skipped for that day."""
    project(spark, root, up_to)
    kinds = {n: df.schema for n, df in _projection(spark.createDataFrame([], BOARDS).withColumn("snapshot_date", F.lit(None).cast("date"))).items()}
    fs, p = _fs(spark, f"{root}/_projected/days")
    if not fs.exists(p):
        tables = {n: spark.createDataFrame([], k) for n, k in kinds.items()}
    else:
        tables = {n: spark.read.schema(k).parquet(f"{root}/_projected/{n}").where(F.lit(up_to).isNull() | (F.col("snapshot_date") <= F.lit(up_to))) for n, k in kinds.items()}
    number = F.row_number().over(W.partitionBy("team").orderBy("snapshot_date")) - 1  # teams by days: few rows
    day = tables["days"].select("team", "snapshot_date", "seen").withColumn("d", number)
    on = lambda df: df.join(day.select("team", "snapshot_date", "d"), ["team", "snapshot_date"]).drop("snapshot_date")
    out = {f"day_{n[:-1]}": on(tables[n]) for n in ("issues", "members", "sprints", "columns")}
    return {"day": day.withColumnRenamed("snapshot_date", "date"), **out}


def _instant(c: str):
    return F.expr(f"try_cast({c} as timestamp)")


def issues(boards: DataFrame, keep_people: bool = True) -> DataFrame:
    """A row for each issue of each team and day. Dates are instants (unparseable: null);
    blank strings count as missing; people are left out unless they may be kept."""
    t = boards.select("snapshot_date", F.explode("teams").alias("t")).select("snapshot_date", F.col("t.key").alias("team"), F.posexplode("t.issues").alias("pos", "i"))
    who = F.when(F.lit(keep_people), F.nullif(F.trim("i.assignee.displayName"), F.lit("")))
    return t.select("snapshot_date", "team", F.col("i.key").alias("key"), "pos", F.col("i.issueType").alias("issue_type"), F.col("i.statusId").alias("status_id"), F.col("i.statusCategory").alias("category"), *(_instant(f"i.{a}").alias(b) for a, b in (("created", "created"), ("resolutionDate", "resolved"), ("updated", "updated"), ("dueDate", "due"))), F.col("i.storyPoints").alias("points"), F.col("i.priority").alias("priority"), F.col("i.epicKey").alias("epic_key"), F.col("i.summary").alias("summary"), F.col("i.storyPointsField").alias("points_field"), who.alias("assignee"), F.when(F.lit(keep_people), F.nullif(F.trim("i.reporter.displayName"), F.lit(""))).alias("reporter"), F.col("i.labels").alias("labels"), F.col("i.commentCount").alias("comment_count"), F.coalesce("i.flagged", F.lit(False)).alias("flagged"), F.coalesce("i.inBacklog", F.lit(False)).alias("in_backlog"), F.col("i.parentKey").alias("parent_key"), F.array_sort("i.sprintIds").alias("sprint_ids"), F.col("i.blockedBy").alias("blockers"), F.col("i.comments").alias("comments"))


def issue_sprints(issue: DataFrame) -> DataFrame:
    return issue.select("snapshot_date", "team", "key", F.explode(F.array_distinct("sprint_ids")).alias("sprint_id"))


def sprints(boards: DataFrame) -> DataFrame:
    s = boards.select("snapshot_date", F.explode("teams").alias("t")).select("snapshot_date", F.col("t.key").alias("team"), F.explode("t.sprints").alias("s"))
    return s.select("snapshot_date", "team", F.col("s.id").alias("sprint_id"), F.lower("s.state").alias("state"), F.nullif(F.trim("s.goal"), F.lit("")).alias("goal"), *(_instant(f"s.{a}").alias(b) for a, b in (("startDate", "start_ts"), ("endDate", "end_ts"), ("completeDate", "complete_ts"))))


def epics(boards: DataFrame) -> DataFrame:
    """The epics that a board lists."""
    e = boards.select("snapshot_date", F.explode("teams").alias("t")).select("snapshot_date", F.col("t.key").alias("team"), F.explode("t.epics").alias("e"))
    return e.select("snapshot_date", "team", F.col("e.key").alias("epic"), F.coalesce("e.name", "e.summary").alias("name"), F.coalesce("e.done", F.lit(False)).alias("done"))


def board_columns(boards: DataFrame) -> DataFrame:
    """A row for each status of each column; a status that two columns claim has two."""
    t = boards.select("snapshot_date", F.explode("teams").alias("t")).select("snapshot_date", F.col("t.key").alias("team"), F.posexplode("t.columns").alias("col_pos", "c"))
    return t.select("snapshot_date", "team", "col_pos", F.col("c.name").alias("col"), F.explode("c.statusIds").alias("status_id"))


def review_signals(requests: DataFrame) -> DataFrame:
    """The merge requests of each team and day as operators.review takes them. Where a
    request has no review, or its reading failed with nothing human found, it is unknown
    whether it was reviewed; an approval that no longer stands has its time, but no count."""
    t = requests.select("snapshot_date", F.explode("teams").alias("t")).select("snapshot_date", F.col("t.key").alias("team"), F.explode("t.mergeRequests").alias("m"))
    r, n = F.col("m.review"), lambda c: F.coalesce(F.col(f"m.review.{c}"), F.lit(0))
    comments, approvals = n("humanCommentCount"), n("humanApprovalCount")
    none = (comments == 0) & (approvals == 0)
    out = t.select(
        "snapshot_date", "team", F.col("m.id").alias("mr"), F.nullif(F.trim("m.author.displayName"), F.lit("")).alias("author"), F.coalesce(r["authorIsAutomation"], F.lit(False)).alias("bot"), F.col("m.state").alias("state"),
        F.coalesce("m.draft", F.lit(False)).alias("draft"), *(_instant(f"m.{a}").alias(b) for a, b in (("createdAt", "created"), ("mergedAt", "merged"))), F.coalesce(F.size("m.issueKeys") > 0, F.lit(False)).alias("keyed"),
        *(_instant(f"m.review.{a}").alias(b) for a, b in (("firstHumanCommentAt", "first_comment"), ("firstAutomatedCommentAt", "first_bot"))), F.when(approvals > 0, _instant("m.review.firstHumanApprovalAt")).alias("standing"),
        comments.alias("comments"), approvals.alias("approvals"), (n("automatedCommentCount") + n("automatedApprovalCount")).alias("bot_notes"), n("reviewerCount").alias("reviewers"),
        F.when(r.isNotNull() & ~(r["error"].isNotNull() & none), ~none).alias("reviewed"), F.col("m.projectPath").alias("project"), F.col("m.title").alias("title"), F.col("m.sourceBranch").alias("branch"), F.col("m.webUrl").alias("web_url"),
    )
    return out.withColumn("touched", F.least("first_comment", "standing"))
