"""A day's feed: every finding of every team, with what must be said beside its figures, and
the run that tells what is news."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import days_between, js_round
from ..sources import snapshots
from . import changelog as cl
from . import delivery as dl
from . import interventions as iv
from . import review as rv
from . import rules
from . import series as sr

#: Findings of a kind that a feed keeps: more than a page shows, since what is new is told
#: against it and a finding must not seem new because another one went.
PER_KIND = 50
#: Hours between captures under which little churn is no quiet sprint.
SHORT_HOURS = 20


@dataclass
class Day:
    """The tables of one collected day, without people where they may not be kept."""

    spark: SparkSession
    root: str
    date: str
    team: str | None = None

    def __post_init__(self):
        only = lambda df: (df.where(F.col("team") == self.team) if self.team else df).drop("snapshot_date")
        self.boards = snapshots.read_day(self.spark, self.root, self.date)
        issues = snapshots.issues(self.boards)
        self.issue, self.sprint, self.columns = only(issues), only(snapshots.sprints(self.boards)), only(snapshots.board_columns(self.boards))
        self.issue_sprint, self.epic = only(snapshots.issue_sprints(issues)), only(snapshots.epics(self.boards))
        self.teams = only(self.boards.select("snapshot_date", F.explode("teams.key").alias("team")))
        self.captured = self.boards.select(F.max(F.col("capturedAt").try_cast("timestamp"))).first()[0]
        found = [n for n in ("gitlab", "github") if snapshots.last_day(self.spark, self.root, n, before=self.date + "~") == self.date]
        read = [snapshots.review_signals(snapshots.read_day(self.spark, self.root, self.date, n, snapshots.REQUESTS)) for n in found]
        self.requests = only(read[0] if len(read) == 1 else read[0].unionByName(read[1])) if read else None
        self.only = only

    @property
    def as_of(self) -> Column:
        return F.lit(self.captured)

    @property
    def board(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.issue, self.issue_sprint, self.sprint

    @property
    def comment(self) -> DataFrame:
        """Comments by thread, the newest first."""
        c = self.issue.select("team", "key", F.posexplode("comments").alias("i", "c"))
        return c.select("team", "key", (F.col("i") + 1).alias("rank"), F.coalesce("c.created", "c.updated").try_cast("timestamp").alias("at"), F.col("c.body").alias("body"))

    def series(self) -> dict[str, DataFrame]:
        """All days up to this one: what a later day knows is not known on it."""
        t = snapshots.series(self.spark, self.root, self.date)
        return {n: df.where(F.col("team") == self.team) if self.team else df for n, df in t.items()}

    def load(self) -> DataFrame:
        rows, done = dl.in_active(*self.board), F.col("category") == "Done"
        p = F.coalesce("points", F.lit(0))
        return rows.groupBy("team").agg(F.count("*").alias("issues"), F.sum(p).cast("long").alias("points"), F.count_if(F.col("points").isNull()).alias("unestimated"), F.coalesce(F.sum(F.when(done, p)), F.lit(0)).cast("long").alias("done_points"))


def churn(day: Day) -> DataFrame:
    """Net scope of each team's primary sprint as observed up to the day."""
    t = day.series()
    four = [t[n] for n in ("day", "day_issue", "day_member", "day_sprint")]
    return sr.churn_summary(*four).join(sr.primary_sprints(*four).select(*sr.SPRINT), sr.SPRINT, "left_semi")


def findings(day: Day, stale_days: int = 10, window: int = dl.WINDOW, per_kind: int = PER_KIND) -> DataFrame:
    """Findings of all kinds on a day."""
    fc = dl.forecast(dl.sprint_metrics(*day.board), F.col("completed_points"), window)
    active = day.sprint.where("state = 'active'")
    outlook = rules.sprint_outlook(day.load(), fc, dl.sprint_length(day.sprint), active, day.as_of)
    found = [
        iv.on_issues(*day.board, day.as_of, stale_days), iv.in_comments(*day.board, day.comment, day.as_of, stale_days), iv.on_sprints(*day.board, day.as_of), iv.on_people(*day.board),
        iv.on_load(dl.load_verdict(day.load(), fc), outlook), iv.on_scope(churn(day)), iv.unread_comments(*day.board),
    ]
    if day.requests is not None:
        found.append(iv.on_review(rv.awaiting_review(day.requests, day.as_of), rv.review_metrics(day.requests)))
    return iv.ranked(*found, per_kind=per_kind)


def caveats(day: Day) -> DataFrame:
    """team, about, text: what must be said beside a team's figures of points, reviews, churn
    and comments; only where it applies."""
    share = js_round(F.col("unestimated") / F.col("issues") * 100).cast("int")
    thin = (F.col("issues") - F.col("unestimated")) / F.col("issues") < dl.COVERAGE
    said = [day.load().where(thin).select("team", F.lit("points").alias("about"), F.format_string("%d%% of the active work has no estimate (%d of %d issues): points are a floor, not a measure of what is left, and say nothing of capacity.", share, "unestimated", "issues").alias("text"))]
    if day.requests is not None:
        m = rv.review_metrics(day.requests)
        said.append(m.select("team", F.lit("review"), F.format_string("Rates are over %d requests that people opened; %d of automation are on neither side of them.", "by_people", "by_bots")))
    t = day.series()
    ends = t["day"].groupBy("team").agg(F.count("*").alias("n"), F.min(F.struct("d", "date", "seen")).alias("a"), F.max(F.struct("d", "date", "seen")).alias("b")).where("n > 1")
    hours = js_round(days_between("a.seen", "b.seen") * 24, 1)
    short = F.when(hours < SHORT_HOURS, F.lit(" - less than a working day, so little churn is a short interval, no quiet sprint.")).otherwise(F.lit("."))
    seen = F.concat(F.lit("Churn is observed between the captures of "), F.col("a.date").cast("string"), F.lit(" and "), F.col("b.date").cast("string"), F.lit(", "), hours.cast("string"), F.lit(" hours apart"), short)
    said.append(ends.join(churn(day).select("team"), "team", "left_semi").select("team", F.lit("churn"), seen))
    read = day.issue.where("comments is not null").select("team").distinct()
    said.append(read.select("team", F.lit("comments"), F.lit("Comments are collected for open work of active sprints only, not for the whole board.")))
    out = said[0]
    for s in said[1:]:
        out = out.union(s)
    return out


def changes(day: Day, stale_days: int = 10) -> DataFrame:
    """The day's findings against those of the last day before it that has boards."""
    before = snapshots.last_day(day.spark, day.root, before=day.date)
    rank = F.array_position(F.lit(list(reversed(iv.SEVERITY))), F.col("severity"))
    of = lambda d: findings(d, stale_days).withColumn("severity", rank)
    return cl.diff_findings(of(Day(day.spark, day.root, before, day.team)) if before else None, of(day))


STATE = "identity string, severity string, sends long"


def read_state(spark: SparkSession, root: str) -> DataFrame | None:
    """What was sent, as the last run left it; None before the first run."""
    fs, p = snapshots._fs(spark, f"{root}/_alerts")
    runs = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("run-")) if fs.exists(p) else []
    return spark.read.schema(STATE).parquet(f"{root}/_alerts/{runs[-1]}") if runs else None


def alert(day: Day, floor: str = "this-week", limit: int = 10, dry_run: bool = False, stale_days: int = 10) -> DataFrame:
    """The plan of a run: findings with their status and turn (null: not sent). The first run
    only notes what stands. The caller sends; the state is written last, as a folder of its
    own, so that a run that fails is a run that is repeated."""
    spark, before = day.spark, snapshots.last_day(day.spark, day.root, before=day.date)
    state = read_state(spark, day.root)
    known = spark.createDataFrame([], STATE) if state is None else state
    today = findings(day, stale_days)
    yesterday = findings(Day(spark, day.root, before, day.team), stale_days) if before else today.limit(0)
    plan = iv.classify(today, yesterday, known, floor, limit)
    plan = plan.withColumn("turn", F.when(F.lit(state is not None), F.col("turn"))).persist()
    if not dry_run:
        loud = today.where(~F.col("kind").isin(*iv.QUIET)).select("identity", "severity")
        sent = plan.where("status != 'cleared'").select("identity", F.col("turn").isNotNull().alias("sent"))
        quiet = known.join(sent.select("identity"), "identity", "left_anti").join(loud.select("identity"), "identity", "left_semi")
        after = cl.next_state(known, loud.join(sent, "identity")).unionByName(quiet)  # under the floor: as it was
        stamp = spark.sql("select date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]
        after.write.mode("errorifexists").parquet(f"{day.root}/_alerts/run-{stamp}")
    return plan


def headline(plan: DataFrame) -> DataFrame:
    """How many findings have each status, statuses without any included."""
    names = plan.sparkSession.createDataFrame([(s,) for s in ("new", "escalated", "unreported", "standing", "cleared")], "status string")
    n = plan.groupBy("status").agg(F.count("*").alias("n"), F.count("turn").alias("sent"))
    return names.join(n, "status", "left").fillna(0)
