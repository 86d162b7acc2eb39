"""The series kept up day by day: churn, burndown and flow without reading old days again.

Adding a day reads that day and what was kept of each team's day before, and appends what
the two differ in. Histories are sums over what was appended:

    changes(team, sprint_id, d, key, kind, was, now, resolved)     what changed, no more
    pairs(team, sprint_id, d)                                      what was compared
    opened(team, sprint_id, opening)                               points on a sprint's first day
    burned(team, sprint_id, d, committed, done, issues, open_issues, there)
    placed(team, sprint_id, d, col, n)                             issues by the day's columns
    days(team, d, date, seen)
    last_*                                                         each team's last day, whole

A day is a folder in each table, written before days, whose folder says that it is there; so a
run that failed is done again, and a day that is there is not added twice. last_* lie in a
folder for each day, of which the latest complete one counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import OFF_BOARD, count_if, days_between, done, points, total
from ..sources.snapshots import _fs
from . import series as sr

SPRINT = sr.SPRINT
KINDS = {
    "changes": "team string, sprint_id long, d int, key string, kind string, was long, now long, resolved boolean", "pairs": "team string, sprint_id long, d int",
    "opened": "team string, sprint_id long, opening long", "burned": "team string, sprint_id long, d int, committed long, done long, issues long, open_issues long, there boolean",
    "placed": "team string, sprint_id long, d int, col string, n long", "days": "team string, d int, date date, seen timestamp",
    "last_issue": "team string, d int, key string, status_id string, category string, points double", "last_member": "team string, d int, key string, sprint_id long",
    "last_sprint": "team string, d int, sprint_id long, state string, start_ts timestamp, end_ts timestamp", "last_column": "team string, d int, col_pos int, col string, status_id string",
    "known": "team string, sprint_id long",
}
LAST = ("last_issue", "last_member", "last_sprint", "last_column", "known")
GROWING = ("changes", "pairs", "opened", "burned", "placed")


@dataclass
class KeptSeries:
    spark: SparkSession
    root: str

    def dates(self) -> list[str]:
        """The days that are there."""
        fs, p = _fs(self.spark, f"{self.root}/days")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, name: str, dates: list[str]) -> DataFrame:
        """Of the given days; folders that a failed run left are not among them."""
        if not dates:
            return self.spark.createDataFrame([], KINDS[name])
        return self.spark.read.schema(KINDS[name]).parquet(*(f"{self.root}/{name}/{d}" for d in dates))

    def table(self, name: str) -> DataFrame:
        dates = self.dates()
        return self._read(name, dates[-1:] if name in LAST else dates)

    def add(self, date: str, day: DataFrame, issue: DataFrame, member: DataFrame, sprint: DataFrame, column: DataFrame) -> bool:
        """Add a day, later than all that are there: day(team, seen), issue(team, key,
        status_id, category, points), member(team, key, sprint_id), sprint(team, sprint_id,
        state, start_ts, end_ts), column(team, col_pos, col, status_id). Teams that the day
        lacks keep their last one. False if the day is there already."""
        have = self.dates()
        if date in have:
            return False
        if have and date < have[-1]:
            raise ValueError(f"{date} is before {have[-1]}: a series grows at its end")
        last = {n: self._read(n, have[-1:]) for n in LAST}
        seen = self._read("days", have).groupBy("team").agg((F.max("d") + 1).alias("d"))
        day = day.join(seen, "team", "left").select("team", F.coalesce("d", F.lit(0)).cast("int").alias("d"), F.lit(date).cast("date").alias("date"), "seen")
        of = day.select("team", "d")
        issue, member, sprint, column = (df.join(of, "team") for df in (issue, member.distinct(), sprint, column))

        both = lambda new, old: new.unionByName(old.join(of.select("team"), "team", "left_semi"), allowMissingColumns=True)
        all_member, all_issue = both(member, last["last_member"]), both(issue, last["last_issue"])
        rows = all_member.join(all_issue, ["team", "d", "key"])
        pairs = last["last_sprint"].select(*SPRINT).distinct().join(of, "team")
        changes = sr.changes_of(rows, pairs).where("kind != 'same' or resolved")

        today = member.join(issue, ["team", "d", "key"])
        there = sprint.select(*SPRINT, "d").distinct().withColumn("there", F.lit(True))
        sums = today.groupBy(*SPRINT, "d").agg(total(points()).alias("committed"), total(F.when(done(), points())).alias("done"), F.count("*").alias("issues"), count_if(~done()).alias("open_issues"))
        burned = there.join(sums, [*SPRINT, "d"], "full").fillna(0).fillna(False, ["there"])
        fresh = there.join(last["known"], SPRINT, "left_anti").select(*SPRINT)
        opened = fresh.join(sums, SPRINT, "left").select(*SPRINT, F.coalesce("committed", F.lit(0)).alias("opening"))
        placed = sr.placed(today, column).groupBy(*SPRINT, "d", "col").agg(F.count("*").alias("n"))

        new = {"changes": changes, "pairs": pairs, "opened": opened, "burned": burned, "placed": placed}
        rest = {"last_issue": issue, "last_member": member, "last_sprint": sprint, "last_column": column}
        for n, df in rest.items():  # teams that the day lacks
            new[n] = df.unionByName(last[n].join(of.select("team"), "team", "left_anti"), allowMissingColumns=True)
        new["known"] = last["known"].union(fresh)
        for n, df in {**new, "days": day}.items():
            columns = [F.col(c).cast(k).alias(c) for c, k in (x.split() for x in KINDS[n].split(", "))]
            df.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{n}/{date}")
        return True

    def active(self) -> DataFrame:
        """The sprints that are active on their team's last day."""
        return self.table("last_sprint").where("state = 'active'").select(*SPRINT, "start_ts", "end_ts")

    def _of_active(self, name: str) -> DataFrame:
        return self.table(name).join(self.active().select(*SPRINT), SPRINT, "left_semi")

    def sprint_delta(self) -> DataFrame:
        """As series.sprint_delta over all days."""
        return sr.delta_of(self._of_active("changes"), self._of_active("pairs"))

    def churn_summary(self) -> DataFrame:
        """As series.churn_summary over all days."""
        opening = self.active().select(*SPRINT).join(self.table("opened"), SPRINT)
        return sr.churn_of(self._of_active("changes"), self._of_active("pairs"), opening)

    def burndown(self) -> DataFrame:
        """As series.burndown over all days."""
        g = self.table("burned").join(self.active(), SPRINT).join(self.table("days").select("team", "d", "seen"), ["team", "d"])
        gone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), days_between("start_ts", "seen") / days_between("start_ts", "end_ts")))
        ideal = F.when(F.col("end_ts") > F.col("start_ts"), F.col("committed") * (1 - gone))
        return g.select(*SPRINT, "d", "committed", "done", (F.col("committed") - F.col("done")).alias("remaining"), "issues", "open_issues", F.round(ideal, 6).alias("ideal"))

    def cumulative_flow(self) -> DataFrame:
        """As series.cumulative_flow over all days."""
        held = self.table("last_member").join(self.table("last_issue"), ["team", "d", "key"]).groupBy(*SPRINT).agg(total(points()).alias("committed"))
        primary = self.active().select(*SPRINT).join(held, SPRINT, "left").fillna(0, ["committed"])
        primary = primary.groupBy("team").agg(F.min(F.struct((-F.col("committed")).alias("c"), "sprint_id")).alias("m")).select("team", F.col("m.sprint_id").alias("sprint_id"))
        axis = self.table("last_column").groupBy("team", "col").agg(F.min("col_pos").alias("col_pos"))
        there = self.table("burned").join(primary, SPRINT, "left_semi").select(*SPRINT, "d")
        counts = self.table("placed").join(primary, SPRINT, "left_semi").join(axis.select("team", "col", F.lit(True).alias("known")), ["team", "col"], "left")
        at = F.when(F.col("known"), F.col("col")).otherwise(F.lit(OFF_BOARD)).alias("col")
        return sr.flow_on(axis, there, counts.groupBy(*SPRINT, "d", at).agg(F.sum("n").alias("n")))


def add_snapshots(kept: KeptSeries, root: str, up_to: str | None = None) -> list[str]:
    """Add the snapshot days that are later than those there; of each, only that day is read."""
    from ..sources import snapshots

    have, added = kept.dates(), []
    for date in snapshots.dates(kept.spark, root, up_to):
        if (have and date <= have[-1]) or not snapshots.last_day(kept.spark, root, before=date + "~") == date:
            continue
        boards = snapshots.read_day(kept.spark, root, date)
        t = {n: df.drop("snapshot_date") for n, df in snapshots._projection(boards).items()}
        kept.add(date, t["days"], t["issues"], t["members"], t["sprints"], t["columns"])
        added.append(date)
    return added
