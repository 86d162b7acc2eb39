"""Commands over a folder of dated snapshots: python -m tidegauge COMMAND --data ROOT.

Each prints a table, or JSON lines with --json. The day is the last one with boards unless
--date names another; clocks are the snapshot's own. Tables print at most --rows rows.
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import delivery as dl
from .operators import feed, groups, people
from .operators import review as rv
from .operators import series as sr
from .operators import taxonomy as tx
from .operators.feed import Day
from .sources import snapshots, upkeep


def day_of(spark: SparkSession, root: str, date: str | None, team: str | None) -> Day:
    """The day that is asked for. Only names are read to find it."""
    day = date if date and snapshots._file(spark, root, date, "jira") else None if date else snapshots.last_day(spark, root)
    if not day:
        raise SystemExit(f"no snapshot of {date or 'any day'} in {root}")
    found = Day(spark, root, day, team)
    if team and found.teams.isEmpty():
        raise SystemExit(f"no team {team} on {day}")
    return found


def quality(d: Day, a) -> DataFrame:
    order = F.array_position(F.lit(["high", "medium", "low"]), F.col("severity"))
    return tx.quality_findings(*d.board, d.teams, d.columns, d.as_of, a.stale_days).orderBy("team", order, "code")


def trends(d: Day, a) -> DataFrame:
    return dl.team_trends(dl.sprint_metrics(*d.board), a.window).orderBy("team")


def sprints(d: Day, a) -> DataFrame:
    return dl.sprint_metrics(*d.board).orderBy("team", "place")


def load(d: Day, a) -> DataFrame:
    fc = dl.forecast(dl.sprint_metrics(*d.board), F.col("completed_points"), a.window)
    return dl.load_verdict(dl.active_load(*d.board), fc).orderBy("team")


def backlog(d: Day, a) -> DataFrame:
    return dl.backlog_summary(d.issue, d.as_of).orderBy("team")


def epics(d: Day, a) -> DataFrame:
    return tx.ranked_epics(tx.epic_rollup(*d.board, d.as_of, d.epic)).orderBy("team", "rank")


def estate(d: Day, a) -> DataFrame:
    return tx.estate_epics(tx.epic_rollup(*d.board, d.as_of, d.epic)).orderBy(F.desc("cross_team"), F.desc("active_issues"), F.desc("issues"), "epic")


def wip(d: Day, a) -> DataFrame:
    return tx.wip_by_column(*d.board, d.columns, d.as_of, a.stale_days).orderBy("team", F.desc("issues"), "col")


def attention(d: Day, a) -> DataFrame:
    from .operators.interventions import comment_signals

    told = comment_signals(d.comment, ["team", "key"])
    return tx.attention_items(*d.board, d.as_of, a.stale_days, told).orderBy(F.desc("weight"), F.desc("sprint_count"), "key")


def roster(d: Day, a) -> DataFrame:
    shape = "mr long, team string, author string, bot boolean, merged timestamp, reviewed boolean, project string"
    mr = d.requests if d.requests is not None else d.spark.createDataFrame([], shape)
    given = d.spark.createDataFrame([], "mr long, team string, person string")
    return people.roster(*d.board, mr, given, d.as_of).orderBy("team", F.desc("open_in_active"), F.desc("open_assigned"), F.desc("authored"), "name")


def review(d: Day, a) -> DataFrame:
    if d.requests is None:
        raise SystemExit(f"no merge requests were collected on {d.date}")
    return rv.review_metrics(d.requests).orderBy("team")


def history(d: Day, a) -> DataFrame:
    t = d.series()
    return sr.team_history(*(t[n] for n in ("day", "day_issue", "day_member", "day_sprint", "day_column"))).orderBy("team")


def dwell(d: Day, a) -> DataFrame:
    t = d.series()
    summary = sr.column_dwell_summary(sr.column_dwell(*(t[n] for n in ("day", "day_issue", "day_member", "day_sprint", "day_column"))))
    known = F.when(F.col("reportable"), F.col("p50"))
    return summary.orderBy("team", F.desc("reportable"), F.desc_nulls_last(known), F.desc("n"), "col")


def interventions(d: Day, a) -> DataFrame:
    return feed.findings(d, a.stale_days, a.window).orderBy(F.desc("weight"), "identity")


def caveats(d: Day, a) -> DataFrame:
    return feed.caveats(d).orderBy("team", "about")


def changes(d: Day, a) -> DataFrame:
    told = F.when(F.col("kind").isin("new", "escalated"), 0).when(F.col("kind").isin("eased", "cleared"), 1).otherwise(2)
    return feed.changes(d, a.stale_days).orderBy(told, F.desc(F.coalesce("now", "was")), "identity")


def alert(d: Day, a) -> DataFrame:
    return feed.alert(d, a.floor, a.limit, a.dry_run, a.stale_days).orderBy(F.asc_nulls_last("turn"), F.desc("weight"), "identity")


def coverage(d: Day, a) -> DataFrame:
    day = lambda name, schema: snapshots.read_day(d.spark, d.root, d.date, name, schema)
    return upkeep.coverage_gaps(d.boards, day("gitlab", snapshots.REQUESTS), day("context", upkeep.CONTEXT)).orderBy("what")


def mapping(d: Day, a) -> DataFrame:
    """Boards for the groups that merge requests lie in, each group with those above it."""
    if d.requests is None:
        raise SystemExit(f"no merge requests were collected on {d.date}")
    path = F.split("project", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.array_join(F.slice(path, F.lit(1), i), "/"))
    mr = d.requests.where(F.size(path) > 1).select(F.explode(above).alias("grp"), "mr", "author", "bot", "title", "branch")
    verdict = F.array_position(F.lit(["propose", "possible", "shared", "none"]), F.col("verdict"))
    return groups.suggest(mr, d.issue, groups.assignees(d.issue, d.as_of)).orderBy(verdict, F.col("covered_by").isNotNull(), F.desc("key_hits"), F.desc("authors"), "grp")


COMMANDS = {f.__name__: f for f in (quality, trends, sprints, load, backlog, epics, estate, wip, attention, roster, review, history, dwell, interventions, caveats, changes, alert, coverage, mapping)}


def positive(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise argparse.ArgumentTypeError("must be above zero")
    return n


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidegauge", description=__doc__)
    p.add_argument("command", choices=[*COMMANDS, "dates", "archive", "project"])
    p.add_argument("--data", required=True)
    p.add_argument("--date")
    p.add_argument("--team")
    p.add_argument("--json", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--floor", choices=["act-now", "this-week", "watch"], default="this-week")
    p.add_argument("--limit", type=positive, default=10)
    p.add_argument("--rows", type=positive, default=1000)
    p.add_argument("--stale-days", type=positive, default=10)
    p.add_argument("--window", type=positive, default=dl.WINDOW)
    p.add_argument("--older-than-days", type=positive, default=90)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidegauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "dates":
        print("\n".join(snapshots.dates(spark, a.data, a.date)))
    elif a.command == "project":
        print("\n".join(snapshots.project(spark, a.data, a.date)))
    elif a.command == "archive":
        today = datetime.date.fromisoformat(a.date) if a.date else datetime.datetime.now(datetime.UTC).date()
        for day, name, size in upkeep.archive(spark, a.data, today, a.older_than_days, a.dry_run):
            print(day, name, size)
    else:
        rows = COMMANDS[a.command](day_of(spark, a.data, a.date, a.team), a)
        if a.json:
            for line in rows.toJSON().toLocalIterator():
                print(line)
        else:
            shown = rows.limit(a.rows + 1).toPandas()
            print(shown.head(a.rows).to_string(index=False))
            if len(shown) > a.rows:
                print(f"... more than {a.rows} rows: use --rows or --json")


if __name__ == "__main__":
    main()
