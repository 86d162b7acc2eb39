"""Interventions: what needs somebody, of every kind, with severity, identity and weight.

Each rule yields rows (team, kind, severity, identity, keys, weight); `ranked` adds the base
of the severity and of the kind. Rules on issues share one scan: an issue's findings are an
array of structs that is exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import NO_KEYS, count_if, days_between, done, js_round
from .delivery import in_active
from .rules import identity
from .taxonomy import blocker_links

# Severities, kinds and the phrases of comments.
SEVERITY = {"act-now": 1000, "this-week": 500, "watch": 100}
KIND = {
    "flagged": 160, "overdue": 150, "sprint-overdue": 140, "blocked-by-open": 130, "blocker-in-comments": 120, "over-committed": 90, "review-stalled": 75, "merge-lag": 70, "review-gap": 70,
    "scope-churn": 60, "stale": 50, "unassigned": 40, "no-goal": 30, "wip-overload": 30, "comments-not-collected": 0,
}
QUIET = ("comments-not-collected", "no-goal", "wip-overload")
BLOCKING = [
    "blocked", "blocker", "blocking", "waiting on", "waiting for", "wait for", "on hold", "cannot proceed", "can't proceed", "cant proceed", "stuck", "no response", "chasing", "chased", "escalat",
    "dependency on", "depends on", "need a decision", "needs a decision", "need approval", "needs approval", "awaiting", "not able to", "unable to progress",
]
RESOLVING = ["unblocked", "no longer blocked", "resolved now", "this is done", "good to go", "sorted now"]

#: Findings of one kind that a team may show, and kinds with a limit of their own.
PER_KIND, WIP_KIND = 8, 4
SHAPE = ("team", "kind", "severity", "identity", "keys", "weight", "order_", "pos")


def _none() -> Column:
    return F.lit(None).cast("string")


def _severe(when: Column, otherwise: str = "this-week") -> Column:
    return F.when(when, "act-now").otherwise(otherwise)


def _row(team, kind: str, severity, own_key, keys, weight, order=None, pos=None) -> list[Column]:
    ident = identity(F.col(team), F.lit(kind), own_key, keys)
    values = (F.col(team), F.lit(kind), severity, ident, keys, weight.cast("double"), F.lit(0.0) if order is None else order.cast("double"), F.lit(0).cast("long") if pos is None else pos)
    return [v.alias(n) for v, n in zip(values, SHAPE)]


def open_active(issue, issue_sprint, sprint) -> DataFrame:
    return in_active(issue, issue_sprint, sprint).where(~done())


def on_issues(issue, issue_sprint, sprint, as_of: Column, stale_days: int = 10) -> DataFrame:
    """Flagged, held up, stale and overdue issues among the open ones of active sprints."""
    links, is_open = blocker_links(issue.where(~done())), issue.where(~done())
    blockers = links.join(is_open.select("team", F.col("key").alias("blocked_by"), days_between("updated", as_of).alias("held")), ["team", "blocked_by"])
    blockers = blockers.groupBy("team", "key").agg(F.max("held").alias("held"), F.array_sort(F.collect_list("blocked_by")).alias("by"))
    rows = open_active(issue, issue_sprint, sprint).join(blockers, ["team", "key"], "left")
    idle, over, held, flagged = days_between("updated", as_of), days_between("due", as_of), F.col("held"), F.coalesce("flagged", F.lit(False))
    own, with_blockers = F.array("key"), F.concat(F.array("key"), "by")
    least = lambda top, v: F.least(F.lit(float(top)), F.coalesce(v, F.lit(0.0)))
    rules = [
        ("flagged", flagged, F.coalesce(idle >= 3, F.lit(False)), own, least(200, idle * 10), F.lit(0.0)),
        ("blocked-by-open", held.isNotNull(), held >= stale_days, with_blockers, least(200, held * 8), F.lit(0.0)),
        ("stale", (F.col("category") == "In Progress") & ~flagged & (idle >= stale_days), idle >= 2 * stale_days, own, least(200, idle * 5), -idle),
        ("overdue", over > 0, over >= 7, own, least(250, over * 8), -over),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(kind).alias("kind"), _severe(act).alias("severity"), keys.alias("keys"), weight.alias("weight"), order.alias("order_"))) for kind, test, act, keys, weight, order in rules)))
    out = rows.select("team", "pos", F.explode(found).alias("f")).select("team", "pos", "f.*")
    return out.withColumn("identity", identity(F.col("team"), F.col("kind"), _none(), F.col("keys"))).select(*SHAPE)


def comment_signals(comment: DataFrame, by: list[str]) -> DataFrame:
    """The newest comment of each thread that tells of a blockage, with the phrase that is
    first in the list; none where it or a newer comment tells of its end."""
    low = F.lower("body")
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    phrase = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in BLOCKING))
    told = comment.groupBy(*by).agg(F.min(F.when(has(BLOCKING), F.struct("rank", F.col("at").alias("said"), phrase.alias("phrase")))).alias("hit"), F.min(F.when(has(RESOLVING), F.col("rank"))).alias("ok"))
    return told.where("hit is not null and (ok is null or ok > hit.rank)").select(*by, "hit.*")


def in_comments(issue, issue_sprint, sprint, comment: DataFrame, as_of: Column, stale_days: int = 10) -> DataFrame:
    """Open issues that nobody flagged whose newest telling comment says that they are
    stuck, unless it or a newer one says otherwise. comment(team, key, rank, at, body):
    rank 1 is the newest."""
    told = comment_signals(comment, ["team", "key"]).select("team", "key", "said")
    rows = open_active(issue, issue_sprint, sprint).where(~F.coalesce("flagged", F.lit(False))).join(told, ["team", "key"])
    age = days_between("said", as_of)
    return rows.select(*_row("team", "blocker-in-comments", _severe(age >= stale_days), _none(), F.array("key"), F.least(F.lit(200.0), F.coalesce(age * 6, F.lit(0.0))), pos=F.col("pos")))


def on_sprints(issue, issue_sprint, sprint, as_of: Column) -> DataFrame:
    """Sprints that are still active after their end, and teams none of whose active
    sprints has a goal."""
    active = sprint.where("state = 'active'")
    over = days_between("end_ts", as_of)
    late = active.withColumn("over", over).where("over > 0")
    inside = issue_sprint.join(late.select("team", "sprint_id"), ["team", "sprint_id"]).join(issue.where(~done()).select("team", "key", "pos"), ["team", "key"])
    place = F.row_number().over(W.partitionBy("team", "sprint_id").orderBy("pos"))
    first = inside.withColumn("p", place).where("p <= 10").groupBy("team", "sprint_id").agg(F.array_sort(F.collect_list(F.struct("p", "key"))).alias("k"))
    late = late.join(first.select("team", "sprint_id", F.col("k.key").alias("k")), ["team", "sprint_id"], "left").withColumn("k", F.coalesce("k", F.expr(NO_KEYS)))
    a = late.select(*_row("team", "sprint-overdue", _severe(F.col("over") >= 3), F.concat(F.lit("sprint-"), F.col("sprint_id").cast("string")), F.col("k"), F.least(F.lit(250.0), F.col("over") * 8), -F.col("over"), F.col("sprint_id")))
    aimless = active.groupBy("team").agg(F.count("goal").alias("goals")).where("goals = 0")
    return a.union(aimless.select(*_row("team", "no-goal", F.lit("watch"), _none(), F.expr(NO_KEYS), F.lit(0))))


def on_people(issue, issue_sprint, sprint, wip_limit: int = 3) -> DataFrame:
    """People with too much in progress, and work that is nobody's."""
    rows = in_active(issue, issue_sprint, sprint)
    going = rows.where("category = 'In Progress' and assignee is not null")
    first = going.withColumn("p", F.row_number().over(W.partitionBy("team", "assignee").orderBy("pos"))).where("p <= 10")
    keys = first.groupBy("team", "assignee").agg(F.array_sort(F.collect_list(F.struct("p", "key"))).alias("k")).select("team", "assignee", F.col("k.key").alias("k"))
    busy = going.groupBy("team", "assignee").agg(F.count("*").alias("n")).where(F.col("n") > wip_limit).join(keys, ["team", "assignee"])
    a = busy.select(*_row("team", "wip-overload", F.lit("watch"), F.col("assignee"), F.col("k"), F.col("n") * 5, -F.col("n")))
    idle = rows.where(~done()).groupBy("team").agg(count_if(F.col("assignee").isNull()).alias("n")).where("n >= 3")
    return a.union(idle.select(*_row("team", "unassigned", F.lit("this-week"), F.lit("team"), F.expr(NO_KEYS), F.col("n") * 3)))


def on_load(verdicts: DataFrame, outlook: DataFrame) -> DataFrame:
    """Teams that took on more than the most they are likely to finish. verdicts(team,
    points, p90), outlook(team, verdict)."""
    j = verdicts.join(outlook.select("team", F.col("verdict").alias("outlook")), "team").where("points > p90 and outlook != 'unknown'")
    weight = js_round((F.col("points") - F.col("p90")) / F.greatest("p90", F.lit(1.0)) * 100)
    return j.select(*_row("team", "over-committed", _severe(F.col("outlook") == "will-not-land"), _none(), F.expr(NO_KEYS), weight))


def on_review(awaiting: DataFrame, metrics: DataFrame) -> DataFrame:
    """Reviews that stall, merges without any, and approvals that wait for their merge.
    awaiting(team, mr, open_hours), metrics(team, merged_known, merged_unreviewed, lag_p50)."""
    hours, rate = F.col("open_hours"), F.col("merged_unreviewed") / F.col("merged_known")
    a = awaiting.where(hours >= 48).select(*_row("team", "review-stalled", _severe(hours >= 168), F.col("mr").cast("string"), F.expr(NO_KEYS), F.least(F.lit(200.0), hours / 24 * 8), -hours, F.col("mr").cast("long")))
    b = metrics.where((F.col("merged_known") > 0) & (rate >= 0.4)).select(*_row("team", "review-gap", F.lit("this-week"), _none(), F.expr(NO_KEYS), js_round(rate * 100)))
    c = metrics.where("lag_p50 >= 48").select(*_row("team", "merge-lag", F.lit("this-week"), _none(), F.expr(NO_KEYS), js_round(F.col("lag_p50"))))
    return a.union(b).union(c)


def on_scope(churn: DataFrame) -> DataFrame:
    """Sprints that grew or shrank by 8 points or more. churn(team, net_points)."""
    net = F.col("net_points")
    return churn.where(F.abs(net) >= 8).select(*_row("team", "scope-churn", F.when(net > 0, "this-week").otherwise("watch"), _none(), F.expr(NO_KEYS), F.abs(net)))


def unread_comments(issue, issue_sprint, sprint) -> DataFrame:
    """Teams none of whose open active issues had its comments collected (null, not [])."""
    g = open_active(issue, issue_sprint, sprint).groupBy("team").agg(F.count("comments").alias("n")).where("n = 0")
    return g.select(*_row("team", "comments-not-collected", F.lit("watch"), _none(), F.expr(NO_KEYS), F.lit(0)))


def ranked(*findings: DataFrame, per_kind: int = PER_KIND) -> DataFrame:
    """The findings of each kind that a team shows, with their whole weight."""
    rows = reduce(DataFrame.unionByName, findings)
    place = F.row_number().over(W.partitionBy("team", "kind").orderBy("order_", "pos", "identity"))
    rows = rows.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == "wip-overload", min(WIP_KIND, per_kind)).otherwise(per_kind))
    base = lambda c, m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col(c)]
    weight = F.round(base("severity", SEVERITY) + base("kind", KIND) + F.col("weight"), 6)
    return rows.select("team", "kind", "severity", "identity", F.array_join("keys", ",").alias("keys"), weight.alias("weight"))


def _rank_of(c: str) -> Column:
    return F.array_position(F.lit(list(reversed(SEVERITY))), F.col(c))


def classify(today: DataFrame, yesterday: DataFrame, state: DataFrame, floor: str = "this-week", limit: int = 10) -> DataFrame:
    """Today's findings against what was sent and what stood yesterday: new, escalated,
    standing or unreported, and in which turn to send (null: not). Teams take turns. What
    was sent and is gone is cleared. state(identity, severity, sends)."""
    loud = ~F.col("kind").isin(*QUIET)
    now = today.where(loud)
    seen = yesterday.where(loud).select("identity", F.lit(True).alias("stood")).distinct()
    j = now.where(_rank_of("severity") >= list(reversed(SEVERITY)).index(floor) + 1).join(state.select("identity", F.col("severity").alias("was")), "identity", "left").join(seen, "identity", "left")
    status = F.when(F.col("was").isNotNull(), F.when(_rank_of("severity") > _rank_of("was"), "escalated").otherwise("standing")).when(F.col("stood"), "unreported").otherwise("new")
    j = j.select("identity", "team", "kind", "severity", "weight", status.alias("status"))
    team = W.partitionBy("team")
    fresh = j.where("status != 'standing'").withColumn("turn", F.row_number().over(team.orderBy(F.desc("weight"), "identity"))).where(F.col("turn") <= limit).withColumn("most", F.max("weight").over(team))
    sent = fresh.orderBy("turn", F.desc("most"), "team").limit(limit).select("identity", "turn")
    gone = state.where("sends > 0").join(now.select("identity"), "identity", "left_anti")
    cleared = gone.select("identity", F.split("identity", r"\|")[0].alias("team"), F.split("identity", r"\|")[1].alias("kind"), "severity", F.lit(None).cast("double").alias("weight"), F.lit("cleared").alias("status"), F.lit(None).cast("int").alias("turn"))
    return j.join(sent, "identity", "left").unionByName(cleared)
