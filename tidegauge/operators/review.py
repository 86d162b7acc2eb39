"""Code review: three-valued signals, latencies and practice.

Tables: merge_request(mr, team, author, bot, created, state, draft, detail, failed, dismissed,
reviewers, keyed), note(mr, author, bot, kind, at). detail: whether its reviews were read;
failed: reading them failed part way; dismissed: its approvals no longer stand; reviewers:
how many were asked; keyed: whether it names an issue. All but the first five are optional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import count_if, days_between, hours_between
from ..functions.ranks import percentiles

EDGES = (0, 1, 4, 8, 24, 48, 120)


def review_signals(mr: DataFrame, note: DataFrame) -> DataFrame:
    """Conditional minima and counts of an MR's notes; the author's own do not count."""
    owner = mr.where("detail") if "detail" in mr.columns else mr
    n = note.join(owner.select("mr", F.col("author").alias("owner")), "mr").where("author != owner")
    human, comment, approve = ~F.col("bot"), F.col("kind") == "comment", F.col("kind") == "approval"
    at = lambda c: F.min(F.when(c, F.col("at")))
    g = n.groupBy("mr").agg(
        at(human & comment).alias("first_comment"), at(human & approve).alias("approved"), at(~human & comment).alias("first_bot"), count_if(human & comment).alias("comments"),
        count_if(human & approve).alias("approvals"), count_if(~human & (comment | approve)).alias("bot_notes"),
    )
    merged = note.where("kind = 'merge'").groupBy("mr").agg(F.min("at").alias("merged"))
    return signals_of(mr, g.join(merged, "mr", "full"))


def signals_of(mr: DataFrame, seen: DataFrame) -> DataFrame:
    """seen(mr, first_comment, approved, first_bot, comments, approvals, bot_notes, merged): what
    others did. An approval that was dismissed leaves its time, but does not stand. reviewed is
    null where reviews are unknown: not read, or not read to the end and nothing human found."""
    for c in ("draft", "failed", "dismissed", "keyed"):
        mr = mr if c in mr.columns else mr.withColumn(c, F.lit(False))
    mr = mr if "detail" in mr.columns else mr.withColumn("detail", F.lit(True))
    mr = mr if "reviewers" in mr.columns else mr.withColumn("reviewers", F.lit(0))
    out = mr.join(seen, "mr", "left")
    read = ("first_comment", "approved", "first_bot", "comments", "approvals", "bot_notes")
    out = out.withColumns({c: F.when(F.col("detail"), F.col(c)) for c in read}).fillna(0, ["comments", "approvals", "bot_notes"])
    out = out.withColumn("approvals", F.when(F.col("dismissed"), 0).otherwise(F.col("approvals")))
    stated = F.when(F.col("merged").isNotNull(), "merged").otherwise(F.col("state") if "state" in mr.columns else F.lit("opened"))
    none = (F.col("comments") == 0) & (F.col("approvals") == 0)
    known = F.when(F.col("detail") & ~(F.col("failed") & none), ~none)
    out = out.withColumn("state", stated).withColumn("standing", F.when(F.col("approvals") > 0, F.col("approved")))
    return out.withColumn("touched", F.least("first_comment", "standing")).withColumn("reviewed", known)


def _times() -> dict[str, Column]:
    h, merged = ~F.col("bot"), ~F.col("bot") & (F.col("state") == "merged")
    known = h & F.col("reviewed").isNotNull()
    return {
        "first": F.when(known, hours_between("created", "touched")), "bot": F.when(known, hours_between("created", "first_bot")),
        "merge": F.when(merged, hours_between("created", "merged")), "lag": F.when(merged, hours_between("standing", "merged")),
    }


def review_metrics(signals: DataFrame) -> DataFrame:
    """A team's figures over what people opened; rates over what is known."""
    times = _times()
    wanted = {n: (v, {f"{n}_p50": 0.5, f"{n}_p90": 0.9} if n != "bot" else {"bot_p50": 0.5}) for n, v in times.items()}
    return review_counts(signals, times).join(percentiles(signals, ["team"], wanted), "team", "left")


def review_counts(signals: DataFrame, times: dict[str, Column] | None = None) -> DataFrame:
    """The counts of these figures alone, which need no percentiles."""
    h, reviewed, state = ~F.col("bot"), F.col("reviewed"), F.col("state")
    known, merged = h & reviewed.isNotNull(), h & (state == "merged")
    unseen = F.coalesce(merged & ~reviewed, F.lit(False))
    counts = {
        "by_bots": F.col("bot"), "by_people": h, "merged": merged, "open": h & (state == "opened"), "closed": h & (state == "closed"), "draft": h & F.col("draft"),
        "known": known, "reviewed": h & reviewed, "never_reviewed": h & ~reviewed, "bot_reviewed": known & (F.col("bot_notes") > 0), "merged_known": merged & reviewed.isNotNull(), "merged_unreviewed": unseen,
        "merged_alone": unseen & (F.col("reviewers") == 0), "approved_after_merge": merged & (F.col("standing") > F.col("merged")), "keyed": h & F.col("keyed"), "awaiting": _awaits(),
    }
    basis = [F.count(v).alias(f"{n}_basis") for n, v in (times or {}).items()]
    return signals.groupBy("team").agg(F.count("*").alias("total"), *(count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()), *basis)


def latency_histogram(signals: DataFrame) -> DataFrame:
    """Hours to the first human touch by bucket; empty buckets appear."""
    h = signals.where("not bot and reviewed is not null").withColumn("h", hours_between("created", "touched")).where("h is not null")
    bucket = F.lit(0)
    for e in EDGES[1:]:
        bucket = bucket + (F.col("h") >= e).cast("int")
    n = h.groupBy("team", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    axis = signals.select("team").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(EDGES) - 1))))
    return axis.join(n, ["team", "bucket"], "left").fillna(0, ["n"])


def _awaits() -> Column:
    return ~F.col("bot") & (F.col("state") == "opened") & ~F.col("draft") & ~F.col("reviewed")


def awaiting_review(signals: DataFrame, captured: Column) -> DataFrame:
    """Open requests that are no drafts and that nobody looked at, with how long they wait."""
    return signals.where(_awaits()).select("team", "mr", F.round(days_between("created", captured) * 24, 6).alias("open_hours"))


def practice(mr: DataFrame, note: DataFrame, signals: DataFrame) -> DataFrame:
    """By person: authored, merged with reviews known, of these without review, and MRs of
    others reviewed."""
    human = signals.where("not bot and detail").select("mr", F.col("author").alias("owner"))
    given = note.where("not bot and kind in ('comment', 'approval')").join(human, "mr").where("author != owner").groupBy(F.col("author").alias("person")).agg(F.count_distinct("mr").alias("given"))
    return practice_of(signals, given)


def practice_of(signals: DataFrame, given: DataFrame) -> DataFrame:
    """The same, where given(person, given) is counted already."""
    unseen = F.coalesce((F.col("state") == "merged") & ~F.col("reviewed"), F.lit(False))
    known = (F.col("state") == "merged") & F.col("reviewed").isNotNull()
    own = signals.where("not bot").groupBy(F.col("author").alias("person")).agg(F.count("*").alias("authored"), count_if(known).alias("merged_known"), count_if(unseen).alias("merged_unreviewed"))
    return own.join(given, "person", "full").fillna(0)


def identities_unknown(note: DataFrame, signals: DataFrame) -> DataFrame:
    """Teams, and whether who reviewed is missing from the data: people commented on or
    approved a request, and none of them has a name. That is not the same as nobody having
    reviewed anything."""
    named = note.where("not bot and kind in ('comment', 'approval') and trim(author) != ''").select("mr").distinct().withColumn("named", F.lit(True))
    rows = signals.where("not bot and detail").join(named, "mr", "left")
    silent = (F.col("comments") + F.col("approvals") > 0) & F.col("named").isNull()
    return rows.groupBy("team").agg(F.bool_or(F.coalesce(silent, F.lit(False))).alias("identities_unknown"))
