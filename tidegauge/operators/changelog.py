"""Event logs: transitions, membership as of an instant, deltas and merges.

Table: changelog(key, entry_id, at, from_, to_).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def status_transitions(log: DataFrame) -> DataFrame:
    """Each change and how long the state before it had lasted."""
    w = W.partitionBy("key").orderBy("at", "entry_id")
    hours = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(w).cast("timestamp"))) / 3_600e6
    return log.select("key", "entry_id", "from_", "to_", F.round(hours, 6).alias("hours"))


def first_work_start(log: DataFrame, is_work: Column) -> DataFrame:
    """The first change of each key into a state of work."""
    return log.where(is_work).groupBy("key").agg(F.min(F.struct("at", "entry_id")).alias("m")).select("key", F.col("m.entry_id").alias("entry_id"))


def state_as_of(log: DataFrame, at: Column) -> DataFrame:
    """The state of each key at an instant, walked back from now: what the earliest later
    change came from, else what the latest change led to. An unset state is ''."""
    later = F.when(F.col("at") > at, F.struct("at", "entry_id", F.coalesce("from_", F.lit("")).alias("v")))
    now = F.max(F.struct("at", "entry_id", F.coalesce("to_", F.lit("")).alias("v")))
    return log.groupBy("key").agg(F.coalesce(F.min(later)["v"], now["v"]).alias("state"))


def name_index(rows: DataFrame, name: str, id_: str) -> DataFrame:
    """Names with their id where it is the only one, and how many they have."""
    g = rows.groupBy(F.col(name).alias("name")).agg(F.count_distinct(id_).alias("ids"), F.min(id_).alias("one"))
    return g.select("name", "ids", F.when(F.col("ids") == 1, F.col("one")).alias("id"))


def needing_fetch(issue: DataFrame, seen: DataFrame) -> DataFrame:
    """Keys never seen, or seen before their last update."""
    j = issue.join(seen, "key", "left")
    return j.where(F.col("seen").isNull() | (F.col("seen") < F.col("updated"))).select("key", F.col("seen").isNull().alias("new"))


def merge_entries(existing: DataFrame, fetched: DataFrame, key: str = "entry_id") -> DataFrame:
    """Append-only: an entry that is there stays as it is. Of copies that were fetched and
    differ, the least counts, in the order of their columns."""
    rest = [c for c in existing.columns if c != key]
    once = fetched.groupBy(key).agg(F.min(F.struct(*rest)).alias("m")).select(key, "m.*") if rest else fetched.select(key).distinct()
    return existing.unionByName(once.join(existing.select(key), key, "left_anti").select(*existing.columns))


def carry_forward(collected: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Collected rows, and the existing ones of keys that were not collected."""
    return collected.unionByName(existing.join(collected.select(key).distinct(), key, "left_anti").select(*collected.columns))


def diff_findings(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Findings by identity as new, escalated, eased, unchanged or cleared; a higher
    severity number is worse. Without a day before (None) there is no news: all are
    unchanged."""
    if before is None:
        return after.select("identity", F.lit(None).cast(after.schema["severity"].dataType).alias("was"), F.col("severity").alias("now"), F.lit("unchanged").alias("kind"))
    j = before.select("identity", F.col("severity").alias("was")).join(after.select("identity", "severity"), "identity", "full")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("severity").isNull(), "cleared").when(F.col("severity") > F.col("was"), "escalated").when(F.col("severity") < F.col("was"), "eased").otherwise("unchanged")
    return j.select("identity", "was", F.col("severity").alias("now"), kind.alias("kind"))


def next_state(state: DataFrame, today: DataFrame) -> DataFrame:
    """Alert state after a run: identities that are gone are dropped; severity changes and
    sends rise only where today's finding was sent. state(identity, severity, sends),
    today(identity, severity, sent)."""
    j = today.join(state.select("identity", F.col("severity").alias("was"), "sends"), "identity", "left")
    severity = F.when(F.col("sent") | F.col("was").isNull(), F.col("severity")).otherwise(F.col("was"))
    return j.select("identity", severity.alias("severity"), (F.coalesce("sends", F.lit(0)) + F.col("sent").cast("int")).cast("long").alias("sends"))


#: Changes in the order in which they are told.
TOLD = {"new": 0, "escalated": 0, "eased": 1, "cleared": 1, "unchanged": 2}


def change_counts(changes: DataFrame) -> DataFrame:
    """How many findings changed in each way; ways that none took are there with zero."""
    kinds = changes.sparkSession.createDataFrame([(k,) for k in TOLD], "kind string")
    return kinds.join(changes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").fillna(0)


def advance_seen(seen: DataFrame, asked: DataFrame, failed: DataFrame) -> DataFrame:
    """When each key's log was read last, after a run that asked for asked(key, updated). A
    key that failed keeps its time, so that it is asked for again; one that was read moves
    on even if it had no entries."""
    done = asked.join(failed.select("key"), "key", "left_anti").groupBy("key").agg(F.max("updated").alias("now"))
    j = seen.join(done, "key", "full")
    return j.select("key", F.greatest("seen", "now").alias("seen"))


def targets(needed: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids under which needed(key, pos) are asked for, in the order in which they are
    needed; keys without an id are left out."""
    return needed.join(ids.select("key", "id"), "key").select("pos", "key", "id")


def resolve_ids(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows(id, name) with the id that counts: their own, else the only one of their name in
    index(name, ids, id), else none; how says which."""
    j = rows.join(index.select("name", F.col("id").alias("named")), "name", "left")
    own = F.nullif(F.trim("id"), F.lit(""))
    how = F.when(own.isNotNull(), "id").when(F.col("named").isNotNull(), "name").otherwise("unresolved")
    return j.withColumn("resolved", F.coalesce(own, F.col("named").cast("string"))).withColumn("how", how).drop("named")


def resolved_transitions(log: DataFrame, index: DataFrame) -> DataFrame:
    """log(key, entry_id, at, from_id, from_name, to_id, to_name) with the ids of both ends and
    how the later one was told. A change whose later end has no id, neither of its own nor the
    only one of its name, is left out; an earlier end without one is null, and no reason to
    leave a change out. resolution_stats of resolve_ids counts what was left out."""
    to = resolve_ids(log.withColumns({"id": F.col("to_id"), "name": F.col("to_name")}), index)
    to = to.where("how != 'unresolved'").withColumns({"to_status": F.col("resolved"), "told": F.col("how")}).drop("resolved", "how")
    both = resolve_ids(to.withColumns({"id": F.col("from_id"), "name": F.col("from_name")}), index)
    return both.select("key", "entry_id", "at", F.col("resolved").alias("from_status"), "to_status", F.col("told").alias("how"))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """How many states were resolved by their id, by their name, or not at all."""
    return resolved.agg(*(F.count_if(F.col("how") == h).alias(n) for h, n in (("id", "by_id"), ("name", "by_name"), ("unresolved", "unresolved"))))
