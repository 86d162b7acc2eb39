"""The alert stream against the state that batch runs keep."""

from tidegauge.operators import changelog as cl
from tidegauge.streaming import alert_stream as al

#: Findings by run: identity, severity, sent.
RUNS = [
    [("a|stale|1", "this-week", False), ("a|overdue|2", "watch", False), ("b|stale|9", "act-now", False)],
    [("a|stale|1", "this-week", True), ("a|overdue|2", "act-now", False), ("c|flagged|3", "watch", True)],
    [("a|overdue|2", "act-now", True), ("c|flagged|3", "watch", False), ("b|stale|9", "act-now", True)],
    [("a|stale|1", "act-now", True), ("a|overdue|2", "watch", False), ("c|flagged|3", "this-week", False)],
    [("a|stale|1", "act-now", False), ("c|flagged|3", "this-week", True)],
]
KIND = "identity string, severity string, sent boolean"


def rows(df):
    return sorted((r.identity, r.severity, r.sends) for r in df.collect())


def by_day(spark):
    state, out = spark.createDataFrame([], "identity string, severity string, sends long"), []
    for run in RUNS:
        state = spark.createDataFrame(rows(cl.next_state(state, spark.createDataFrame(run, KIND))), "identity string, severity string, sends long")
        out.append(rows(state))
    return out


def test_five_runs_restarted_half_way(spark, tmp_path):
    paths = [f"file://{tmp_path}/{x}" for x in ("runs", "told", "checkpoint")]
    for n, run in enumerate(RUNS):
        al.land(spark.createDataFrame(run, KIND).repartition(2), paths[0], n)
        if n in (1, 4):  # started, ended, and started again
            al.follow(al.read(spark, paths[0], files=1), *paths[1:]).awaitTermination()
    told = spark.read.parquet(paths[1])
    assert [rows(al.state_of(told, n)) for n in range(5)] == by_day(spark)
    gone = sorted((r.identity, r.run, r.sends) for r in told.where("status = 'cleared'").collect())
    assert gone == [("a|overdue|2", 4, 1), ("a|stale|1", 2, 1), ("b|stale|9", 1, 0), ("b|stale|9", 3, 1)]
    news = {(r.identity, r.run): r.status for r in told.collect()}
    assert news["a|overdue|2", 1] == "escalated" == news["a|overdue|2", 2] and news["a|overdue|2", 3] == "standing"
    assert news["a|stale|1", 3] == "new" and news["c|flagged|3", 3] == "escalated" == news["c|flagged|3", 4]


def test_all_runs_at_once_repeated_and_odd_rows(spark, tmp_path):
    paths = [f"file://{tmp_path}/{x}" for x in ("runs", "told", "checkpoint")]
    for n, run in enumerate(RUNS):
        odd = [(None, "watch", True), (run[0][0], "watch", None)] if n < 2 else []
        al.land(spark.createDataFrame([*run, *odd], KIND), paths[0], n)
    al.land(spark.createDataFrame(RUNS[2], KIND), paths[0], 2)  # a run that was repeated
    al.follow(al.read(spark, paths[0]), *paths[1:]).awaitTermination()
    told = spark.read.parquet(paths[1])
    assert [rows(al.state_of(told, n)) for n in range(5)] == by_day(spark)
    assert told.count() == told.select("identity", "run", "status").distinct().count()
