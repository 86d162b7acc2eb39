import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import core
from tidegauge.operators import rules, taxonomy
from tidegauge.sources import snapshots
from tidegauge.streaming import changelog_stream


def one(spark, ddl, value, f):
    return spark.createDataFrame([(value,)], f"v {ddl}").select(f(F.col("v")).alias("x")).first()["x"]


def test_percentiles(spark):
    v = spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 2.0)], "v double")
    assert v.agg(*(core.exact(F.col("v"), p) for p in (0.1, 0.5, 0.9))).first()[:] == (1.3, 2.5, 3.7)
    assert v.where("v > 9").agg(core.exact(F.col("v"), 0.5)).first()[0] is None


def test_rounding_and_keys(spark):
    assert one(spark, "double", -2.5, core.js_round) == -2
    assert one(spark, "string", "WEB-1: fix ABC-22, xWEB-3 (LOG-4) WEB-1", core.issue_keys) == ["ABC-22", "LOG-4", "WEB-1"]


@pytest.mark.parametrize(("text", "most", "want"), [(None, 9, None), (" \n ", 9, None), ("a\nb", 9, ("a · b", False)), ("one two three four", 15, ("one two three", True)), ("x" * 20, 8, ("x" * 8, True))])
def test_excerpt(spark, text, most, want):
    got = one(spark, "string", text, lambda v: core.excerpt(v, most))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("bodies", "want"), [(None, None), ([], None), (["fine", "still blocked"], "blocked"), (["unblocked, thanks"], None), (["resolved now", "waiting on ops"], None), (["blocked, waiting on x", "resolved"], "waiting on")])
def test_blocker_phrase(spark, bodies, want):
    assert one(spark, "array<string>", bodies, lambda v: rules.blocker_phrase(v, ["waiting on", "blocked"], ["unblocked", "resolved"])) == want


def test_parsing(spark):
    s = one(spark, "string", "com.x@1[id=7,name=S 1,state=ACTIVE,startDate=2026-01-01,endDate=<null>]", rules.parse_sprint)
    assert (s.id, s.name, s.state, s.endDate) == (7, "S 1", "active", None)
    assert one(spark, "string", "6145, 5462,,x", rules.sprint_ids) == [6145, 5462] and one(spark, "string", None, rules.sprint_ids) == []
    b = one(spark, "array<struct<type:string,key:string>>", [("is blocked by", "B-2"), ("blocks", "C-1"), ("Is Blocked By", "A-1"), ("relates", "Z-1")], rules.blockers)
    assert (b.blocked_by, b.blocks) == (["A-1", "B-2"], ["C-1"])


def test_health_and_outlook(spark):
    rows = spark.createDataFrame([("a", None, None, None, None), ("b", 0.5, 0.6, 0.1, 0.1), ("c", 0.5, 0.1, 0.1, 0.1), ("d", 0.1, 0.1, None, 0.1)], "team string, review double, carryover double, estimation double, spread double")
    assert [r.health for r in rules.team_health(rows).orderBy("team").collect()] == ["unknown", "poor", "watch", "good"]
    load = spark.createDataFrame([("a", 10, 30, 0, 10), ("b", 10, 100, 0, 0), ("c", 9, 5, 8, 0)], "team string, issues long, points long, unestimated long, done_points long")
    fc, ln = spark.createDataFrame([(t, 28.0) for t in "abc"], "team string, p50 double"), spark.createDataFrame([(t, 14.0) for t in "abc"], "team string, median_days double")
    act = spark.createDataFrame([(t, "2026-01-15") for t in "abc"], "team string, e string").select("team", F.col("e").cast("timestamp_ntz").alias("end_ts"))
    out = rules.sprint_outlook(load, fc, ln, act, F.lit("2026-01-05").cast("timestamp_ntz"))
    assert [r.verdict for r in out.orderBy("team").collect()] == ["on-track", "will-not-land", "unknown"]


def test_blockers(spark):
    ddl = "team string, key string, category string, blockers array<string>"
    issue = spark.createDataFrame([("t", "A", "To Do", ["B", "C"]), ("t", "B", "Done", None), ("t", "C", "In Progress", ["B", "X"]), ("t", "D", "Done", ["C"]), ("t", "E", "To Do", ["C", "C", "A"])], ddl)
    assert sorted(r.key for r in taxonomy.open_blockers(issue).collect()) == ["A", "E"]
    assert [(r.key, r.holds, r.blocker_done) for r in taxonomy.blocker_graph(issue).orderBy("rank").collect()] == [("C", 2, False), ("A", 1, False), ("X", 1, False), ("B", 2, True)]


def board(points, people=True):
    who = {"accountId": "a", "displayName": "Dev One"} if people else None
    issue = {"key": "WEB-1", "issueType": "Story", "statusId": "3", "statusCategory": "Done", "created": "2026-08-01T00:00:00+0100", "resolutionDate": "nonsense", "dueDate": "2026-09-01", "assignee": who, "storyPoints": points, "sprintIds": [9, 5], "comments": []}
    return {"schemaVersion": 4, "capturedAt": "2026-09-01T09:00:00Z", "teams": [{"key": "web", "columns": [{"name": "Dev", "statusIds": ["3", "4"]}], "sprints": [{"id": 5, "name": "S", "state": "Active", "goal": " "}], "issues": [issue]}]}


def test_snapshots(spark, tmp_path):
    for day, end in (("2026-09-01", ".json.gz"), ("2026-09-02", ".json"), ("2026-09-03", None)):
        (tmp_path / day).mkdir()
        if end:
            raw = json.dumps(board(3 if end == ".json" else None)).encode()
            (tmp_path / day / f"jira{end}").write_bytes(gzip.compress(raw) if end.endswith("gz") else raw)
    (tmp_path / "changelog").mkdir()
    root = f"file://{tmp_path}"
    assert snapshots.dates(spark, root) == ["2026-09-01", "2026-09-02", "2026-09-03"]
    boards = snapshots.read(spark, root)
    rows = snapshots.issues(boards).orderBy("snapshot_date").collect()
    assert [(str(r.snapshot_date), r.points, r.assignee, r.resolved, r.comments, r.sprint_ids) for r in rows] == [("2026-09-01", None, "Dev One", None, [], [5, 9]), ("2026-09-02", 3.0, "Dev One", None, [], [5, 9])]
    assert rows[0].created.isoformat() == "2026-07-31T23:00:00" and snapshots.issues(boards, False).where("assignee is not null").count() == 0
    assert snapshots.read(spark, root, up_to="2026-09-01").count() == 1 and snapshots.read(spark, root, "none").count() == 0
    assert snapshots.issue_sprints(snapshots.issues(boards)).count() == 4 and snapshots.board_columns(boards).count() == 4
    assert {(r.state, r.goal) for r in snapshots.sprints(boards).collect()} == {("active", None)}
    one = snapshots.read_day(spark, root, "2026-09-02")
    for day in ("2026-09-01", "2026-09-02"):
        with pytest.raises(FileExistsError):
            snapshots.write(one, root, day, "jira")
    snapshots.write(one, root, "2026-09-01", "jira", force=True)
    assert not (tmp_path / "2026-09-01" / "jira.json.gz").exists() and [r.points for r in snapshots.issues(snapshots.read(spark, root)).collect()] == [3.0, 3.0]
    snapshots.write(one, root, "2026-09-05", "jira")
    assert snapshots.last_day(spark, root) == "2026-09-05" and snapshots.last_day(spark, root, before="2026-09-05") == "2026-09-02" and snapshots.last_day(spark, root, before="2026-09-01") is None
    with pytest.raises(ValueError, match="one row"):
        snapshots.write(snapshots.read(spark, root), root, "2026-09-06", "jira")
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_writing")]


def test_stream_keeps_each_entry_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    entry = lambda i, field="status": json.dumps({"entry_id": str(i), "key": "A-1", "at": f"2026-01-{i:02d}T00:00:00Z", "field": field, "from_": " ", "to_": "x"})
    src, log, ck = (f"file://{tmp_path}/{d}" for d in ("in", "log", "ck"))
    for n, ids in enumerate([(1, 2, 2), (2, 3), (1, 4)]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(entry, ids)) + "\n" + entry(9, "colour"))
        changelog_stream.append(changelog_stream.read(spark, src), log, ck).awaitTermination()
    rows = spark.read.parquet(log).collect()
    assert sorted(r.entry_id for r in rows) == ["1", "2", "3", "4"] and {r.from_ for r in rows} == {None}
    changelog_stream.daily_counts(changelog_stream.read(spark, src), f"{ck}2", "per_day").awaitTermination()
    assert spark.table("per_day").agg(F.sum("count")).first()[0] == 7
