import datetime
import gzip
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.test_library import board
from tidegauge.__main__ import COMMANDS, main
from tidegauge.sources import snapshots, upkeep


@pytest.fixture
def root(tmp_path):
    for day, points in (("2026-05-01", 1), ("2026-09-01", 3)):
        (tmp_path / day).mkdir()
        (tmp_path / day / "jira.json").write_text(json.dumps(board(points), indent=1))
    return tmp_path


def test_archive(spark, root):
    url, today = f"file://{root}", datetime.date(2026, 9, 2)
    before = (root / "2026-05-01" / "jira.json").read_text()
    assert [x[:2] for x in upkeep.archive(spark, url, today, dry_run=True)] == [("2026-05-01", "jira")] and (root / "2026-05-01" / "jira.json").exists()
    assert upkeep.archive(spark, url, today) == [("2026-05-01", "jira", len(before))]
    assert not (root / "2026-05-01" / "jira.json").exists() and gzip.decompress((root / "2026-05-01" / "jira.json.gz").read_bytes()).decode().rstrip("\n") == before
    assert upkeep.archive(spark, url, today) == [] and sorted(p.name for p in root.iterdir() if not p.name.startswith(".")) == ["2026-05-01", "2026-09-01"]
    assert snapshots.issues(snapshots.read(spark, url)).count() == 2


def test_coverage(spark, root):
    boards = snapshots.read(spark, f"file://{root}")
    got = {(str(r.snapshot_date), r.what, r.present, r.total) for r in upkeep.coverage_gaps(boards).collect()}
    assert got == {(d, w, 0, 1) for d in ("2026-05-01", "2026-09-01") for w in ("titles", "epics")}
    requests = spark.createDataFrame([(4, [("a", [("t", None), ("u", None)])], "2026-05-01"), (4, [("a", [("t", (1,))])], "2026-09-01"), (2, [("a", [("t", None)])], "2026-09-02")], "schemaVersion int, teams array<struct<key:string,mergeRequests:array<struct<title:string,review:struct<n:int>>>>>, snapshot_date string")
    context = spark.createDataFrame([([("a", []), ("b", None)], "2026-05-01"), ([("a", [("1",)]), ("b", None)], "2026-09-01")], "teams array<struct<key:string,pages:array<struct<id:string>>>>, snapshot_date string")
    more = {(str(r.snapshot_date), r.what, r.present, r.total) for r in upkeep.coverage_gaps(boards, requests, context).collect()}
    assert more - got == {("2026-05-01", "reviews", 0, 2), ("2026-05-01", "pages", 0, 2)}
    assert not upkeep.schema_status(boards).where("behind").count()
    teams = spark.createDataFrame([("a",), ("b",)], "team string")
    assert [r.team for r in upkeep.dropped_teams(teams, teams.where("team = 'a'")).collect()] == ["b"]


def test_upsert_log(spark):
    ddl = "date string, team string, finding string, severity int, text string, pos int"
    old = spark.createDataFrame([("d1", "t", "x", 1, "old", 0), ("d1", "t", "y", 3, "same", 1), ("d1", "t", "x", 2, "copy", 2), ("d0", "t", "z", 1, "z1", 3), ("d0", "t", "z", 1, "z2", 4)], ddl)
    new = spark.createDataFrame([("d1", "t", "x", 1, "new", 0), ("d2", "t", "x", 3, "added", 1), ("d2", "t", "x", 1, "later", 2)], ddl)
    assert [(r.text, r.severity) for r in upkeep.upsert_log(old, new).collect()] == [("same", 3), ("added", 3), ("new", 1), ("z1", 1), ("z2", 1)]
    assert upkeep.upsert_log(old.limit(0), new).count() == 2


@given(st.text(alphabet="ab\n", max_size=60), st.integers(1, 9))
def test_chunks(text, most):
    parts = upkeep.chunks(text, most)
    assert all(len(p) <= most for p in parts) or parts == [text]
    assert "".join(parts).replace("\n", "") == text.replace("\n", "")


def test_commands(spark, root, capsys):
    for command in COMMANDS.keys() - {"review", "alert", "mapping"}:
        main([command, "--data", f"file://{root}", "--json"], spark)
    out = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert {r.get("code") for r in out} >= {"done-without-resolution-date", "sprint-goal-missing"}
    main(["dates", "--data", f"file://{root}"], spark)
    assert capsys.readouterr().out.split() == ["2026-05-01", "2026-09-01"]
    main(["sprints", "--data", f"file://{root}", "--date", "2026-05-01", "--team", "web"], spark)
    assert "committed_issues" in capsys.readouterr().out
    for bad in (["quality", "--date", "2026-05-02"], ["review"], ["quality", "--team", "none"], ["trends", "--window", "0"]):
        with pytest.raises(SystemExit):
            main([*bad, "--data", f"file://{root}"], spark)
