"""History from snapshots: three days, one of which lacks a team and one the boards."""

import json

import pytest

from tidegauge.__main__ import main
from tidegauge.operators import changelog as cl
from tidegauge.operators import review as rv
from tidegauge.operators import series as sr
from tidegauge.sources import snapshots


def issue(key, category, sprint_ids, points=None, status="1", resolved=None):
    return {"key": key, "issueType": "Story", "statusId": status, "statusCategory": category, "created": "2026-01-01T00:00:00Z", "resolutionDate": resolved, "storyPoints": points, "sprintIds": sprint_ids, "labels": []}


def team(key, issues, columns=(("Dev", ["1"]), ("Done", ["9"]))):
    sprint = {"id": 5, "name": "S", "state": "active", "startDate": "2026-02-01T00:00:00Z", "endDate": "2026-02-11T00:00:00Z"}
    return {"key": key, "columns": [{"name": n, "statusIds": s} for n, s in columns], "sprints": [sprint, {"id": 6, "name": "N", "state": "future"}], "issues": issues}


DAYS = {
    "2026-02-01": [team("a", [issue("A-1", "To Do", [5], 3), issue("A-2", "In Progress", [5], 2)]), team("b", [issue("B-1", "To Do", [5], 8)])],
    "2026-02-03": [team("a", [issue("A-1", "In Progress", [5], 5), issue("A-3", "To Do", [5], 1)])],
    "2026-02-06": [team("a", [issue("A-1", "Done", [5], 5, "9", "2026-02-05T12:00:00Z"), issue("A-3", "To Do", [6], 1), issue("A-4", "To Do", [5])]), team("b", [issue("B-1", "To Do", [], 8)])],
}


@pytest.fixture
def root(tmp_path):
    for day, teams in DAYS.items():
        (tmp_path / day).mkdir()
        (tmp_path / day / "jira.json").write_text(json.dumps({"schemaVersion": 4, "capturedAt": f"{day}T06:00:00Z", "teams": teams}))
    (tmp_path / "2026-02-04").mkdir()
    return tmp_path


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_history(spark, root):
    url = f"file://{root}"
    t = snapshots.series(spark, url)
    four = [t[n] for n in ("day", "day_issue", "day_member", "day_sprint")]
    assert rows(t["day"], "team", "d") == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    delta = rows(sr.sprint_delta(*four), "team", "d", "added", "removed", "reestimated", "resolved", "net_points")
    assert delta == [("a", 1, 1, 1, 1, 0, 1), ("a", 2, 1, 1, 0, 1, -1), ("b", 1, 0, 1, 0, 0, -8)]
    churn = rows(sr.churn_summary(*four), "team", "sprint_id", "observations", "opening", "late_additions", "churn_rate")
    assert churn == [("a", 5, 2, 5, 1, 1.2), ("b", 5, 1, 8, 0, 1.0)]
    assert rows(sr.burndown(*four), "team", "d", "committed", "remaining", "ideal") == [("a", 0, 5, 5, 4.875), ("a", 1, 6, 6, 4.65), ("a", 2, 5, 0, 2.375), ("b", 0, 8, 8, 7.8), ("b", 1, 0, 0, 0.0)]
    assert rows(sr.cycle_times(t["day"], t["day_issue"]), "key", "cycle_days", "censored") == [("A-1", 2.5, False)]
    assert rows(sr.column_dwell(*four, t["day_column"]), "key", "col", "dwell_days", "censored") == [("A-4", "Dev", 0.25, False)]
    flow = [r for r in rows(sr.cumulative_flow(*four, t["day_column"]), "team", "d", "place", "col", "n") if r[0] == "a"]
    assert flow == [("a", 0, 1, "Dev", 2), ("a", 0, 2, "Done", 0), ("a", 1, 1, "Dev", 2), ("a", 1, 2, "Done", 0), ("a", 2, 1, "Dev", 1), ("a", 2, 2, "Done", 1)]
    whole = {r.team: r for r in sr.team_history(*four, t["day_column"]).collect()}
    assert (whole["a"].days, whole["a"].observed_hours, whole["a"].sprint_id, whole["a"].slowest, whole["a"].flow_censored) == (3, 120.0, 5, "A-1", True)


def test_projection_reads_each_day_once(spark, root):
    url = f"file://{root}"
    assert snapshots.project(spark, url, "2026-02-03") == ["2026-02-01", "2026-02-03"]
    assert snapshots.project(spark, url) == ["2026-02-06"] and snapshots.project(spark, url) == []
    assert snapshots.series(spark, url, "2026-02-03")["day"].count() == 3
    snapshots.write(snapshots.read_day(spark, url, "2026-02-01"), url, "2026-02-06", "jira", force=True)
    assert rows(snapshots.series(spark, url)["day_issue"].where("d = 2"), "key") == [("A-1",), ("A-2",)]
    assert snapshots.series(spark, f"{url}/none")["day"].count() == 0


def test_review_of_snapshots(spark, tmp_path, capsys):
    seen = {"authorIsAutomation": False, "humanCommentCount": 0, "automatedCommentCount": 1, "humanApprovalCount": 0, "automatedApprovalCount": 0, "reviewerCount": 0, "firstHumanApprovalAt": "2026-01-02T00:00:00Z"}
    mr = lambda i, review, **more: {"id": i, "title": "t", "state": "opened", "draft": False, "createdAt": "2026-01-01T00:00:00Z", "issueKeys": [], "review": review, **more}
    some = [mr(1, None), mr(2, {**seen, "error": "x"}), mr(3, seen, projectPath="g/h/q"), mr(4, {**seen, "humanCommentCount": 1, "firstHumanCommentAt": "2026-01-01T06:00:00Z"}, state="merged", mergedAt="2026-01-03T00:00:00Z", issueKeys=["A-1"], title="A-1 fix", projectPath="g/p"), mr(5, {**seen, "authorIsAutomation": True})]
    (tmp_path / "2026-01-05").mkdir()
    (tmp_path / "2026-01-05" / "gitlab.json").write_text(json.dumps({"schemaVersion": 4, "capturedAt": "2026-01-05T00:00:00Z", "teams": [{"key": "a", "mergeRequests": some}]}))
    (tmp_path / "2026-01-05" / "jira.json").write_text(json.dumps({"schemaVersion": 4, "capturedAt": "2026-01-05T00:00:00Z", "teams": [team("a", [issue("A-1", "To Do", [5])])]}))
    main(["review", "--data", f"file://{tmp_path}", "--json"], spark)
    assert json.loads(capsys.readouterr().out)["by_people"] == 4
    main(["mapping", "--data", f"file://{tmp_path}", "--json"], spark)
    assert [(r["grp"], r.get("best"), r["verdict"]) for r in map(json.loads, capsys.readouterr().out.splitlines())] == [("g", "a", "possible"), ("g/h", None, "none")]
    m = rv.review_metrics(snapshots.review_signals(snapshots.read(spark, f"file://{tmp_path}", "gitlab", snapshots.REQUESTS))).first()
    assert (m.total, m.by_bots, m.by_people, m.known, m.reviewed, m.never_reviewed, m.awaiting, m.merged_known, m.merged_unreviewed, m.keyed) == (5, 1, 4, 2, 1, 1, 1, 1, 0, 1)
    assert (m.first_p50, m.first_basis, m.merge_p50, m.lag_basis) == (6.0, 1, 48.0, 0)


def test_log_upkeep(spark):
    ts = lambda *rows: spark.createDataFrame(list(rows), "key string, v string")
    seen, asked = ts(("a", "2026-01-01"), ("b", "2026-01-01"), ("z", "2026-01-09")), ts(("a", "2026-01-05"), ("b", "2026-01-05"), ("c", "2026-01-02"), ("z", "2026-01-02"))
    out = cl.advance_seen(seen.withColumnRenamed("v", "seen"), asked.withColumnRenamed("v", "updated"), ts(("b", "")))
    assert rows(out, "key", "seen") == [("a", "2026-01-05"), ("b", "2026-01-01"), ("c", "2026-01-02"), ("z", "2026-01-09")]
    need = spark.createDataFrame([("b", 0), ("a", 1), ("x", 2)], "key string, pos int")
    assert rows(cl.targets(need, ts(("a", "1"), ("b", "2")).withColumnRenamed("v", "id")), "pos", "key", "id") == [(0, "b", "2"), (1, "a", "1")]
    names = spark.createDataFrame([("Dev", 1, "7"), ("Twice", 2, None)], "name string, ids int, id string")
    got = cl.resolve_ids(spark.createDataFrame([("3", "Dev"), (" ", "Dev"), (None, "Twice"), (None, "New")], "id string, name string"), names)
    assert sorted((r.name, r.how, r.resolved) for r in got.collect()) == [("Dev", "id", "3"), ("Dev", "name", "7"), ("New", "unresolved", None), ("Twice", "unresolved", None)]
    assert tuple(cl.resolution_stats(got).first()) == (1, 1, 2)
    now = spark.createDataFrame([("x", 1)], "identity string, severity int")
    assert rows(cl.change_counts(cl.diff_findings(None, now)), "kind", "n") == [("cleared", 0), ("eased", 0), ("escalated", 0), ("new", 0), ("unchanged", 1)]
