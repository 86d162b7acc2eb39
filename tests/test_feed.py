"""A day's findings, what changed since the day before, and alert runs."""

import json

import pytest

from tests.test_series_of_snapshots import issue, team
from tidegauge.operators import feed
from tidegauge.operators.feed import Day


@pytest.fixture
def root(tmp_path):
    said = [{"id": "1", "created": "2026-02-01T00:00:00Z", "body": "blocked by the vendor"}]
    old = {"updated": "2026-01-20T00:00:00Z"}
    days = {
        "2026-02-02": [issue("A-1", "To Do", [5], 3) | {"flagged": True} | old, issue("A-2", "In Progress", [5], 2) | old],
        "2026-02-06": [issue("A-1", "Done", [5], 3) | old, issue("A-2", "In Progress", [5], 2) | old, issue("A-3", "To Do", [5]) | {"comments": said, "dueDate": "2026-02-01"}, issue("A-5", "To Do", [5], 20)],
    }
    for day, issues in days.items():
        (tmp_path / day).mkdir()
        (tmp_path / day / "jira.json").write_text(json.dumps({"schemaVersion": 4, "capturedAt": f"{day}T06:00:00Z", "teams": [team("a", issues)]}))
    (tmp_path / "2026-02-04").mkdir()
    return f"file://{tmp_path}"


def test_findings_and_changes(spark, root):
    day = Day(spark, root, "2026-02-06")
    got = {r.identity: r.severity for r in feed.findings(day).collect()}
    want = {"a|stale|A-2": "this-week", "a|overdue|A-3": "this-week", "a|blocker-in-comments|A-3": "this-week", "a|no-goal|": "watch", "a|unassigned|team": "this-week", "a|scope-churn|": "this-week"}
    assert got == want
    changed = {(r.kind, r.identity) for r in feed.changes(day).collect()}
    assert {("cleared", "a|flagged|A-1"), ("new", "a|overdue|A-3"), ("unchanged", "a|stale|A-2"), ("new", "a|scope-churn|")} <= changed
    first = feed.changes(Day(spark, root, "2026-02-02")).collect()
    assert first and {r.kind for r in first} == {"unchanged"}
    assert {(r.team, r.about) for r in feed.caveats(day).collect()} == {("a", "churn"), ("a", "comments")}


def test_alert_runs(spark, root):
    first = feed.alert(Day(spark, root, "2026-02-02")).collect()
    assert first and all(r.turn is None for r in first)
    assert {(r.identity, r.sends) for r in feed.read_state(spark, root).collect()} >= {("a|flagged|A-1", 0), ("a|stale|A-2", 0)}
    plan = feed.alert(Day(spark, root, "2026-02-06"), limit=2)
    got = {r.identity: (r.status, r.turn) for r in plan.collect()}
    assert got["a|stale|A-2"] == ("standing", None) and got["a|overdue|A-3"][0] == "new" and sum(t is not None for _, t in got.values()) == 2
    assert "a|no-goal|" not in got and "a|flagged|A-1" not in got
    state = {r.identity: r.sends for r in feed.read_state(spark, root).collect()}
    assert "a|flagged|A-1" not in state and state["a|stale|A-2"] == 0 and sorted(state.values())[-2:] == [1, 1]
    assert {r.status: (r.n, r.sent) for r in feed.headline(plan).collect()}["cleared"] == (0, 0)
    before = feed.read_state(spark, root).count()
    feed.alert(Day(spark, root, "2026-02-06"), dry_run=True).count()
    assert feed.read_state(spark, root).count() == before
