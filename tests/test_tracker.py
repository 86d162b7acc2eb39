import json

import pytest

from tidegauge.sources import tracker

FIELDS = [
    ("summary", "Summary", False, ("string", None)), ("customfield_9", "Story point estimate", True, ("number", None)), ("customfield_3", "Story Points", True, ("number", None)),
    ("customfield_4", "Story points text", True, ("string", None)), ("customfield_1", "Runde", True, ("array", tracker.SPRINT_FIELD)), ("customfield_7", "Epos", True, ("any", tracker.EPIC_FIELD)),
    ("customfield_8", "Rang", True, ("any", tracker.RANK_FIELD)), ("customfield_5", "FLAGGED", True, ("array", None)), ("customfield_6", "Team", True, ("any", None)), ("team", "Team", False, ("any", None)),
]
MAP = tracker.FieldMap("customfield_1", ("customfield_3", "customfield_9"), "customfield_7", "customfield_8", "customfield_5", "customfield_6")


def raw(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def test_field_map(spark):
    fields = spark.createDataFrame(FIELDS, tracker.FIELD)
    assert tracker.field_map(fields) == MAP
    with pytest.raises(ValueError, match="no sprint field"):
        tracker.field_map(fields.where("id != 'customfield_1'"))


def comment(i, body, **more):
    return {"id": str(i), "body": body, "created": f"2026-01-0{i}T00:00:00Z", "author": {"displayName": f"P{i}"}, **more}


def test_issues(spark):
    adf = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "deep words"}]}]}
    full = {
        "key": "A-1", "id": 7,
        "fields": {
            "issuetype": {"name": "Bug"}, "summary": "", "description": adf, "status": {"name": "Dev", "id": "3", "statusCategory": {"name": "In Progress"}}, "priority": {"name": "High"}, "resolution": None,
            "resolutiondate": "nonsense", "created": "2026-01-02T03:04:05.000+0100", "duedate": "2026-02-01", "assignee": {"displayName": " Ann "}, "reporter": None, "customfield_3": "5", "customfield_9": 2.5,
            "customfield_7": "A-9", "customfield_8": "0|x", "customfield_5": [], "labels": ["b", "a"], "components": [{"name": "core"}], "parent": {"key": "A-2"}, "timespent": 60,
            "customfield_1": ["com.x@1[id=7,name=S 7,state=CLOSED,goal=<null>,startDate=2026-01-01]", {"id": 5, "name": "S 5", "state": "active"}, "no sprint", {"name": "none"}],
            "issuelinks": [{"type": {"outward": "blocks", "inward": "is blocked by"}, "outwardIssue": {"key": "B-1"}}, {"type": {"name": "Blocks", "inward": "is blocked by"}, "inwardIssue": {"key": "C-1"}}, {"outwardIssue": {"key": "D-1"}}],
            "comment": {"total": 12, "comments": [comment(1, "one"), comment(2, adf), comment(3, " "), comment(4, "four", updated="2026-01-09T00:00:00Z")]},
        },
    }
    bare = {"key": "A-2", "fields": {"customfield_5": [{"value": "Impediment"}], "customfield_1": {"id": 4}, "customfield_3": 0, "comment": {"comments": []}}}
    backlog = spark.createDataFrame([("A-2",), ("A-2",)], "key string")
    rows = {r.key: r for r in tracker.issues(raw(spark, full, bare, {"id": 3}, "{broken"), MAP, backlog).collect()}
    assert set(rows) == {"A-1", "A-2"}
    a, b = rows["A-1"], rows["A-2"]
    assert (a.id, a.issue_type, a.summary, tuple(a.description), a.status, a.status_id, a.category) == ("7", "Bug", None, ("deep words", False), "Dev", "3", "In Progress")
    assert (a.priority, a.resolution, a.resolved, a.created.isoformat(), str(a.due), a.assignee, a.reporter) == ("High", None, None, "2026-01-02T02:04:05", "2026-02-01 00:00:00", "Ann", None)
    assert (a.points, a.points_field, a.epic_key, a.rank, a.flagged, a.labels, a.components, a.parent_key, a.spent_seconds) == (2.5, "customfield_9", "A-9", "0|x", False, ["b", "a"], ["core"], "A-2", 60)
    assert a.sprint_ids == [5, 7] and {(s.id, s.name, s.state, s.goal) for s in a.sprints} == {(7, "S 7", "closed", None), (5, "S 5", "active", None)}
    assert [tuple(x) for x in a.links] == [("blocks", "outward", "B-1"), ("is blocked by", "inward", "C-1"), ("relates to", "outward", "D-1")]
    assert (a.blocked_by, a.blocks, a.comment_count, a.in_backlog) == (["C-1"], ["B-1"], 12, False)
    assert [(c.id, c.author, c.body, c.updated is not None) for c in a.comments] == [("4", "P4", "four", True), ("2", "P2", "deep words", False)]
    assert (b.issue_type, b.category, b.points, b.points_field, b.flagged, b.sprint_ids, b.comments, b.comment_count, b.in_backlog, b.description, b.links) == ("Unknown", "Unknown", 0.0, "customfield_3", True, [4], [], None, True, None, [])
    hidden = tracker.issues(raw(spark, full, {"key": "E-1"}), MAP, keep_people=False).orderBy("key").collect()
    assert hidden[0].assignee is None and hidden[0].comments[0].author is None and hidden[1].comments is None and hidden[1].sprint_ids == []


def test_epics_detail_and_sprints(spark):
    e = tracker.epics(raw(spark, {"id": 1, "key": "A-9", "name": "N", "summary": "N"}, {"key": "A-8", "summary": "S", "done": True}, {"key": "A-7"}, {"name": "x"}))
    assert sorted(map(tuple, e.collect()), key=lambda r: r[1]) == [(None, "A-7", "A-7", None, False), (None, "A-8", "S", "S", True), (1, "A-9", "N", None, False)]
    issues = tracker.issues(raw(spark, *({"key": k, "fields": {"customfield_7": "A-9" if k == "A-1" else None}} for k in ("A-1", "A-2", "A-3"))), MAP)
    read = tracker.issues(raw(spark, {"key": "A-1", "fields": {"description": "d"}}, {"key": "A-2", "fields": {"comment": {"total": 0, "comments": []}}}), MAP)
    got = {r.key: r for r in tracker.with_detail(issues, read.select("key", "description", "comments", "comment_count"), e).collect()}
    assert [(got[k].description and got[k].description.text, got[k].comments, got[k].epic_name) for k in ("A-1", "A-2", "A-3")] == [("d", None, "N"), (None, [], None), (None, None, None)]
    board = spark.createDataFrame([(1, "board", None), (2, "b", "closed")], "id long, name string, state string")
    own = spark.createDataFrame([(1, "issue", "active"), (3, "c", "future")], "id long, name string, state string")
    assert sorted(map(tuple, tracker.all_sprints(board, own).collect())) == [(1, "board", None), (2, "b", "closed"), (3, "c", "future")]
