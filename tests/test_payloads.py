import json

from pyspark.sql import functions as F

from tidegauge.functions import links
from tidegauge.operators import groups
from tidegauge.sources import payloads as pl


def rows_of(spark, tmp_path, schema, rows):
    path = tmp_path / "raw.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    return spark.read.schema(schema).json(f"file://{path}")


def user(name, **more):
    return {"id": name, "username": name, "login": name, "name": name.title(), **more}


def test_merge_requests(spark, tmp_path):
    note = lambda who, at, body="x", system=False: {"author": user(who), "created_at": at, "body": body, "system": system}
    mr = {
        "id": 7, "references": {"full": "a/b!12"}, "title": "WEB-3 then LOG-1", "work_in_progress": True, "created_at": "2026-01-01T00:00:00Z", "merged_at": "nonsense", "source_branch": "WEB-3-x", "author": user("ann"),
        "notes": [note("ann", "2026-01-01T01:00:00Z"), note("robot", "2026-01-01T02:00:00Z"), note("bob", "2026-01-02T05:00:00+0500"), note("bob", "2026-01-03T00:00:00Z"), note("cat", "2026-01-04T00:00:00Z", "Approved this merge request", True), note("cat", "2026-01-02T00:00:00Z", "changed the title", True)],
        "approved_by": [{"user": user("cat")}, {"user": user("robot")}],
    }
    bare = {"id": 8, "title": None, "author": None}
    out = pl.merge_requests(rows_of(spark, tmp_path, pl.MERGE_REQUEST, [mr, mr, bare]), ["ROBOT"], known=["WEB"]).orderBy("mr").collect()
    a, b = out
    assert (a.project, a.draft, a.merged, a.author, a.issue_keys) == ("a/b", True, None, "Ann", ["WEB-3"])
    r = a.review
    assert (r.human_comments, r.bot_comments, r.author_comments, r.human_approvals, r.bot_approvals, r.commenters, r.approvers) == (2, 1, 1, 1, 1, ["bob"], ["cat"])
    assert r.first_human_comment.isoformat() == "2026-01-02T00:00:00" and r.first_human_approval.day == 4 and r.first_bot_approval is None
    assert b.review.human_comments is None and not b.review.author_is_bot and b.issue_keys == []
    hidden = pl.merge_requests(rows_of(spark, tmp_path, pl.MERGE_REQUEST, [mr]), ["robot"], keep_people=False).first()
    assert hidden.author is None and hidden.review.commenters is None and hidden.review.human_comments == 2


def test_pull_requests(spark, tmp_path):
    pr = {
        "id": 1, "repo": "o/r", "title": "x", "state": "open", "created_at": "2026-01-01T00:00:00Z", "head": {"ref": "ABC-9"}, "user": user("ann"), "comments": [{"body": "hi", "created_at": "2026-01-05T00:00:00Z", "user": user("dep[bot]")}],
        "reviews": [{"body": " ", "state": "APPROVED", "submitted_at": "2026-01-03T00:00:00Z", "user": user("bob")}, {"body": "", "state": "APPROVED", "submitted_at": "2026-01-02T00:00:00Z", "user": user("bob")}, {"body": "why", "state": "COMMENTED", "submitted_at": "2026-01-04T00:00:00Z", "user": user("cat")}, {"body": "", "state": "APPROVED", "submitted_at": "2026-01-02T00:00:00Z", "user": user("ann")}],
    }
    p = pl.pull_requests(rows_of(spark, tmp_path, pl.PULL_REQUEST, [pr, {**pr, "id": 2, "merged_at": "2026-01-06T00:00:00Z"}, {**pr, "id": 3, "state": "closed"}]), []).orderBy("mr").collect()
    assert [x.state for x in p] == ["opened", "merged", "closed"] and p[0].issue_keys == ["ABC-9"]
    r = p[0].review
    assert (r.human_comments, r.bot_comments, r.human_approvals, r.first_human_approval.day, r.commenters) == (1, 1, 1, 2, ["cat"])


def test_change_items(spark, tmp_path):
    item = lambda f, i, a, b: {"field": f, "fieldId": i, "from": a, "to": b, "fromString": "", "toString": "T"}
    raw = {"issue_key": "A-1", "histories": [{"id": "1", "created": "2026-01-01T00:00:00Z", "items": [item("Sprint", "cf_1", "", "5"), item("Rank", "cf_2", "1", "2"), item("status", "", "1", "3")]}, {"id": None, "created": "2026-01-01T00:00:00Z", "items": [item("status", "", "1", "2")]}, {"id": "3", "created": "", "items": [item("status", "", "1", "2")]}]}
    got = pl.change_items(rows_of(spark, tmp_path, pl.HISTORY, [raw, {"issue_key": "A-2"}]), ["status", "cf_1"]).orderBy("field").collect()
    assert [(r.entry_id, r.field, r.from_id, r.to_id, r.from_name, r.to_name) for r in got] == [("1", "cf_1", None, "5", None, "T"), ("1", "status", "1", "3", None, "T")]


def test_wiki_pages(spark, tmp_path):
    hit = {"site": "https://s.example/", "reason": "mention", "url": "/spaces/ENG/pages/1", "excerpt": "a @@@hl@@@b@@@endhl@@@ &amp; c", "content": {"id": "1", "title": "T"}, "resultGlobalContainer": {"displayUrl": "/spaces/ENG", "title": "Eng"}}
    got = pl.wiki_pages(rows_of(spark, tmp_path, pl.SEARCH_HIT, [hit, {**hit, "reason": "space"}, {"site": "s", "reason": "recent", "id": "2", "excerpt": " &nbsp; "}, {"site": "s"}])).orderBy("page_id").collect()
    assert [(r.page_id, r.reason, r.url, r.space, r.excerpt) for r in got] == [("1", "space", "https://s.example/wiki/spaces/ENG/pages/1", "ENG", "a b & c"), ("2", "recent", "s/wiki", "?", None)]


def test_rich_text(spark):
    t = lambda s: {"type": "text", "text": s}
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [t("waiting on "), {"type": "mention", "attrs": {"text": "@Sam"}}, {"type": "hardBreak"}, {"type": "status", "attrs": {"text": "HOLD"}}]}, {"type": "paragraph", "content": [{"type": "date", "attrs": {"timestamp": "0"}}, {"type": "mention"}]}]}
    deep = t("end")
    for _ in range(300):
        deep = {"type": "doc", "content": [deep]}
    raws = [None, "", "plain {x", "{broken", json.dumps(doc), json.dumps(deep)]
    got = spark.createDataFrame(list(enumerate(raws)), "i int, v string").select("i", pl.rich_text(F.col("v")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [None, "", "plain {x", "{broken", "waiting on @Sam\n[HOLD]\n1970-01-01@user\n", "end"]


def test_links(spark):
    row = spark.createDataFrame([("s.example/", "A-1", ["A-1", "B-2"], 3)], "site string, key string, keys array<string>, n int").select(
        links.issue_url(F.col("site"), F.col("key")).alias("a"), links.search_url(F.col("site"), links.keys_query(F.col("keys"))).alias("b"), links.board_url(F.lit(" "), F.col("n")).alias("c"), links.wiki_space_url(F.col("site"), F.lit("")).alias("d"),
        links.forge_merge_requests_url(links.forge_origin(F.lit("https://f.example/x/y")), F.lit("/x")).alias("e"), links.sprint_report_url(F.col("site"), F.col("n"), F.col("n")).alias("f"),
    ).first()
    assert row.a == "https://s.example/browse/A-1" and row.b == "https://s.example/issues/?jql=key%20in%20%28A-1%2CB-2%29%20order%20by%20rank"
    assert (row.c, row.d, row.e) == ("", "", "https://f.example/groups/x/-/merge_requests?state=merged&sort=updated_desc")
    assert row.f.endswith("rapidView=3&view=reporting&chart=sprintRetrospective&sprint=3")


def test_same_people(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string").select(groups.normal_name(F.col("name")).alias("name"))
    got = groups.same_people(names("José  Ruiz", "Lee Ann", "Ann Marie Lee", "Bo", "", "Cy Young"), names("ruiz, jose", "Ann Lee", "bo", "Bo Young", None))
    assert sorted(map(tuple, got.collect())) == [("ann marie lee", "ann lee"), ("bo", "bo"), ("jose ruiz", "ruiz jose"), ("lee ann", "ann lee")]
