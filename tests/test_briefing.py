"""Trees of groups, digests within a budget, and pages."""

import json

from pyspark.sql import functions as F

from tidegauge.operators import digest as dg
from tidegauge.operators import org
from tidegauge.sources import report


def test_tree_of_depth_three_with_levels_left_out(spark):
    boards = spark.createDataFrame([("t1", ["a", "x", "p"]), ("t2", ["a", "x", "q"]), ("t3", ["b", "y", "r"]), ("t4", ["b", "y", "r"]), ("t5", None), ("t1", ["a", "x", "p"])], "team string, path array<string>")
    people = spark.createDataFrame([("t1", "ann"), ("t2", "ann"), ("t2", "bo"), ("t3", "ann"), ("t3", "ann"), ("t4", None), ("t5", "cy")], "team string, person string")
    found = spark.createDataFrame([("t1", "act-now"), ("t1", "watch"), ("t4", "act-now"), ("t4", "act-now")], "team string, severity string")
    got = {r.node: (r.parent, r.kind, r.children, r.boards, r.people, r.acts) for r in org.tree(boards, people, found).collect()}
    assert got == {
        "estate": (None, "estate", 3, 5, 3, 3),
        # the second level has one child in each group and is left out
        "estate/a/x": ("estate", "group", 2, 2, 2, 1), "estate/b/y": ("estate", "group", 1, 2, 1, 2),
        "estate/a/x/p": ("estate/a/x", "group", 1, 1, 1, 1), "estate/a/x/q": ("estate/a/x", "group", 1, 1, 2, 0), "estate/b/y/r": ("estate/b/y", "group", 2, 2, 1, 2),
        "estate/a/x/p:t1": ("estate/a/x/p", "board", 0, 1, 1, 1), "estate/a/x/q:t2": ("estate/a/x/q", "board", 0, 1, 2, 0),
        "estate/b/y/r:t3": ("estate/b/y/r", "board", 0, 1, 1, 0), "estate/b/y/r:t4": ("estate/b/y/r", "board", 0, 1, 0, 2), "estate:t5": ("estate", "board", 0, 1, 1, 0),
    }


def test_groups_of_one_board_are_left_out(spark):
    boards = spark.createDataFrame([("t1", ["a"]), ("t2", ["b"])], "team string, path array<string>")
    none = spark.createDataFrame([], "team string, person string, severity string")
    assert {(r.node, r.parent) for r in org.tree(boards, none, none).collect()} == {("estate", None), ("estate:t1", "estate"), ("estate:t2", "estate")}
    assert org.tree(boards.limit(0), none, none).count() == 0
    groups = spark.createDataFrame([("t1", "P"), ("t2", "P"), ("t3", "A"), ("t4", None)], "team string, prefix string")
    assert [tuple(r) for r in org.by_prefix(groups).collect()] == [("P", 2), ("A", 1), ("t4", 1)]


def test_digest_stays_within_its_budget(spark):
    teams = spark.createDataFrame([('q"1',), ("b",)], "team string")
    rows = spark.createDataFrame([('q"1', i, f"k{i}", i / 3) for i in range(30)] + [("b", 1, None, None)], "team string, n int, key string, share double")
    many = dg.first(rows, 8, [F.desc("n")], key="key", share=dg.rounded("share"))
    sections = {"first": dg.facts(rows.groupBy("team").agg(F.count("*").alias("n")), n="n"), "many": many, "last": dg.facts(rows.where("n = 2"), key="key")}
    got = {r.team: r for r in dg.digest(teams, sections).collect()}
    doc = json.loads(got['q"1'].digest)
    assert doc["team"] == 'q"1' and doc["left_out"] == [] and doc["first"] == {"n": 30} and len(doc["many"]) == 8 and doc["many"][0] == {"key": "k29", "share": 9.7}
    assert json.loads(got["b"].digest) == {"team": "b", "left_out": [], "first": {"n": 1}, "many": [{"key": None, "share": None}], "last": None}
    assert all(r.size == len(r.digest) for r in got.values())
    cut = {r.team: r for r in dg.digest(teams, sections, 64).collect()}  # the list goes, the small part after it stays
    doc = json.loads(cut['q"1'].digest)
    assert cut['q"1'].left_out == "many" and doc["left_out"] == ["many"] and "many" not in doc and doc["last"] == {"key": "k2"}
    assert cut["b"].left_out == ""


PAGE = (
    '<!doctype html><html><head><meta charset="utf-8"><title>a&amp;b</title></head><body><h1>a&amp;b</h1>'
    "<section><h2>Work</h2><table><tr><th>Key</th><th>Points</th></tr><tr><td>K-1</td><td>3</td></tr><tr><td>&lt;K&gt;</td><td>–</td></tr></table><p>1 more</p></section>"
    '<section><h2>Done</h2><svg width="330" height="40"><rect x="120" y="0" width="200" height="14"/><text x="0" y="12">s1 4.0</text><rect x="120" y="20" width="50" height="14"/><text x="0" y="32">s2 1.0</text></svg></section></body></html>'
)


def test_a_page_for_each_team(spark, tmp_path):
    teams = spark.createDataFrame([("a&b",), ("c",)], "team string")
    work = spark.createDataFrame([("a&b", 1, "K-1", 3), ("a&b", 2, "<K>", None), ("a&b", 3, "K-3", 1)], "team string, n int, key string, points int")
    chart = spark.createDataFrame([("a&b", "done", "s1", 4.0), ("a&b", "done", "s2", 1.0), ("a&b", "other", "s1", 9.0)], "team string, series string, x string, y double")
    panels = [("Work", report.panel("Work", work, ["n"], {"Key": "key", "Points": "points"}, shown=2)), ("Done", report.bars("Done", chart, "done", ["x"]))]
    report.write(report.pages(teams, panels), f"file://{tmp_path}/out")
    found = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("team=*/part-*.txt")}
    assert len(found) == 2 and found["team=a&b"] == PAGE + "\n"
    assert found["team=c"].count("<p>not collected</p>") == 2
