"""Orders, sections that need a reader, unknown reviewers, configured boards."""

from pyspark.sql import functions as F

from tidegauge.functions.orders import ordered
from tidegauge.operators import groups, review, sections


def test_orders(spark):
    people = spark.createDataFrame([("b", 1, 2, 0, 0, 0), ("a", 1, 2, 0, 0, 0), ("c", 2, 2, 0, 0, 0), ("d", 1, 3, 0, 0, 0), ("e", 1, 2, 0, 0, 9)], "person string, active_boards int, boards int, open_in_active int, open_assigned int, authored int")
    assert [r.person for r in ordered(people, "estate_people").collect()] == ["c", "d", "e", "a", "b"]
    mix = spark.createDataFrame([("t", "x", 1), ("t", "a", 1), ("t", "z", 5), ("t", None, 1)], "team string, name string, issues int")
    assert [r.name for r in ordered(mix, "mix").collect()] == ["z", "a", "x", None]


def test_sections_that_need_a_reader(spark):
    changes = spark.createDataFrame([("t|stale|1", "new"), ("t|scope-churn|", "unchanged"), ("t|merge-lag|", "cleared"), ("u|odd|", "new")], "identity string, kind string")
    changed = sections.changed_sections(changes)
    assert sorted(map(tuple, changed.collect())) == [("t", "attention"), ("t", "review")]
    rows = [("t", "attention", "good", False), ("t", "review", "none", True), ("t", "churn", "poor", None), ("t", "act", None, False), ("u", "act", "good", False), ("u", "board", "watch", False), ("u", "trust", None, None)]
    acts = spark.createDataFrame([("t", 2), ("u", 0)], "team string, n int")
    got = {(r.team, r.section): r.open for r in sections.needs_reader(spark.createDataFrame(rows, "team string, section string, tone string, collapsed boolean"), acts, changed).collect()}
    assert got == {("t", "attention"): True, ("t", "review"): False, ("t", "churn"): True, ("t", "act"): True, ("u", "act"): False, ("u", "board"): True, ("u", "trust"): False}


def test_reviewers_without_names(spark):
    signals = spark.createDataFrame([(1, "a", False, True, 2, 0), (2, "b", False, True, 1, 0), (3, "c", False, True, 0, 0), (4, "d", True, True, 3, 0)], "mr int, team string, bot boolean, detail boolean, comments int, approvals int")
    note = spark.createDataFrame([(1, False, "comment", " "), (1, False, "comment", None), (2, False, "approval", "ann"), (1, True, "comment", "robot")], "mr int, bot boolean, kind string, author string")
    assert {r.team: r.identities_unknown for r in review.identities_unknown(note, signals).collect()} == {"a": True, "b": False, "c": False}


def test_configured_boards(spark):
    board = spark.createDataFrame([("late", 2, ["P", "Q"]), ("early", 1, ["P"]), ("none", 3, None)], "team string, pos int, prefixes array<string>")
    assert {r.prefix: r.team for r in groups.board_of_prefix(board).collect()} == {"P": "early", "Q": "late"}
    mr = spark.createDataFrame([("g", 1, "P-1 and P-2", "x"), ("g", 2, "Z-9", "Q-3-fix")], "grp string, mr int, title string, branch string")
    got = {(r.prefix, r.mentions, r.team) for r in groups.prefix_evidence(mr, board).collect()}
    assert got == {("P", 2, "early"), ("Q", 1, "late"), ("Z", 1, None)}
