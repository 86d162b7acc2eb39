"""The change log keeps entries that are far older than what it has seen."""

import json

from tidegauge.streaming import changelog_stream


def test_old_entries_come_late(spark, tmp_path):
    (tmp_path / "in").mkdir()
    entry = lambda i, at: json.dumps({"entry_id": i, "key": "A-1", "at": f"{at}T00:00:00Z", "field": "status", "from_": "a", "to_": "b"})
    src, log, ck = (f"file://{tmp_path}/{d}" for d in ("in", "log", "ck"))
    batches = [[("new", "2026-01-10")], [("old", "2019-03-01"), ("older", "2015-05-05"), ("old", "2019-03-01")], [("old", "2019-03-01"), ("new", "2026-01-10"), ("oldest", "2009-01-01")]]
    for n, rows in enumerate(batches):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(entry(*r) for r in rows))
        changelog_stream.append(changelog_stream.read(spark, src), log, ck).awaitTermination()
    assert sorted(r.entry_id for r in spark.read.parquet(log).collect()) == ["new", "old", "older", "oldest"]


def test_entries_without_ids_and_copies_that_differ(spark, tmp_path):
    (tmp_path / "in").mkdir()
    entry = lambda i, key, to="b": json.dumps({"entry_id": i, "key": key, "at": "2026-01-10T00:00:00Z", "field": "status", "from_": "a", "to_": to})
    src, log, ck = (f"file://{tmp_path}/{d}" for d in ("in", "log", "ck"))
    batches = [[entry(None, f"A-{n}") for n in range(5)] + [entry("", "A-9"), entry("x", "A-1", "d"), entry("x", "A-1", "c")], [entry(None, "A-3"), entry("  ", "A-9"), entry("x", "A-1", "a"), entry(None, "A-3", None)]]
    assert changelog_stream.read_log(spark, log).count() == 0
    for n, rows in enumerate(batches):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(rows))
        changelog_stream.append(changelog_stream.read(spark, src), log, ck).awaitTermination()
    got = [((r.entry_id or "").strip(), r.key, r.to_) for r in changelog_stream.read_log(spark, log).collect()]
    assert sorted(got, key=str) == sorted([*(("", f"A-{n}", "b") for n in range(5)), ("", "A-9", "b"), ("x", "A-1", "c"), ("", "A-3", None)], key=str)
