"""Sweeps over stored pages read no further than they must."""

import json

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import payloads
from tidegauge.sources.stored_pages import sweep


@pytest.fixture
def root(tmp_path):
    row = lambda i, at: {"id": i, "title": f"t{i}", "state": "opened", "updated_at": at, "created_at": "2026-01-01T00:00:00Z", "references": {"full": f"g/p!{i}"}}
    pages = {
        "one": [[row(1, "2026-02-09T00:00:00Z"), row(2, "2026-02-08T01:00:00+01:00")], [row(3, "2026-02-08T00:00:00Z"), row(4, None), row(5, "2026-02-01T00:00:00Z")], [row(6, "2026-01-01T00:00:00Z")]],
        "two": [[row(7, "2025-01-01T00:00:00Z")], [row(8, "2024-01-01T00:00:00Z")]], "none": [],
    }
    for name, some in pages.items():
        (tmp_path / name).mkdir()
        for n, page in enumerate(some, 1):
            (tmp_path / name / f"{n}.json").write_text(json.dumps(page))
    (tmp_path / "one" / "10.json").write_text(json.dumps([row(9, "2020-01-01T00:00:00Z")]))
    return tmp_path


def ids(df):
    return sorted(r.id for r in df.collect())


def test_stops_at_the_first_stale_page(spark, root):
    assert ids(sweep(spark, str(root))) == list(range(1, 10))
    assert ids(sweep(spark, f"file://{root}", "2026-02-08")) == [1, 2, 3]
    for late in ("one/3.json", "one/10.json", "two/2.json"):  # pages that must not be read
        (root / late).write_text("no JSON")
    df = sweep(spark, str(root), "2026-02-08")
    assert ids(df) == [1, 2, 3]
    assert ids(sweep(spark, str(root)).where(F.col("updated_at") > F.lit("2026-02-08").cast("timestamp"))) == [1]
    assert ids(df.where("page = 1 and project = 'one'")) == [1, 2]  # other filters stay with Spark
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ">=" not in plan and "BatchScan stored_pages" in plan, plan  # the source has taken the filter
    with pytest.raises(Exception, match="JSON|Expecting value"):
        sweep(spark, str(root)).collect()


def test_requests_as_the_payloads_take_them(spark, root):
    raw = sweep(spark, str(root), "2026-02-08", payloads.MERGE_REQUEST)
    got = payloads.merge_requests(raw, []).collect()
    assert sorted((r.mr, r.title, r.project) for r in got) == [(1, "t1", "g/p"), (2, "t2", "g/p"), (3, "t3", "g/p")]
