"""What workers of one step hold while another runs."""

from tests.conftest import SF
from tidegauge.llm import common, repeats


def test_a_worker_lets_go_of_another_steps_memo(monkeypatch):
    monkeypatch.setattr(common, "_HELD", {})
    monkeypatch.setattr(common, "_AT", [None])
    common.turn_to("packing")
    memo = common.held(("words",), dict)
    common.turn_to("packing")
    assert common.held(("words",), dict) is memo
    common.turn_to("repeats")
    assert not common._HELD


def test_steps_tell_workers_apart(spark):
    """Over one worker's tasks: a step that holds nothing clears what the one before held."""

    def keep(batches):
        common.held(("kept",), list)
        yield from batches

    def look(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._HELD)] * b.num_rows, pa.int64())], ["id"])

    rows = spark.range(40).repartition(8)
    common.map_batches(rows, keep, "id long").count()
    assert {r.id for r in common.map_batches(rows, look, "id long").collect()} == {0}


def test_pieces_are_cut_in_a_stage_of_their_own(spark, monkeypatch):
    """A broadcast would put two Python steps in one stage, and so twice as many workers."""
    plans, store = {}, common.Steps.store

    def spy(self, name, df):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return store(self, name, df)

    monkeypatch.setattr(common.Steps, "store", spy)
    repeats.remove(spark.read.parquet(f"{SF}/documents.parquet")).count()
    joins = [x for x in plans["cut"].splitlines() if "Join" in x and "piece" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_a_sweep_reaches_workers_that_idle(spark):
    """A step of one task left the memos of all workers but its own."""

    def keep(batches):
        common.held(("kept",), list)
        yield from batches

    def look(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._HELD)] * b.num_rows, pa.int64())], ["id"])

    seen = lambda: sum(r.id for r in spark.range(0, 40, 1, 40).mapInArrow(look, "id long").collect())
    common.map_batches(spark.range(0, 40, 1, 40), keep, "id long").count()
    assert seen()
    common.sweep(spark)
    assert seen() == 0
