"""What steps keep on disk, beside their results."""

import os
import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_repeats import brute, run
from tidegauge.llm import common, repeats


def variants(n, seed=5):
    """One passage in n texts, each with words of its own around and a cut of its own."""
    rng = random.Random(seed)
    words = lambda k: "".join(rng.choice("abcdefghé ") for _ in range(k))
    passage = words(400)
    return [words(rng.randrange(80)) + passage[rng.randrange(60) : 340 + rng.randrange(60)] + words(rng.randrange(80)) for _ in range(n)]


def tables(spark):
    base = common.work_dir(spark).removeprefix("file://")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def shuffle_files(spark):
    kept = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (kept.apply(i).getName() for i in range(kept.size())) if f.startswith("shuffle_")}


def test_a_steps_shuffle_goes_before_the_next_one(spark):
    """One round of cleaning left the files of the latest step until the next was done."""
    common.release(spark)
    before = shuffle_files(spark)
    common.stored(spark.range(0, 40_000, 1, 4).groupBy((F.col("id") % 30_000).alias("k")).count(), "step")
    end = time.time() + 3
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left


def test_wide_buckets_add_a_few_rows_a_text(spark, tmp_path, monkeypatch):
    """Each place of a wide bucket's texts was a row, some hundred a text, joined and stored in each round."""
    rows, store = {}, common.Steps.store

    def spy(self, name, df):
        if name.startswith("halves"):  # two Python steps in a stage take two workers a task
            assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        out = store(self, name, df)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(common.Steps, "store", spy)
    monkeypatch.setattr(repeats, "WIDE", 10)
    texts = variants(120)
    assert run(spark, tmp_path, texts) == brute(enumerate(texts))
    names = list(rows)
    within = names[names.index("cut") + 1 : names.index("found") if "found" in names else names.index("gone")]
    assert within, "no bucket was wide"
    assert max(rows[x] for x in within) <= 4 * rows["cut"]


def test_repeats_hold_no_copy_of_the_corpus(spark, monkeypatch):
    """The texts that take part lay packed beside the shuffles of every later step."""
    names, store = [], common.Steps.store
    monkeypatch.setattr(common.Steps, "store", lambda self, name, df: (names.append(name), store(self, name, df))[1])
    before = tables(spark)
    repeats.remove(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert "packed" not in names
    assert [x.rpartition("-")[0] for x in tables(spark) - before] == ["repeats-gone"]


def test_pipeline_drops_what_a_stage_has_read(spark):
    before = tables(spark)
    assert corpus_pipeline.run(spark, SF).count()
    assert [x.rpartition("-")[0] for x in tables(spark) - before if x.startswith("pipeline-")] == ["pipeline-packing"]
