"""Many languages, partitions and texts of one bucket; rows that differ in other columns only."""

import random

from pyspark.sql import functions as F

from tidegauge.llm import language_id, near_dups, repeats

from .test_repeats import brute, run

A = " ".join(f"a{i}" for i in range(60))


def test_a_thousand_languages(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(40)), f"l{i % 1003}") for i in range(3009)]
    df = spark.createDataFrame([*rows, (None, "a b c", "l0"), (1, None, "l1"), (2, "a b", None)], "doc_id long, text string, lang string")
    chosen = language_id._chosen(df, 0, 10)
    assert chosen.select("lang").distinct().count() == language_id.LANGS and chosen.columns == df.columns
    monkeypatch.setattr(language_id, "LANGS", 3)
    model = language_id.train(df)
    assert model.langs == ["l0", "l1", "l10"]  # l0 has one text more; the others are equal
    assert language_id.predict(df, model).count() == df.count()


def test_repeated_ids_over_a_thousand_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(4000).select((F.col("id") % 1500).alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("x").alias("start"))
        rows, _ = repeats._numbered(df, repeats.Steps(spark, "test"))
        got = sorted(rows.collect(), key=lambda r: r[repeats.NO])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r[repeats.NO] for r in got] == list(range(4000)) and [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_one_passage_in_thousands_of_texts(spark, tmp_path):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghij") for _ in range(170))
    texts = []
    for i in range(5000):
        at = rng.randrange(1, 160)
        own = passage[:at] + rng.choice("KLMN") + passage[at + 1 :] if i % 3 else passage  # variants and copies
        texts.append("".join(rng.choice("opqrs") for _ in range(12)) + own + "".join(rng.choice("tuvwx") for _ in range(12)))
    assert run(spark, tmp_path, texts) == brute(enumerate(texts))


def test_kept_and_the_row_that_stays(spark):
    kind = "doc_id long, text string, source string, n int"
    df = spark.createDataFrame([(1, A, "b", 1), (1, A + " z", "a", 1), (2, A, "c", 1), (3, "x", "b", 2), (3, "x", "b", None), (3, "x", "a", 5)], kind)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (3, 3, True)]
    for parts in (1, 4):
        got = sorted((r.doc_id, r.source, r.n) for r in near_dups.first_of_each(df.repartition(parts)).collect())
        assert len(got) == 2 and got[1] == (3, "a", 5)
