"""Percentiles by bins and running sums against the aggregate with one buffer."""

import random

from pyspark.sql import functions as F

from tidegauge.functions import ranks


def check(spark, rows):
    df = spark.createDataFrame(rows, "team string, n int, out string, v double, w double")
    asked = {"v": (F.col("v"), {"lo": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "hi": 1.0}), "w": (F.col("w"), {"w50": 0.5, "w_third": 1 / 3})}
    names = {o: (m, p) for m, (_, ps) in asked.items() for o, p in ps.items()}
    got = {r.team: r for r in ranks.percentiles(df, ["team"], asked).collect()}
    want = df.groupBy("team").agg(*(F.round(F.percentile(m, F.lit(p)), 6).alias(o) for o, (m, p) in names.items()), F.count("v").alias("n"), F.count("w").alias("m")).collect()
    assert {r.team for r in want if r.n or r.m} == got.keys()
    for r in want:
        assert all(got[r.team][o] == r[o] for o in names) if r.n or r.m else r.team not in got


def test_equal_to_the_aggregate(spark):
    rng = random.Random(4)
    sizes = {"a": 1, "b": 2, "c": 7, "d": 400, "e": 3000}
    rows = [(t, i, "x", rng.choice([rng.gauss(0, 3), rng.expovariate(0.01), -5.0, 0.0, -0.0, 1e12 * rng.random()]), None if t == "c" else float(rng.randint(0, 3))) for t, n in sizes.items() for i in range(n)]
    rows += [("none", 0, "x", None, None), ("half", 0, "x", None, 4.0), ("a", 1, "x", None, None)]
    check(spark, rows)


def test_close_values_share_a_bin(spark):
    check(spark, [("t", i, "x", 1000 + i % 97 * 1e-6, 5.0) for i in range(2000)])


def test_a_rank_between_two_bins(spark):
    check(spark, [("t", i, "x", float(v), float(-v)) for i, v in enumerate([1, 2, 3, 1000, 2000, 3000])])


def test_no_task_holds_a_whole_group(spark):
    """Of a large group only the values of few bins are fetched."""
    df = spark.range(200_000).select(F.lit("t").alias("team"), (F.col("id") / 7).alias("v"))
    got = ranks.percentiles(df, ["team"], {"v": (F.col("v"), {"p50": 0.5})})
    assert got.first().p50 == round(199_999 / 2 / 7, 6)
    bins = df.groupBy(ranks._bin("v").alias("bin")).count()
    assert bins.agg(F.max("count")).first()[0] < 200 and bins.count() < 50_000


def test_rows_are_derived_once(spark):
    """The bins and the values of those that are hit read the same counts."""
    rows = spark.range(2000).select((F.col("id") % 3).alias("team"), (F.col("id") % 97 / 7).alias("age")).repartition(3)
    found = ranks.percentiles(rows, ["team"], {"age": (F.col("age"), {"p50": 0.5})})
    assert found.count() == 3
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan or plan.count("Range (") == 1, plan
