"""Exact percentiles of distributions of any size.

An aggregate that interpolates between ranks keeps a whole group in one buffer. Here values
are counted, and counts are summed up by narrow bins; running sums over the bins of a group
say in which of them a rank lies, and only the values of these bins are fetched. A bin is
about BINS-th of the size of its values, so a group has some ten thousand of them whatever
its rows, and no task holds more than a group's bins or a bin's distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bins for each factor of e in size.
BINS = 4096


def _bin(v: str) -> Column:
    """Never falls as v rises, also from below zero; equal on all machines (strict maths)."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * BINS)


def percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, dict[str, float]]]) -> DataFrame:
    """by and the wanted percentiles, by linear interpolation between closest ranks, rounded
    to six places: wanted gives, for a name, a measure and its percentiles, for example
    {"age": (age, {"median_age": 0.5, "age_p90": 0.9})}. Null measures don't count; a group
    without any has no row, one without values of a measure has null. Keys are not null.
    """
    each = F.array(*(F.struct(F.lit(m).alias("m"), c.cast("double").alias("v")) for m, (c, _) in wanted.items()))
    values = rows.select(*by, F.explode(each).alias("x")).select(*by, "x.*").where("v is not null")
    at = [*by, "m"]
    counts = values.groupBy(*at, "v").agg(F.count("*").alias("n")).withColumn("bin", _bin("v"))
    # Never null; the join below infers this for one of the two readers only, which were then derived apart.
    counts = counts.where("bin is not null and " + " and ".join(f"{c} is not null" for c in by))
    asked = rows.sparkSession.createDataFrame([(m, o, float(p)) for m, (_, ps) in wanted.items() for o, p in ps.items()], "m string, out string, p double")

    bins = counts.groupBy(*at, "bin").agg(F.sum("n").alias("n"))
    before = (F.sum("n").over(W.partitionBy(*at).orderBy("bin")) - F.col("n")).alias("before")
    bins = bins.select(*at, "bin", "n", before, F.sum("n").over(W.partitionBy(*at)).alias("all"))
    rank = F.col("p") * (F.col("all") - 1)
    bins = bins.join(F.broadcast(asked), "m").withColumn("rank", rank).withColumn("low", F.floor("rank")).withColumn("high", F.ceil("rank"))
    hit = bins.where("low < before + n and high >= before").select(*at, "bin", "out", "before", "rank", "low", "high")

    near = counts.join(hit, [*at, "bin"])
    end = F.col("before") + F.sum("n").over(W.partitionBy(*at, "out", "bin").orderBy("v"))
    near = near.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    of = lambda r: F.max(F.when((F.col(r) >= F.col("start")) & (F.col(r) < F.col("end")), F.col("v")))
    ends = near.groupBy(*at, "out").agg(of("low").alias("a"), of("high").alias("b"), F.first("rank").alias("rank"), F.first("low").alias("low"), F.first("high").alias("high"))
    value = F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((F.col("high") - F.col("rank")) * F.col("a") + (F.col("rank") - F.col("low")) * F.col("b"))
    told = ends.select(*by, "out", F.round(value, 6).alias("value"))
    return told.groupBy(*by).agg(*(F.max(F.when(F.col("out") == o, F.col("value"))).alias(o) for _, ps in wanted.values() for o in ps))
