"""The change log as a stream: entries arrive late and twice, the log keeps each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ENTRY = "entry_id string, key string, at timestamp, field string, from_ string, to_ string"
#: Fields that are kept; others are dropped where they are read.
KEPT = ("status", "resolution", "assignee", "sprint", "flagged", "points")


def read(spark: SparkSession, path: str) -> DataFrame:
    """New files of entries as they land; blank values count as missing."""
    rows = spark.readStream.schema(ENTRY).json(path).where(F.col("field").isin(*KEPT))
    return rows.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in ("from_", "to_")})


#: Folders of the log; a batch reads those of its own entries.
BUCKETS = 64


def identity() -> Column:
    """What makes an entry one: its id, or all that it says where that is missing or blank."""
    said = F.to_json(F.struct("key", F.unix_micros("at").alias("at"), "field", "from_", "to_"), {"ignoreNullFields": "false"})
    return F.coalesce(F.concat(F.lit("id:"), F.nullif(F.trim("entry_id"), F.lit(""))), F.concat(F.lit("said:"), F.sha2(said, 256)))


def append(entries: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append each entry once and end when what is there has been read. Whether an entry is
    new is asked of the log itself, in the folders where it would lie, so that none is too
    old; a batch that is run again adds nothing. Of copies that differ the least counts, in
    the order of their columns. Entries without an id are told apart by what they say. A log
    that lies in other folders is refused."""
    spark = entries.sparkSession
    if any(n == "_spark_metadata" or n.startswith("part-") for n in _names(spark, log)):
        raise ValueError(f"{log} is no log in buckets: copy its rows to a new folder")

    def add(batch: DataFrame, _: int) -> None:
        spark, names = batch.sparkSession, [c.split()[0] for c in ENTRY.split(", ")]
        new = batch.groupBy(identity().alias("one")).agg(F.min(F.struct(*names)).alias("e")).select("one", "e.*")
        new = new.withColumn("bucket", F.pmod(F.xxhash64("one"), F.lit(BUCKETS)).cast("int"))
        if _names(spark, log):
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            old = spark.read.schema(f"{ENTRY}, bucket int").parquet(log).where(F.col("bucket").isin(touched))
            new = new.join(old.select(identity().alias("had")), F.col("one") == F.col("had"), "left_anti")
        new.drop("one").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(log)

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The entries of a log; none where there is no log yet."""
    if not _names(spark, log):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(f"{ENTRY}, bucket int").parquet(log).drop("bucket")


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def daily_counts(entries: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Changes by day and field, as a table in memory."""
    n = entries.withWatermark("at", "1 day").groupBy(F.window("at", "1 day").alias("w"), "field").count()
    return n.select(F.col("w.start").alias("day"), "field", "count").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
