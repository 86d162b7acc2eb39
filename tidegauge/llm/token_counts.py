"""Token counts with a digest cache (operator 10).

A text's key is the SHA-256 of its normalised content; the cache is a table partitioned by
tokenizer version and by the first byte of the key, which later runs find again. A run reads
the partitions in which its keys lie, once, and joins the stored counts; each other distinct
content is encoded and its count appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_ids
from .common import map_batches, new_path, stored, table, work_dir

CACHE_SCHEMA = "digest binary, n_tokens long"
#: Counts of another rule are not read; to be raised when counting or the layout changes.
RULE = 3
#: Counts that a file of the cache holds, about.
FILE_ROWS = 1_000_000
#: Digests that a task remembers to leave out copies before the shuffle.
LOCAL_DIGESTS = 200_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file, of the library that reads it, and of the rule."""
    import sentencepiece
    import tokenizers

    lib = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{lib} {RULE}".encode()).hexdigest()


def _pack(batches):
    """Texts compressed for the shuffle, one of each digest that this task has seen."""
    import zstandard

    z, seen = zstandard.ZstdCompressor(level=1), set()
    for b in batches:
        keep, out = [], []
        for d, t in zip(b.column("digest").to_pylist(), b.column("content").to_pylist()):
            if d not in seen:
                if len(seen) >= LOCAL_DIGESTS:
                    seen.clear()
                seen.add(d)
                keep.append(d)
                out.append(z.compress(t.encode()))
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(out, pa.binary())], ["digest", "packed"])


def _encoder(path: str):
    def encode(batches):
        import zstandard

        z, seen = zstandard.ZstdDecompressor(), set()
        for b in batches:
            keep, n = [], []
            for d, p in zip(b.column("digest").to_pylist(), b.column("packed").to_pylist()):
                if d not in seen:
                    if len(seen) >= LOCAL_DIGESTS:
                        seen.clear()
                    seen.add(d)
                    keep.append(d)
                    n.append(word_ids.count(path, z.decompress(p).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return encode


def fold_spaces(text: Column) -> Column:
    """ASCII white space as single spaces, none at the ends. Counts of a tokenizer that drops
    white space, and has none in its special tokens, stay as they are."""
    return F.trim(F.regexp_replace(text, r"[ \t-\r]+", " "))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of docs(doc_id, text, ...).

    cache: folder of the cache table, which is read if it is there and appended to; without
    one, the counts of this run go to a folder of its own. normalise: a change of the text
    that leaves its count alone (default: none); n_bytes is of the text as it stands. Null
    texts count as empty; repeated rows, and rows that share a doc_id or have none, each
    give a row; an empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    version, path = tokenizer_version(tokenizer), cache or new_path(spark, "token-cache")
    text = F.coalesce(F.col("text"), F.lit(""))
    content = (normalise or (lambda c: c))(text)
    digest = F.unhex(F.sha2(content, 256)).alias("digest")

    keys = stored(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest), "keys")
    wanted = keys.select("digest").distinct()
    cached = _read_cache(spark, path, version, keys)
    known = stored(wanted.join(cached, "digest", "left").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
    counts, misses = known.where("n_tokens IS NOT NULL"), known.where("n_tokens IS NULL").select("digest")
    missing = misses.count()
    if missing:
        packed = map_batches(docs.select(digest, content.alias("content")), _pack, "digest binary, packed binary")
        if not counts.isEmpty():  # else no text is known, and none need be left out
            packed = packed.join(misses, "digest")
        new = stored(map_batches(packed.repartition("digest"), _encoder(tokenizer), CACHE_SCHEMA), "new-counts")
        _write_cache(new, path, version, missing, "append")
        counts = counts.unionByName(new)
    counts = stored(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")  # a plain join side: Spark can split hot digests
    return keys.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def _part() -> Column:
    """The partition of the cache in which a digest lies: its first byte."""
    return F.conv(F.substring(F.hex("digest"), 1, 2), 16, 10).cast("int").alias("part")


def _write_cache(counts: DataFrame, path: str, version: str, n: int, mode: str) -> None:
    """About n counts as files of some FILE_ROWS, each of one partition."""
    pieces = -(-n // (256 * FILE_ROWS))
    spread = F.pmod(F.xxhash64("digest"), F.lit(pieces))
    rows = counts.select("digest", "n_tokens", _part()).repartition("part", spread)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/version={version}")


def _read_cache(spark: SparkSession, path: str, version: str, keys: DataFrame | None = None) -> DataFrame:
    """Digests and counts of this version in the partitions where the digests of keys lie (in
    all, without keys); tasks that were lost and run again, or runs side by side, may have
    stored one twice. None if there is no cache yet."""
    folder = f"{path}/version={version}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    rows = spark.read.schema(f"{CACHE_SCHEMA}, part int").parquet(folder)
    if keys is not None:
        rows = rows.where(F.col("part").isin([r["part"] for r in keys.select(_part()).distinct().collect()]))  # at most 256
    return rows.select("digest", "n_tokens")


def compact(spark: SparkSession, cache: str, tokenizer: str) -> int:
    """Write the counts of this tokenizer anew, each digest once, in few files; how many there
    are. Not to be run beside a run that uses the cache. Counts that are lost if it is broken
    off are encoded again by the next run; no cache is an empty one."""
    version = tokenizer_version(tokenizer)
    counts = stored(_read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "compacted")
    n = counts.count()
    if n:
        _write_cache(counts, cache, version, n, "overwrite")
    return n


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: one row for each row; null texts count as empty. Its
    cache lies in the shared folder, so a second run over the same texts encodes nothing."""
    import public_tokenizers

    docs, cache = table(spark, sf_dir, "documents"), f"{work_dir(spark)}/token-counts"
    counts = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache, fold_spaces)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
