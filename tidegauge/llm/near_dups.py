"""MinHash near-duplicates with odd sketches (operator 7).

A document is its set of distinct word shingles. Documents with equal sets are one class.
Of each class come MinHash samples, banded for candidate search, and two parity bitmaps:
the odd sketch of the samples, whose XOR population count estimates the similarity, and one
of the whole set, whose XOR population count never exceeds the symmetric difference and so
rules out a pair for certain.

Links are found in rounds. First each class is compared with the smallest of its buckets;
then, bucket by bucket and only across components, those not yet linked are compared in
blocks: each class with its most similar few, at last with all that the bitmaps leave.
Candidates are confirmed on full sets. So a group of many near copies costs few exact
comparisons, and no link between components is left out.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Steps, held, map_batches, new_path, small_batches, sorted_groups, table, texts
from .components import components

#: Bands and samples of each: a pair at the threshold shares none with a chance of 4e-7.
BANDS, ROWS = 28, 4
SAMPLES = BANDS * ROWS
ODD_BITS, PARITY_BITS = 512, 2048
#: Names that no column of the input has.
ROW, BARE, ONCE = "__near_row", "__near_bare", "__near_once"
#: Similarity in per cent; the odd sketch's estimate may be under it by this much.
PERCENT, SLACK = 80, 0.25
#: Rows of a block on either side; partners of a class by round (none: all that are left).
LEFT, RIGHT = 256, 1024
ROUNDS = (3, 24, None)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(2718)
_A = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
SIG = "doc_id long, row_id binary, set_id binary, n long, bands array<long>, odd binary, parity binary"


class _WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(w)
        if len(self) < 60_000 and len(w) < 64:
            self[w] = h
        return h


def _words() -> _WordHash:
    return held(("word hashes",), _WordHash)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, k: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of a text; with fewer words
    the whole sequence is one; none without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    s = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def _parity(places: np.ndarray, bits: int) -> bytes:
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sign(s: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """Band keys, odd sketch of the MinHash samples, and parity bitmap of a set."""
    low = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(s), 4096):
        low = np.minimum(low, (s[a : a + 4096, None] * _A + _B).min(axis=0))
    keyed = _mix(low + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bands = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        bands = _mix(bands * np.uint64(0x9E3779B97F4A7C15) + keyed[i::ROWS])
    return bands.view(np.int64).tolist(), _parity(keyed % np.uint64(ODD_BITS), ODD_BITS), _parity(s % np.uint64(PARITY_BITS), PARITY_BITS)


def _signer(k: int):
    def run(batches):
        import xxhash

        for b in batches:
            rows = []
            for t in texts(b):
                s = shingles(t, k)
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), *(sign(s) if len(s) else ([], b"", b""))))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("row_id"), *cols], ["doc_id", "row_id", "set_id", "n", "bands", "odd", "parity"])

    return run


def _packed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array([zlib.compress(t.encode(), 1) for t in texts(b)], pa.binary())], ["row_id", "packed"])


def _confirm(k: int, percent: int):
    def run(batches):
        @lru_cache(maxsize=64)
        def of(packed: bytes) -> np.ndarray:
            return shingles(zlib.decompress(packed).decode(), k)

        for b in batches:
            keep = []
            for p, q in zip(b.column("p").to_pylist(), b.column("q").to_pylist()):
                x, y = of(p), of(q)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bits(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint64).reshape(len(parts), -1)


def _compare(most: int | None, percent: int):
    """Pairs of a block, from different components, that the bitmaps do not rule out, and how
    far apart they look: of each left row the `most` that look most similar, or all."""

    def run(batches):
        for _, g in sorted_groups(batches, ["key", "lc", "rc"]):
            side = g["left"].to_numpy(zero_copy_only=False)
            at, to = np.flatnonzero(side), np.flatnonzero(~side)
            if not len(at) or not len(to):
                continue
            ids, comp, n, lone = (g[c].to_numpy(zero_copy_only=False) for c in ("id", "comp", "n", "lone"))
            parity, odd = _bits(g["parity"]), _bits(g["odd"])
            x_out, y_out, far_out = [], [], []
            for i in at:
                ok = comp[to] != comp[i]
                ok &= ~lone[to] | (ids[to] > ids[i])  # a pair of two left rows is met once
                small, large = np.minimum(n[to], n[i]), np.maximum(n[to], n[i])
                j = to[ok & (100 * small >= percent * large)]
                if not len(j):
                    continue
                apart = np.bitwise_count(parity[j] ^ parity[i]).sum(1, dtype=np.int64)
                j, apart = (z[(100 + percent) * apart <= (100 - percent) * (n[j] + n[i])] for z in (j, apart))
                differ = np.bitwise_count(odd[j] ^ odd[i]).sum(1, dtype=np.int64)
                # of 2 * SAMPLES * (1 - J) differing samples, so many parity bits are odd
                expected = -ODD_BITS / 2 * np.log(np.maximum(1 - 2 * differ / ODD_BITS, 1e-3)) / (2 * SAMPLES)
                near = 1 - expected >= percent / 100 - SLACK
                j, apart = j[near], apart[near]
                far = apart / (n[j] + n[i])
                if most is not None and len(j) > most:
                    near = np.lexsort((ids[j], far))[:most]
                    j, far = j[near], far[near]
                x_out.append(np.full(len(j), ids[i]))
                y_out.append(ids[j])
                far_out.append(far)
            if x_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (x_out, y_out, far_out)], ["x", "y", "far"])

    return run


def _row_id():
    """Digest of a row's doc_id and text: rows of one digest are the same document."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))))


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text, ...).

    Two documents are linked if 100 * intersection >= percent * union of their shingle
    sets; component_id is the smallest doc_id reached, null if all that are reached are
    null. Null texts and texts without words have empty sets and are linked with nothing.
    Rows that repeat a doc_id, or have none, are documents that reach each other only if
    their sets do. kept: doc_id = component_id, nulls being equal, so that several rows of
    a component that share its smallest doc_id are kept (first_of_each keeps one). Sets are
    compared as 64-bit hashes of their shingles; equal ones are told by a 128-bit hash.
    """
    rows, own, first = _classed(docs, k, percent)
    out = rows.join(own.join(first, "comp"), "set_id", "left")
    comp = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def first_of_each(docs: DataFrame, k: int = 2, percent: int = PERCENT) -> DataFrame:
    """Of each component of near duplicates one row of docs; rows without words all stay. Of
    rows that share doc_id and text the one whose other columns, as JSON, come first."""
    rows, _, first = _classed(docs, k, percent)
    roots = first.select(F.col("first").alias("row_id"), F.lit(False).alias(BARE))
    keys = Steps(docs.sparkSession, "near").store("kept-rows", roots.union(rows.where("n = 0").select("row_id", F.lit(True)).distinct()))
    found = docs.withColumn(ROW, _row_id()).join(keys.withColumnRenamed("row_id", ROW), ROW)
    once = F.when(F.col(BARE), F.monotonically_increasing_id())  # rows of one digest are alike but for their other columns
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("")
    least = F.min_by(F.struct(*docs.columns), order).alias("row")
    return found.withColumn(ONCE, once).groupBy(ROW, ONCE).agg(least).select("row.*")


def _classed(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, row_id, set_id and n of the rows; own: set_id, id and comp of each class, an
    id of its component; first: of each comp the document that comes first by doc_id, nulls
    last, and its doc_id (least)."""
    steps = Steps(docs.sparkSession, "near")
    keyed = docs.select("doc_id", "text", _row_id().alias("row_id"))
    sig = steps.store("signatures", map_batches(keyed, _signer(k), SIG))
    rows = steps.store("rows", sig.select("doc_id", "row_id", "set_id", "n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id", "n", "bands", "odd", "parity"))
    classes = sig.where("n > 0").groupBy("set_id").agg(least.alias("m"))
    classes = steps.store("classes", classes.select("set_id", F.monotonically_increasing_id().alias("id"), "m.*"))
    steps.drop("signatures")

    # Round 0: each class with the smallest of each bucket, those of most shared bands first.
    spots = classes.select("id", F.explode("bands").alias("key"))
    stars = steps.store("stars", spots.groupBy("key").agg(F.min("id").alias("y"), F.max("id").alias("z")).where("y < z").select("key", "y"))
    spots = steps.store("spots", spots.join(stars, "key"))
    shared = spots.where("id != y").groupBy(F.col("id").alias("x"), "y").agg(F.count("*").alias("bands"))
    best = F.row_number().over(W.partitionBy("x").orderBy(F.desc("bands"), "y"))
    pairs = shared.withColumn("r", best).where("r <= 3").select("x", "y")
    wanted = steps.store("compared", classes.select("id", "row_id").join(spots.select("id").distinct(), "id"))
    texts_of = map_batches(keyed.select("row_id", "text"), _packed, "row_id binary, packed binary").join(wanted, "row_id")
    packed = steps.store("packed", texts_of.dropDuplicates(["row_id"]).select("id", "packed"))
    steps.drop("stars", "compared")
    own = _rounds(classes, spots.select("key", "id"), packed, pairs, k, percent)
    steps.drop("spots", "packed")
    first = classes.join(own, "id").groupBy("comp").agg(F.min(F.struct("none", "doc_id", "row_id")).alias("m"))
    first = steps.store("first", first.select("comp", F.col("m.doc_id").alias("least"), F.col("m.row_id").alias("first")))
    own = steps.store("own", classes.select("id", "set_id").join(own, "id").select("set_id", "comp"))
    steps.drop("classes")
    return rows, own, first


def _rounds(classes, spots, packed, pairs, k, percent) -> DataFrame:
    """id and comp of every class."""
    spark, links = classes.sparkSession, new_path(classes.sparkSession, "links")
    steps = Steps(spark, "rounds")

    def confirm(pairs: DataFrame) -> DataFrame:
        with_x = pairs.join(packed.select(F.col("id").alias("x"), F.col("packed").alias("p")), "x")
        with_y = with_x.join(packed.select(F.col("id").alias("y"), F.col("packed").alias("q")), "y")
        with small_batches(spark):
            map_batches(with_y.select("x", "y", "p", "q"), _confirm(k, percent), "x long, y long").write.mode("append").parquet(links)
        return components(spark.read.schema("x long, y long").parquet(links))

    comps = confirm(pairs)
    for most in ROUNDS:
        placed, buckets = _open_buckets(spots, comps, steps)
        if buckets.isEmpty():
            break
        pairs = steps.store("pairs", _open_pairs(classes, placed, buckets, most, percent))
        steps.drop("placed", "buckets")
        if pairs.isEmpty():
            break
        comps = confirm(pairs)
        steps.drop("pairs")
    return classes.select("id").join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def _open_buckets(spots, comps, steps) -> tuple[DataFrame, DataFrame]:
    """Where the classes lie, and the buckets that hold several components, with how their
    rows are dealt in blocks."""
    rows = steps.store("placed", spots.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")))
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    big = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("total"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    big = big.select("key", F.col("big.comp").alias("big"), blocks(F.col("total") - F.col("big.n"), LEFT).alias("nl"), blocks(F.col("total"), RIGHT).alias("nr"))
    return rows, steps.store("buckets", big)


def _open_pairs(classes, placed, buckets, most, percent) -> DataFrame:
    """Pairs across components within buckets, as the bitmaps leave them: of each row the
    `most` over all its buckets and their blocks, so that pairs grow with rows, or all."""
    rows = placed.join(buckets, "key").withColumn("lone", F.col("comp") != F.col("big"))
    rows = rows.join(classes.select("id", "n", "odd", "parity"), "id")
    chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "lc", "rc", "left", "id", "comp", "n", "lone", "odd", "parity"]
    left = rows.where("lone").withColumn("lc", chunk("nl")).withColumn("rc", each("nr")).withColumn("left", F.lit(True)).select(*cols)
    right = rows.withColumn("rc", chunk("nr")).withColumn("lc", each("nl")).withColumn("left", F.lit(False)).select(*cols)
    blocks = left.union(right).repartition("key", "lc", "rc").sortWithinPartitions("key", "lc", "rc")
    found = map_batches(blocks, _compare(most, percent), "x long, y long, far double").groupBy("x", "y").agg(F.min("far").alias("far"))
    if most is not None:  # over all buckets and blocks
        found = found.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("far", "y"))).where(F.col("r") <= most)
    return found.select("x", "y")


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: one row for each row; see near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
