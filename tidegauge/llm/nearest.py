"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 6).

Vectors are scaled into the unit ball and get one more component, which makes the largest
inner product the smallest distance. Each table hashes them by floor((a.x + b) / w) for a
few Gaussian directions a. A query visits buckets in the order in which its neighbours are
likely to lie there: a neighbour at distance r shifts a projection by r times a normal
variate, so a bucket's chance is a product of normal masses. Visits end when the chances
add up to the table's target. How far neighbours lie is measured with pilot queries against
all rows; the number of functions in a hash is the one with which those pilots cost least,
among those that ask for no more than VISITS buckets. Buckets are cut into blocks of bounded
size; the candidates of all tables are merged and ranked by the inner product in double
precision.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_batches, sorted_groups, stored, table

TABLES, WIDTH, SEED = 2, 1.6, 11
#: Chance that the index finds a neighbour, over all tables.
TARGET = 0.975
#: Rows and queries of a block, pilot queries, and rows of the sample that is measured.
BLOCK, ASKED, PILOTS, SAMPLE = 2048, 512, 64, 8192
#: Rows that a task gathers before it keeps each query's nearest.
GATHER = 200_000
#: Most functions of a hash, buckets that a pilot may visit in a table on average, and rows
#: that could be compared for what it costs to send a query to a bucket.
FUNCTIONS, VISITS, VISIT_ROWS = 24, 48, 500


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """Directions, offsets and measures of the data; all of fixed size."""

    a: np.ndarray  # tables x functions x (dimension + 1)
    b: np.ndarray
    norm: float  # the largest
    reach: float  # distance within which neighbours are expected

    def project(self, x: np.ndarray) -> np.ndarray:
        return (np.einsum("nd,tkd->ntk", x, self.a) + self.b) / WIDTH

    def data(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]], axis=1)

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))], axis=1)


def code(slots) -> int:
    """A bucket's number from its slots. Buckets that share one (64 bits are hashed) only
    bring each other candidates."""
    n = 1469598103934665603
    for s in slots:
        n = (n ^ (int(s) & 0xFFFF)) * 1099511628211 & 0x7FFFFFFFFFFFFFFF
    return n


def probes(f: np.ndarray, sigma: float, target: float):
    """Buckets of one table in the order of their chance, until these reach target."""
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    slots = []
    for x in f:
        near = range(math.floor(x - 5 * sigma), math.floor(x + 5 * sigma) + 1)
        slots.append(sorted(((phi((j + 1 - x) / sigma) - phi((j - x) / sigma), j) for j in near), reverse=True))
    chance = lambda at: math.prod(s[i][0] for s, i in zip(slots, at))
    first = (0,) * len(slots)
    heap, seen, total = [(-chance(first), first)], {first}, 0.0
    while heap and total < target:
        p, at = heapq.heappop(heap)
        total -= p
        yield code(s[i][1] for s, i in zip(slots, at))
        for d in range(len(at)):
            nxt = at[:d] + (at[d] + 1,) + at[d + 1 :]
            if nxt[d] < len(slots[d]) and nxt not in seen:
                seen.add(nxt)
                heapq.heappush(heap, (-chance(nxt), nxt))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _pilot_distances(index: Index, pilots: np.ndarray, ids: np.ndarray, k: int):
    """Squared distances of each pilot's k nearest among the rows of a task."""
    asked = index.query(pilots)

    def run(batches):
        best = np.full((len(asked), k), np.inf)
        for b in batches:
            x, own = _matrix(b.column("v")), b.column("vec_id").to_numpy()
            for at in range(0, len(x), BLOCK):
                d2 = np.maximum(2 - 2 * asked @ index.data(x[at : at + BLOCK]).T, 0)
                d2[ids[:, None] == own[None, at : at + BLOCK]] = np.inf
                both = np.concatenate([best, d2], axis=1)
                best = np.partition(both, k - 1, axis=1)[:, :k]
        pilot, near = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(pilot.astype(np.int32)), pa.array(best[pilot, near])], ["pilot", "d2"])

    return run


def _reach(rows: DataFrame, index: Index, pilots: np.ndarray, ids: np.ndarray, k: int) -> float:
    """Distance within which nine of ten pilots have their k nearest among all rows (all that
    there are, if fewer). A task sends k distances a pilot; one row a pilot comes back."""
    near = map_batches(rows.select("vec_id", "v"), _pilot_distances(index, pilots, ids, k), "pilot int, d2 double")
    place = F.row_number().over(W.partitionBy("pilot").orderBy("d2"))
    last = near.withColumn("place", place).where(F.col("place") <= k).groupBy("pilot").agg(F.max("d2").alias("d2")).collect()
    return float(np.quantile(np.sqrt([r["d2"] for r in last]), 0.9)) if last else 2.0


def _met(index: Index, x: np.ndarray, pilots: int) -> tuple[float, float]:
    """Buckets that a pilot visits in a table, and the share of the sample that it meets over
    all tables; endless visits where the pilots exceed VISITS."""
    asked, lie = index.project(index.query(x[:pilots])), index.project(index.data(x))
    visits = met = 0
    for t in range(TABLES):
        held = Counter(code(s) for s in np.floor(lie[:, t]))
        for f in asked[:, t]:
            for bucket in probes(f, index.reach / WIDTH, _target()):
                visits, met = visits + 1, met + held[bucket]
                if visits > VISITS * pilots * TABLES:
                    return math.inf, 1.0
    return visits / (pilots * TABLES), met / (pilots * len(x))


def fit(rows: DataFrame, k: int) -> Index | None:
    """Measure the data: rows(vec_id, v), all usable and of one length. Pilot queries come
    from a sample of about SAMPLE rows, from which the share of the rows that lie in visited
    buckets is taken too; the distances of their neighbours are over all rows. Functions are
    tried one by one: each more makes buckets smaller and asks for more of them."""
    m = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"), F.max(F.size("v")).alias("d")).first()
    if not m["n"]:
        return None
    share = min(1.0, SAMPLE / m["n"])
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share * 1_000_000).limit(2 * SAMPLE).toPandas()
    rng = np.random.default_rng(SEED)
    a, b = rng.standard_normal((TABLES, FUNCTIONS, m["d"] + 1)), rng.uniform(0, WIDTH, (TABLES, FUNCTIONS))
    index = Index(a[:, :1], b[:, :1], m["norm"], 2.0)
    if len(sample) < 3:
        return index
    x = np.stack(sample["v"].to_numpy()).astype(float)
    index.reach = max(_reach(rows, index, x[:PILOTS], sample["vec_id"].to_numpy()[:PILOTS], k), 1e-3)
    best, least = index, math.inf
    for functions in range(1, FUNCTIONS + 1):
        tried = Index(a[:, :functions], b[:, :functions], index.norm, index.reach)
        visits, met = _met(tried, x, min(PILOTS, len(x)))
        if visits == math.inf:
            break
        cost = met * m["n"] + visits * TABLES * VISIT_ROWS
        if cost < least:
            best, least = tried, cost
    return best


def _target() -> float:
    """Chance that one table finds a neighbour."""
    return 1 - (1 - TARGET) ** (1 / TABLES)


def _place(index: Index):
    """Rows with the table and bucket where they lie."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                f = np.floor(index.project(index.data(_matrix(b.column("v")))))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * len(f), pa.int32()), pa.array([code(s) for s in f[:, t]], pa.int64()), b.column("vec_id"), b.column("v")], ["tab", "bucket", "vec_id", "v"]
                    )

    return run


def _visit(index: Index):
    """Tables and buckets that each query visits, by the query's id."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                f, ids = index.project(index.query(_matrix(b.column("v")))), b.column("vec_id").to_pylist()
                out = [(t, bucket, ids[i]) for i in range(len(f)) for t in range(TABLES) for bucket in probes(f[i, t], index.reach / WIDTH, _target())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], ["tab", "bucket", "vec_id"])

    return run


def _search(k: int):
    def run(batches):
        for _, group in sorted_groups(batches, ["tab", "bucket", "block", "part"]):
            q, c = group.filter(group["is_query"]), group.filter(pa.compute.invert(group["is_query"]))
            if not len(q) or not len(c):
                continue
            ids = c["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = np.ascontiguousarray(_matrix(c["v"])[order]), ids[order]
            qs, qids = _matrix(q["v"]), q["vec_id"].to_numpy()
            for a in range(0, len(qs), 256):
                s = qs[a : a + 256] @ x.T
                s[qids[a : a + 256, None] == ids[None]] = -np.inf
                for i in range(len(s)):
                    cut = np.partition(s[i], len(ids) - k)[len(ids) - k] if len(ids) > k else -np.inf
                    near = np.flatnonzero((s[i] >= cut - 1e-9 * (1 + abs(cut)) if np.isfinite(cut) else True) & np.isfinite(s[i]))
                    exact = (x[near] * qs[a + i]).sum(1)  # the same sum for equal vectors
                    best = np.argsort(-exact, kind="stable")[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qids[a + i])), pa.array(ids[near][best]), pa.array(exact[best])], ["query_id", "vec_id", "score"])

    def gathered(batches):  # a query's nearest of all blocks that this task has met
        parts, n = [], 0
        for b in run(batches):
            parts.append(b)
            n += b.num_rows
            if n >= GATHER:
                best = _best(parts, k)
                parts, n = [best], best.num_rows
                if n > GATHER // 2:
                    yield best
                    parts, n = [], 0
        if n:
            yield _best(parts, k)

    return gathered


def _best(parts: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """The k nearest of each query, each vector once; ties to the smaller vec_id."""
    q, ids, score = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("query_id", "vec_id", "score"))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])  # both tables score a vector alike
    q, ids, score = q[once], ids[once], score[once]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    near = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < k
    return pa.RecordBatch.from_arrays([pa.array(q[near]), pa.array(ids[near]), pa.array(score[near])], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k nearest found of each query among vectors(vec_id, embedding, ...): query_id,
    rank, vec_id, score.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do
    those of another length than most, nor rows without a vec_id. vec_id names a vector: of
    rows that repeat one, the least vector counts, in the order of its components, and it is
    a query if any of them is. Equal scores are ranked by vec_id. A bucket of many rows or
    many queries, such as one of equal vectors, is searched in blocks of about BLOCK rows
    by ASKED queries, so that none is cut short and none is one task's work. An empty table
    gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    rows = vectors.where(usable(v) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (length["d"] if length else 0))
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query")), "vectors")
    index = fit(rows, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind, place = "tab int, bucket long, vec_id long, v array<double>", ["tab", "bucket"]
    base = map_batches(rows.select("vec_id", "v"), _place(index), kind)
    asked = stored(map_batches(rows.where("is_query").select("vec_id", "v"), _visit(index), "tab int, bucket long, vec_id long"), "visits")
    count = lambda df, size, name: df.groupBy(*place).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = stored(count(base, BLOCK, "blocks").join(count(asked, ASKED, "parts"), place), "bucket-sizes")
    one = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = [*place, "block", "part"]
    own = base.join(sizes, place).withColumn("block", one("blocks")).withColumn("part", each("parts"))
    asked = asked.join(sizes, place).withColumn("part", one("parts")).withColumn("block", each("blocks"))
    asked = asked.select(*names, "vec_id").join(rows.where("is_query").select("vec_id", "v"), "vec_id")
    both = own.select(*names, "vec_id", "v", F.lit(False).alias("is_query")).union(asked.select(*names, "vec_id", "v", F.lit(True).alias("is_query")))
    found = map_batches(both.repartition(*names).sortWithinPartitions(*names), _search(k), "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `embeddings`: queries are the rows whose vec_id is divisible by
    20. Unusable vectors take no part; see search for repeated ids and ties."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
