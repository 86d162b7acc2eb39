"""Near duplicates of embeddings by int8 tile products (operator 12).

Equal vectors are one class. Classes are dealt to cells around a few pivots and cells to
groups of bounded size; a tile is a pair of groups. In a tile, unit vectors are rounded to
eight bits, x = a q + e with a known length of e, and one integer matrix product compares
all of them. The product is off by no more than the lengths of the two e allow, so a pair
whose product, raised by that bound, stays under the threshold is none; only the others are
computed in full precision. A tile sends a count and one link to its component for each class
that has any, never its pairs.

Two cells need no tile if the angles of their members from some pivot lie so far apart that
no pair can be near. That prunes clustered vectors; where nothing is known but that vectors
differ, all cells are compared, and work grows with the square of the distinct vectors.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, map_batches, sorted_groups, table
from .components import components

#: Cosine from which two vectors are near duplicates.
THRESHOLD = 0.95
#: Classes of a group, cells at most, rows of a strip, pairs recomputed at a time.
GROUP, PIVOTS, STRIP, AGAIN = 4096, 64, 256, 16_384
#: What sums of rounded numbers may be off by, far above their machine precision.
ROUNDING = 1e-5
ID, TILE = "__vector_id", ["ca", "sa", "cb", "sb"]


def matrix(packed, size: int, kind: str) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    return np.frombuffer(b"".join(packed), kind).reshape(-1, size).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _bytes(v: list, kind: str) -> bytes | None:
    """The components as they are (floats), or times a power of two that brings the largest
    near one and keeps the cosine (doubles); None of a vector that links with nothing."""
    if not v or None in v:
        return None
    x = np.array(v, kind) + np.dtype(kind).type(0)  # there is one zero only
    high = float(np.abs(x).max())
    if not math.isfinite(high) or high == 0:
        return None
    return (x if kind == "<f4" else np.ldexp(x, -math.frexp(high)[1])).tobytes()


def _packed(kind: str):
    def run(batches):
        for b in batches:
            data = [_bytes(v, kind) for v in b.column("embedding").to_pylist()]
            ids = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in data]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(data, pa.binary())], ["vec_id", ID, "v"])

    return run


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight-bit integers q, scales a and the lengths of x - a q, for unit vectors x."""
    a = np.abs(x).max(1) / 127
    q = np.rint(x / a[:, None]).astype(np.int8)
    off = x - a[:, None] * q
    return q, a, np.sqrt(np.einsum("nd,nd->n", off, off))


def possible(x: np.ndarray, y: np.ndarray, threshold: float):
    """Strips of pairs of unit vectors whose cosine may reach the threshold: all that do are
    there. |x.y - ab q.p| <= |e||y| + |x||f| + |e||f|."""
    (q, a, e), (p, b, f) = quantised(x), quantised(y)
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums stay exact integers
    p = np.ascontiguousarray(p.T.astype(kind))
    b, f = b.astype(np.float32), f.astype(np.float32)
    for i in range(0, len(x), STRIP):
        s = (q[i : i + STRIP].astype(kind) @ p).astype(np.float32, copy=False)
        s *= a[i : i + STRIP, None].astype(np.float32)
        s *= b
        s += e[i : i + STRIP, None].astype(np.float32) * (1 + f.max(initial=0)) + f
        r, c = np.nonzero(s >= threshold - ROUNDING)
        yield r + i, c


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows, in double precision."""
    length = lambda z: np.sqrt(np.einsum("nd,nd->n", z, z))
    return np.einsum("nd,nd->n", x, y) / (length(x) * length(y))


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Let each end of links have the smallest label of what is connected."""
    while len(i):
        a, b = label[i], label[j]
        other = a != b
        if not other.any():
            return
        i, j, a, b = i[other], j[other], a[other], b[other]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _tile(x: np.ndarray, times: np.ndarray, left: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the classes of a tile: the least that each is connected with here, and how many
    other rows are linked to one of its own."""
    own, other = np.flatnonzero(left), np.flatnonzero(~left)
    alone = not len(other)  # a group with itself
    label, n, u = np.arange(len(x)), np.zeros(len(x), np.int64), unit(x)
    if alone:
        other = own
    for r, c in possible(u[own], u[other], threshold):
        for k in range(0, len(r), AGAIN):
            i, j = own[r[k : k + AGAIN]], other[c[k : k + AGAIN]]
            if alone:
                i, j = i[i < j], j[i < j]
            near = cosines(x[i], x[j]) >= threshold
            i, j = i[near], j[near]
            np.add.at(n, i, times[j])
            np.add.at(n, j, times[i])
            _join(label, i, j)
    return label, n


def _compare(threshold: float, kind: str):
    def run(batches):
        for (ca, sa, cb, sb), g in sorted_groups(batches, TILE):
            ids, times, left, sizes = (g[c].to_numpy(zero_copy_only=False) for c in ("id", "times", "left", "size"))
            data = g["v"].to_pylist()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                if (ca, sa) != (cb, sb) and left[at].min() == left[at].max():
                    continue
                label, n = _tile(matrix([data[i] for i in at], d, kind), times[at], left[at], threshold)
                full = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][full]), pa.array(ids[at][label[full]]), pa.array(n[full])], ["id", "root", "n"])

    return run


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(x) @ pivots.T, -1, 1))


def _cells(pivots: np.ndarray, kind: str):
    """Classes with their cell, the nearest pivot; those of other lengths lie in cell -1."""
    size_of = pivots.shape[1]

    def run(batches):
        for b in batches:
            size, data = b.column("size").to_numpy(), b.column("v").to_pylist()
            cell, at = np.full(len(size), -1), np.flatnonzero(size == size_of)
            if len(at):
                cell[at] = _angles(matrix([data[i] for i in at], size_of, kind), pivots).argmin(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "times", "size", "v")), pa.array(cell, pa.int32())], ["id", "times", "size", "v", "cell"])

    return run


def _spans(pivots: np.ndarray, kind: str):
    """Of each task, a row for each cell and pivot: members and the span of their angles."""

    def run(batches):
        spans: dict[int, tuple] = {}
        for b in batches:
            cells, data = b.column("cell").to_numpy(), b.column("v").to_pylist()
            for c in np.unique(cells):
                at = np.flatnonzero(cells == c)
                angle = _angles(matrix([data[i] for i in at], pivots.shape[1], kind), pivots) if c >= 0 else np.zeros((len(at), 1))
                low, high, n = spans.get(c, (np.inf, -np.inf, 0))
                spans[c] = np.minimum(low, angle.min(0)), np.maximum(high, angle.max(0)), n + len(at)
        rows = [(int(c), p, n, lo, hi) for c, (low, high, n) in spans.items() for p, (lo, hi) in enumerate(zip(low.tolist(), high.tolist()))]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["cell", "pivot", "n", "low", "high"])

    return run


def _pairs(spans, threshold: float) -> list[tuple[int, int, int, int]]:
    """cell, groups, other cell, its groups: cells that may hold a pair. Angles obey the
    triangle inequality, so members of a pair see each pivot under angles that differ by no
    more than the angle between them."""
    low, high, groups = {}, {}, {}
    for r in spans:
        low.setdefault(r["cell"], {})[r["pivot"]], high.setdefault(r["cell"], {})[r["pivot"]] = r["low"], r["high"]
        groups[r["cell"]] = math.ceil(r["n"] / GROUP)
    most = math.acos(max(-1, threshold)) + ROUNDING
    apart = lambda a, b: any(max(low[a][p] - high[b][p], low[b][p] - high[a][p]) > most for p in low[a])
    return [(a, groups[a], b, groups[b]) for a in groups for b in groups if a == b or (min(a, b) >= 0 and not apart(a, b))]


def tiles(classes: DataFrame, threshold: float, kind: str, steps: Steps) -> DataFrame:
    """The rows of classes(id, times, size, v) for each tile that they belong to."""
    n = classes.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if n is None:
        n = {"size": 0, "count": 0}
    many = max(1, min(PIVOTS, math.ceil(n["count"] / GROUP)))
    chosen = classes.where(F.col("size") == n["size"]).orderBy(F.xxhash64("v"), "id").limit(many).select("v").collect()
    pivots = unit(matrix([r["v"] for r in chosen], n["size"], kind)) if chosen else np.zeros((0, 0))
    celled = steps.store("cells", map_batches(classes, _cells(pivots, kind), "id long, times long, size int, v binary, cell int"))
    found = map_batches(celled, _spans(pivots, kind), "cell int, pivot int, n long, low double, high double")
    found = found.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # at most PIVOTS squared
    pairs = classes.sparkSession.createDataFrame(_pairs(found, threshold), "cell int, groups int, other int, parts int")
    own, of = F.struct("cell", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("part")), F.struct(F.col("other").alias("cell"), "part")
    rows = celled.join(F.broadcast(pairs), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("id", "times", "size", "v", own.alias("own"), of.alias("of")).withColumn("a", F.least("own", "of")).withColumn("b", F.greatest("own", "of"))
    names = [F.col(f"{x}.{y}").alias(f"{z}{x}") for x in ("a", "b") for y, z in (("cell", "c"), ("part", "s"))]
    return rows.select(*names, "id", "times", "size", "v", (F.col("own") == F.col("a")).alias("left"))


def links(classes: DataFrame, threshold: float, kind: str, steps: Steps) -> DataFrame:
    """id, root and n for each class and tile in which it has links."""
    dealt = tiles(classes, threshold, kind, steps).repartition(*TILE).sortWithinPartitions(*TILE)
    return steps.store("found", map_batches(dealt, _compare(threshold, kind), "id long, root long, n long"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, ...).

    Rows are linked if the cosine of their vectors, in double precision, is at least the
    threshold. n_links counts the other rows that a row is linked with; component_id is the
    smallest vec_id that it reaches, itself included; kept: vec_id = component_id, null ids
    being equal. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different length. Rows that repeat a vec_id are
    rows of their own, linked if their vectors are; a component of rows without an id has a
    null component_id. An empty table gives no rows; other columns are not read.
    """
    steps = Steps(vectors.sparkSession, "vectors")
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = map_batches(vectors.select("vec_id", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")), _packed(kind), f"vec_id long, {ID} binary, v binary")
    rows = steps.store("rows", rows)
    classes = rows.where(F.col(ID).isNotNull()).groupBy(ID).agg(F.count("*").alias("times"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    size = (F.octet_length("v") / int(kind[2])).cast("int").alias("size")
    classes = steps.store("classes", classes.select(ID, "times", "least", "v", size, F.monotonically_increasing_id().alias("id")))
    found = links(classes.select("id", "times", "size", "v"), threshold, kind, steps)
    comps = components(found.select(F.col("id").alias("x"), F.col("root").alias("y"))).withColumnRenamed("id", "of")
    counts = found.groupBy(F.col("id").alias("of")).agg(F.sum("n").alias("n"))
    known = classes.select(ID, "id", "times", "least").join(comps, F.col("id") == F.col("of"), "left").drop("of")
    known = known.join(counts, F.col("id") == F.col("of"), "left").withColumn("comp", F.coalesce("comp", "id"))
    known = steps.store("known", known.select(ID, "comp", "least", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n")))
    steps.drop("classes", "cells", "found")
    first = known.groupBy("comp").agg(F.min("least").alias("first"))
    facts = steps.store("facts", known.join(first, "comp").select(ID, "n", "first"))
    steps.drop("known")
    out = rows.select("vec_id", ID).join(facts, ID, "left")
    comp = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def op12_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `embeddings`: one row for each row; see near_vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_sql() -> str:
    """The same in SQL: all pairs, then the smallest id that each reaches."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) e, len(embedding) d FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = len(embedding) AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.vec_id x, b.vec_id y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.d = b.d
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {THRESHOLD}),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
n AS (SELECT x, count(*) n FROM link GROUP BY x), comp AS (SELECT x, min(y) c FROM reach GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, e.vec_id) AS component_id, e.vec_id = coalesce(comp.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN comp ON comp.x = e.vec_id"""
