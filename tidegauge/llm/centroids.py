"""Centroid clustering by sort-means (operator 11).

Vectors become integers, so that distances, sums and means are exact whatever the order of
rows. Each round orders, for each centroid, the others by their distance from it. A vector
starts from the centroid that held it, at distance d, and looks at the others in that order;
one that lies more than 2d from the start is farther from the vector than the start is, and
so are all after it. At exactly 2d it may lie as near and have the smaller number, so the
scan stops strictly beyond.

A round is one pass over the vectors that sends sums alone: a row for each cluster, component
and task. A task finds the assignment that a round starts from by going through the few
rounds since the assignments were last stored; after REPLAY rounds they are stored again. So
rounds don't rewrite the vectors, and a pass that loses an executor is simply done again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, map_batches, table

#: Production parameters of the contract query.
CLUSTERS, ROUNDS, SCALE, SALT = 8, 10, 1024, "3"
#: Rounds that a pass goes through at most before assignments are stored.
REPLAY = 5
#: Integers as large as these are no component: their squared distance leaves a long.
MOST = 1 << 31
#: Up to here products of doubles are exact sums of integers (64 components; see _exact).
SMALL = 1 << 22


def grid(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and v, integers floor(scale * x), of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(MOST / scale)))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == size)).where(F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", whole.alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the smallest digests; of equal ones the least vector.
    Rows without an id come last."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), -1 if found else 0)


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from one vector, exactly: in doubles where all sums
    stay under 2^53, in long integers where they fit, else in Python's integers."""
    high = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if high < SMALL and x.shape[1] <= 64:
        d = x.astype(np.float64) - c
        return np.einsum("nd,nd->n", d, d).astype(np.int64)
    if 4 * high * high * x.shape[1] < 1 << 62:
        d = x - c
        return np.einsum("nd,nd->n", d, d)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(1)


def scan(x: np.ndarray, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row of x and the squared distance, from where it was (at).
    Ties go to the smaller number."""
    apart = np.array([_exact(c, y) for y in c])
    to, best = at.copy(), np.zeros(len(x), apart.dtype if apart.dtype == object else np.int64)
    for a in np.unique(at):
        own = np.flatnonzero(at == a)
        start = _exact(x[own], c[a])
        if start.dtype == object:
            best = best.astype(object)
        order = sorted((j for j in range(len(c)) if j != a), key=lambda j: (apart[a][j], j))
        near, dist = np.full(len(own), a), start.copy()
        for j in order:
            open_ = np.flatnonzero(4 * start >= apart[a][j])  # lengths d and 2d, squared
            if not len(open_):
                break
            d = _exact(x[own[open_]], c[j])
            better = (d < dist[open_]) | ((d == dist[open_]) & (j < near[open_]))
            near[open_[better]], dist[open_[better]] = j, d[better]
        to[own], best[own] = near, dist
    return to, best


def _placed(batches, history: list[np.ndarray]):
    """Batches with their vectors, clusters and squared distances after the given rounds."""
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
        at, dist = b.column("cluster").to_numpy().astype(np.int64), None
        for c in history:
            at, dist = scan(x, at, c)
        yield b, x, at, dist


def _sums(history: list[np.ndarray]):
    def run(batches):
        k, size = history[0].shape
        n, s = np.zeros(k, np.int64), np.zeros((k, size), object)
        for _, x, at, _ in _placed(batches, history):
            n += np.bincount(at, minlength=k)
            for j in np.unique(at):
                s[j] += x[at == j].sum(0)
        full = np.flatnonzero(n)
        cluster, part = np.repeat(full, size), np.tile(np.arange(size), len(full))
        rows = [pa.array(cluster), pa.array(part), pa.array(n[cluster]), pa.array([int(v) for v in s[full].ravel()], pa.decimal128(38))]
        yield pa.RecordBatch.from_arrays(rows, ["cluster", "part", "n", "s"])

    return run


def _assign(history: list[np.ndarray], keep_vectors: bool):
    def run(batches):
        for b, _, at, dist in _placed(batches, history):
            fits = [int(d) if d < 1 << 63 else None for d in dist]
            tail = [b.column("v")] if keep_vectors else [pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at), *tail], ["vec_id", "cluster", "v" if keep_vectors else "distance"])

    return run


def _means(rows: DataFrame, history: list[np.ndarray]) -> np.ndarray:
    """The centroids after a round: floors of the means; an empty cluster keeps its own."""
    parts = map_batches(rows, _sums(history), "cluster long, part long, n long, s decimal(38,0)")
    found = parts.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # clusters x components
    c = history[-1].copy()
    for r in found:
        c[r["cluster"], r["part"]] = int(r["s"]) // r["n"]
    return c


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = 64, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared, of integers) of vectors(vec_id, embedding, ...),
    and the final centroids.

    Vectors that are null, have another length or hold null or non-finite components take no
    part; nor do those with a component of 2^31 / scale or more, whose squared distance no
    long holds (a distance that leaves a long for other reasons is null). Every row counts,
    so one that repeats an id or a vector weighs twice; a row without an id takes part and
    comes last where starts are chosen. With fewer than k vectors there are as many clusters.
    An empty table gives no rows and no centroids; other columns are not read.
    """
    steps = Steps(vectors.sparkSession, "centroids")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = steps.store("rows-0", grid(vectors, size, scale).withColumn("cluster", F.lit(0).cast("long")))
    history, name = [first_centroids(rows, k, salt)], "rows-0"
    if not len(history[0]):
        return rows.select("vec_id", "cluster", F.lit(None).cast("long").alias("distance")), history[0]
    for r in range(1, rounds + 1):
        history.append(_means(rows, history))
        if len(history) > REPLAY and r < rounds:
            rows = steps.store(f"rows-{r}", map_batches(rows, _assign(history[:-1], True), f"vec_id {kind}, cluster long, v array<long>"))
            steps.drop(name)
            history, name = history[-1:], f"rows-{r}"
    out = steps.store("assigned", map_batches(rows, _assign(history, False), f"vec_id {kind}, cluster long, distance long"))
    steps.drop(name)
    return out, history[-1]


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `embeddings`: one row for each vector that takes part; see cluster.
    Inertias are sums of distances, null where one of these is."""
    placed, centroids = cluster(table(spark, sf_dir, "embeddings"))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.col(c).cast("decimal(38,0)")))
    each = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(whole("distance").alias("s")).collect()}  # one row a cluster
    total = None if None in each.values() else sum(map(int, each.values()))
    fits = lambda s: None if s is None or s >= 1 << 63 else int(s)
    facts = [(j, fits(s), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in each.items()]
    of = F.broadcast(spark.createDataFrame(facts, "cluster long, cluster_inertia long, centroid_sha256 string"))  # CLUSTERS rows
    return placed.join(of, "cluster").select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", F.lit(fits(total)).cast("long").alias("inertia"), "centroid_sha256")


def op11_sql() -> str:
    """The same in SQL, round by round."""
    seed = f"SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 c, vec_id FROM (SELECT DISTINCT vec_id FROM x)"
    parts = [
        "kept AS (SELECT vec_id, embedding e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = 64)",
        f"x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) i, unnest(list_transform(e, lambda z: CAST(floor({SCALE}.0::DOUBLE * z::DOUBLE) AS BIGINT))) v FROM kept)",
        f"m0 AS MATERIALIZED (SELECT s.c, x.i, x.v FROM ({seed}) s JOIN x USING (vec_id) WHERE s.c < {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT x.vec_id, m.c, sum((x.v - m.v) * (x.v - m.v)) d FROM x JOIN m{r} m USING (i) GROUP BY 1, 2)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * {CLUSTERS} + c) c, min(d) d FROM d{r} GROUP BY 1)")
        if r < ROUNDS:
            mean = "CAST((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            parts.append(f"n{r} AS (SELECT a.c, x.i, {mean} v FROM a{r} a JOIN x USING (vec_id) GROUP BY 1, 2)")
            parts.append(f"m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(n.v, m.v) v FROM m{r} m LEFT JOIN n{r} n ON n.c = m.c AND n.i = m.i)")
    parts.append(f"sha AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) h FROM m{ROUNDS} GROUP BY c)")
    last = f"SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN sha USING (c)"
    return f"WITH {', '.join(parts)} {last}"
