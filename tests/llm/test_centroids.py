import hashlib

import numpy as np

from tidegauge.llm import centroids

from ..conftest import SF01

NAN, INF = float("nan"), float("inf")


def brute(rows, k=8, rounds=10, size=64):
    """rows: (vec_id, vector); the contract with Python's integers."""
    kept = [(i, [int(np.floor(float(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) and abs(x) < 2**21 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        at = [min(range(len(cs)), key=lambda j: (far(v, cs[j]), j)) for _, v in kept]
        if r < rounds:
            for j in range(len(cs)):
                own = [v for (_, v), c in zip(kept, at) if c == j]
                if own:
                    cs[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, c, far(v, cs[c])) for (i, v), c in zip(kept, at)), key=str), cs


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance) for r in df.collect()), key=str)


def test_contract_against_brute_force(spark):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    want, cs = brute(data)
    got = centroids.op11_centroids(spark, SF01).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    sums = {c: sum(d for _, x, d in want if x == c) for _, c, _ in want}
    for r in got:
        assert r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()


def test_ties_repeated_rows_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    few = [[float(x) for x in rng.integers(-1, 2, 3)] for _ in range(9)]  # many equal distances
    data = [(i % 40, few[int(rng.integers(9))]) for i in range(120)] + [(None, few[0]), (None, few[1])]
    data += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [NAN, 1.0, 1.0]), (205, [INF, 1.0, 1.0]), (206, [1e300, 0.0, 0.0]), (207, [1e6, -1e6, 0.5])]
    df = spark.createDataFrame([(i, v, i, 1) for i, v in data], "vec_id long, embedding array<double>, cluster long, v int")
    for rounds in (0, 1, 7, 12):
        got, cs = centroids.cluster(df, 5, rounds, 3)
        want, means = brute(data, 5, rounds, 3)
        assert rows_of(got) == want and cs.tolist() == means


def test_fewer_vectors_than_clusters_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.25, -0.5])], "vec_id long, embedding array<float>")
    got, cs = centroids.cluster(df, 8, 3, 2)
    assert len(cs) == 2 and sorted(r.distance for r in got.collect()) == [0, 0]
    got, cs = centroids.cluster(df.limit(0), 8, 3, 2)
    assert got.count() == 0 and len(cs) == 0


def test_scan_stops_early_and_is_exact():
    """Against all distances, from any start; far centroids are not looked at."""
    rng = np.random.default_rng(1)
    c = rng.integers(-2000, 2000, (20, 8))
    x = (c[rng.integers(0, 20, 500)] + rng.integers(-60, 60, (500, 8))).astype(np.int64)
    all_ = ((x[:, None] - c[None]) ** 2).sum(2)
    for at in (np.zeros(500, np.int64), all_.argmin(1), rng.integers(0, 20, 500)):
        to, dist = centroids.scan(x, at, c)
        assert (to == all_.argmin(1)).all() and (dist == all_.min(1)).all()
    seen, real = [], centroids._exact
    try:
        centroids._exact = lambda x, c: (seen.append(len(x)), real(x, c))[1]
        centroids.scan(x, all_.argmin(1), c)
    finally:
        centroids._exact = real
    assert sum(seen[20:]) < 500 * 5  # of 20 distances each
    for shift in (20, 28, 31):  # doubles, longs, Python's integers
        y, d = x << (shift - 12), c.astype(np.int64) << (shift - 12)
        assert [int(v) for v in centroids._exact(y, d[0])] == [sum((int(a) - int(b)) ** 2 for a, b in zip(r, d[0])) for r in y]
