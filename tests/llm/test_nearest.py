from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import SF01
from tidegauge.llm import nearest


def brute(rows, queries, k):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    out = {}
    for q in queries:
        s = (x * rows[q]).sum(1)
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_recall_of_the_corpus(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()}
    want = brute(rows, [i for i in rows if i % 20 == 0], 20)
    got = answers(nearest.op6_nearest(spark, SF01))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert recall(got, want) > 0.9
    assert all(abs(s - float((rows[q] * rows[i]).sum())) < 1e-12 for q, g in got.items() for i, s in g)


def test_clusters_norms_and_copies(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 100)
    monkeypatch.setattr(nearest, "ASKED", 7)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 3
    x = centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 16)) * 0.3
    x[500:1000] = x[500]  # one vector, five hundred times
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = answers(nearest.search(df, F.col("vec_id") % 50 == 0, 10))
    want = brute(dict(enumerate(x)), range(0, 1500, 50), 10)
    assert recall(got, want) > 0.9
    assert [i for i, _ in got[700]] == [i for i, _ in want[700]]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0]), (20, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, v int, bucket int")
    assert answers(nearest.search(df, F.col("vec_id") % 20 == 0)) == {0: [(1, 0.5), (9, -1.0)]}
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0


def test_repeated_ids_count_as_the_least_vector(spark):
    rows = [(1, [3.0, 1.0]), (1, [2.0, 5.0]), (1, [2.0, 4.0]), (2, [1.0, 0.0]), (None, [9.0, 9.0]), (None, [1.0, 1.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        assert answers(nearest.search(df, F.col("vec_id") == 2)) == {2: [(1, 2.0)]}


def compared(spark, n, k=10):
    """Pairs that meet in a bucket, of n vectors in clusters of about 40, and the recall."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((n // 40, 16))
    x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<double>")
    index = nearest.fit(df, k)
    ids = pa.array(range(n))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(x.tolist(), pa.list_(pa.float64()))], ["vec_id", "v"])
    asked = batch.slice(0, n // 50)
    places = [[(t, b, i) for out in task([rows]) for t, b, i in zip(*(out.column(c).to_pylist() for c in ("tab", "bucket", "vec_id")))] for task, rows in ((nearest._place(index), batch), (nearest._visit(index), asked))]
    size, held, met = Counter((t, b) for t, b, _ in places[0]), {}, {}
    for t, b, i in places[0]:
        held.setdefault((t, b), set()).add(i)
    for t, b, i in places[1]:
        met.setdefault(i, set()).update(held.get((t, b), ()))
    want = brute(dict(enumerate(x)), range(n // 50), k)
    return sum(size[t, b] for t, b, _ in places[1]), np.mean([len(met[q] & {i for i, _ in w}) / k for q, w in want.items()])


def test_work_grows_slower_than_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "VISIT_ROWS", 5)  # as if there were far more rows
    small, a = compared(spark, 1500)
    large, b = compared(spark, 12_000)
    assert min(a, b) > 0.9 and large < 0.4 * 64 * small


def test_probes_add_up_to_the_target():
    found = list(nearest.probes(np.array([0.3, 1.9]), 0.5, 0.9))
    assert len(found) == len(set(found)) and found[0] == nearest.code([0, 1])


def visits(index, x):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x.tolist(), pa.list_(pa.float64()))], ["vec_id", "v"])
    return sum(out.num_rows for out in nearest._visit(index)([batch])) / len(x)


def test_visits_stay_bounded_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(nearest, "VISIT_ROWS", 0)  # functions are limited by visits alone
    rng = np.random.default_rng(8)
    for n in (2000, 20_000):
        x = rng.standard_normal((n, 24))
        df = spark.createDataFrame(enumerate(x.tolist()), "vec_id long, v array<double>")
        assert visits(nearest.fit(df, 10), x[:200]) < 1.5 * nearest.VISITS * nearest.TABLES


def test_reach_is_measured_over_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 8))
    x = np.repeat(x, 2, axis=0) + rng.standard_normal((6000, 8)) * 0.001  # pairs, which a sample tears
    df = spark.createDataFrame(enumerate(x.tolist()), "vec_id long, v array<double>")
    monkeypatch.setattr(nearest, "SAMPLE", 300)
    index = nearest.fit(df, 1)
    d = np.linalg.norm(index.query(x[:300])[:, None] - index.data(x)[None], axis=2)
    d[np.arange(300), np.arange(300)] = np.inf
    assert 0.8 * np.quantile(d.min(1), 0.9) < index.reach < 1.2 * np.quantile(d.min(1), 0.9)
