import numpy as np
import pytest

from tidegauge.llm import vector_dups as vd

NAN, INF = float("nan"), float("inf")


def brute(rows, threshold=0.95):
    """(n_links, component_id) of each row, by all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in (a, b))
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    root[find(b)] = find(a)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    return sorted(((k, n[i], least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def check(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, i, 1.0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, id long, v double, size string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vd.near_vectors(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("pivots", [1, 5])
def test_clusters_copies_and_tiles(spark, monkeypatch, pivots):
    monkeypatch.setattr(vd, "GROUP", 20)
    monkeypatch.setattr(vd, "STRIP", 7)
    monkeypatch.setattr(vd, "AGAIN", 11)
    monkeypatch.setattr(vd, "PIVOTS", pivots)
    rng = np.random.default_rng(pivots)
    centres = rng.standard_normal((6, 8))
    x = np.concatenate([centres[rng.integers(0, 6, 150)] + rng.standard_normal((150, 8)) * 0.25, rng.standard_normal((40, 8))])
    x[20:60] = x[20]  # one vector forty times
    x[60:70] = x[20] * 3
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])


def test_odd_vectors_ids_and_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.001, 1.0]), (9, [-1.0, 0.0]), (8, [2e300, 0.0]), (7, [5e-320, 0.0]), (6, [1.0, 0.0, 0.0]), (5, [1.0, 0.1, 0.0])]
    rows += [(20, None), (21, []), (22, [0.0, 0.0]), (23, [-0.0, 0.0]), (24, [NAN, 1.0]), (25, [INF, 1.0]), (26, [1.0, None]), (27, [-0.0, 3.0]), (28, [0.0, 3.0])]
    check(spark, rows)
    check(spark, [r for r in rows if r[0] not in (8, 7)], "float")


def test_chain_just_at_the_threshold(spark):
    """Neighbours on a circle are linked, those further apart aren't; all are one component."""
    turn = np.arccos(0.95) - 1e-9
    check(spark, [(100 - i, [float(np.cos(i * turn)), float(np.sin(i * turn))]) for i in range(19)])


def test_empty_table(spark):
    assert vd.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bound_is_rigorous():
    """Of all pairs at the threshold none is ruled out; most others are."""
    rng = np.random.default_rng(4)
    for size in (2, 64, 1500):
        x = rng.standard_normal((300, size))
        near = np.repeat(x, 4, 0)[:600] + rng.standard_normal((600, size)) * rng.uniform(0.2, 0.45, (600, 1))
        x, y = vd.unit(x), vd.unit(near)
        found = np.zeros((300, 600), bool)
        for r, c in vd.possible(x, y, 0.95):
            found[r, c] = True
        true = x @ y.T >= 0.95
        assert true.any() and not (true & ~found).any()
        if size == 64:
            assert found.sum() < 2 * true.sum() + 100


def test_cells_far_apart_share_no_tile(spark, monkeypatch):
    monkeypatch.setattr(vd, "GROUP", 16)
    rng = np.random.default_rng(6)
    x = np.eye(8)[rng.integers(0, 8, 320)] + rng.standard_normal((320, 8)) * 0.01
    rows = [(i, 1, 8, v.astype("<f8").tobytes()) for i, v in enumerate(x)]
    classes = spark.createDataFrame(rows, "id long, times long, size int, v binary")
    dealt = vd.tiles(classes, 0.95, "<f8", vd.Steps(spark, "test"))
    assert dealt.count() < 320 * 8  # 20 groups or more: all with all would be 320 * 20
