import random
import re

import numpy as np
import pytest

from tests.conftest import SF01
from tests.llm.cases import TEXTS, docs, empty
from tidegauge.llm import near_dups
from tidegauge.llm.components import components


def shingle_set(t, k=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, k=2):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    near = {(i, j) for ids in by.values() if len(ids) > 1 for a, i in enumerate(ids) for j in ids[a + 1 :]}
    for i, j in near:
        n = len(sets[i] & sets[j])
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_corpus_as_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert got(near_dups.near_duplicates(spark.read.parquet(f"{SF01}/documents.parquet"))) == brute(texts)


def group(n, size=150, seed=5):
    """Near copies at about the threshold from each other, and a few far ones."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(2, 14)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "LEFT", 16)
    monkeypatch.setattr(near_dups, "RIGHT", 40)
    texts = group(240) + group(60, 30, 6) + TEXTS
    want = brute(dict(enumerate(texts)))
    assert len({c for _, c in want.values()}) > 30
    assert got(near_dups.near_duplicates(docs(spark, texts).repartition(3))) == want


def test_cases(spark):
    assert got(near_dups.near_duplicates(docs(spark))) == brute(dict(enumerate(TEXTS)))
    assert got(near_dups.near_duplicates(docs(spark), 5)) == brute(dict(enumerate(TEXTS)), 5)
    assert near_dups.near_duplicates(empty(spark)).count() == 0
    assert got(near_dups.near_duplicates(docs(spark, [None, "", " "]))) == {0: (0, 0), 1: (0, 1), 2: (0, 2)}


def test_bitmap_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
        b = np.concatenate([a[: rng.integers(100, 300)], rng.integers(0, 1 << 62, rng.integers(0, 90), dtype=np.uint64)])
        pa_, pb = (np.frombuffer(near_dups.sign(np.unique(x))[2], np.uint64) for x in (a, b))
        assert np.bitwise_count(pa_ ^ pb).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 9), (9, 7), (1, 2), (30, 2), (30, 31)], []])
def test_components(spark, edges):
    root = {}
    for x, y in edges:
        root.setdefault(x, x), root.setdefault(y, y)
    for _ in edges:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    rows = components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert {r.id: r.comp for r in rows} == root
