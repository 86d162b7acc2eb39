import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF, SF01
from tests.llm.cases import TEXTS, docs, empty
from tidegauge.llm import repeats


def brute(rows):
    """rows: (doc_id, text) in order."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, tmp_path, texts, ids=None):
    df = docs(spark, texts)
    if ids:
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(tuple(r) for r in repeats.op2_repeats(spark, str(tmp_path)).collect())


def mosaics(n=80, seed=3):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefé ") for _ in range(rng.choice([60, 99, 100, 101, 130, 260]))) for _ in range(12)]
    parts += ["ab" * 90, "x" * 150, " " * 99]
    return ["".join(rng.choice(parts) if rng.random() < 0.7 else str(rng.random()) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_cases(spark, tmp_path):
    assert run(spark, tmp_path, TEXTS) == brute(enumerate(TEXTS))


@pytest.mark.parametrize("wide", [2000, 3])
def test_mosaics(spark, tmp_path, monkeypatch, wide):
    monkeypatch.setattr(repeats, "WIDE", wide)
    monkeypatch.setattr(repeats, "CHUNK", 900)
    texts = mosaics() + TEXTS
    assert run(spark, tmp_path, texts) == brute(enumerate(texts))


def test_refined_buckets_are_those_of_equal_strings():
    rng = random.Random(8)
    for alphabet in ("ab", "abcdef", "a"):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([100, 103, 140, 176]))).encode() for _ in range(40)]
        parts += [parts[0], parts[1][:20] + parts[2][20:], parts[3][30:] + parts[4][:30]]
        x, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        pointer, at = repeats.refine(x, ends), {}
        for p, end in zip(parts, ends):
            for i in range(len(p) - 99):
                at.setdefault(p[i : i + 100], set()).add(int(pointer[end - len(p) + i]))
        assert all(len(v) == 1 for v in at.values()) and len({v for s in at.values() for v in s}) == len(at)


def test_bytes_are_compared_before_they_go():
    import zstandard

    text = bytes(range(200))
    ask = lambda p: pa.RecordBatch.from_pylist([{repeats.NO: 1, "packed": zstandard.compress(text), "found": [{"place": (1 << 9) + 20, "n": 3, "proof": p}]}])
    (got,) = repeats._trim(9)([ask(repeats.proof(text[20:122]))])
    assert got.column("n_removed").to_pylist() == [102] and got.column("n_spans").to_pylist() == [1]
    with pytest.raises(ValueError, match="share an identifier"):
        list(repeats._trim(9)([ask(repeats.proof(text[21:123]))]))


def test_long_text_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    monkeypatch.setattr(repeats, "PIECE", 512)
    part = "".join(random.Random(1).choice("abcdefgh é") for _ in range(5000))
    texts = [part + "x" * 300 + part[:2500], "q" + part, part[1000:] + "z" + part[:1200]]
    assert run(spark, tmp_path, texts) == brute(enumerate(texts))


def test_ids_large_negative_and_null(spark, tmp_path):
    texts = mosaics(20)
    ids = [-(1 << 62), 1 << 62, *range(5, 23)]
    want = brute(sorted(zip(ids, texts)))
    assert run(spark, tmp_path / "a", texts, ids) == want
    null = run(spark, tmp_path / "b", ["q" * 60 + "z" * 60, "q" * 60 + "z" * 60], [7, 7])
    assert sorted(r[2] for r in null) == [0, 120]


def test_corpus_as_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(tuple(r) for r in repeats.op2_repeats(spark, SF).collect()) == brute(rows)


def test_larger_corpus_as_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect())
    assert sorted(tuple(r) for r in repeats.op2_repeats(spark, SF01).collect()) == brute(rows)


def test_empty_and_removal(spark):
    assert repeats.remove(empty(spark)).count() == 0
    clash = spark.createDataFrame([(2, "ab" * 80, 5, "k", 7, b"p"), (1, "ab" * 80, 6, "l", 8, b"q")], "doc_id long, text string, no int, kept string, m long, packed binary")
    assert sorted(map(tuple, repeats.remove(clash).collect())) == [(1, "ab", 6, "l", 8, b"q"), (2, "", 5, "k", 7, b"p")]
    got = {r.doc_id: r for r in repeats.remove(docs(spark)).collect()}
    assert len(got) == len(TEXTS) and got[0].text is None and got[6].text == "" and got[9].text == TEXTS[9] and got[9].content == "x"
