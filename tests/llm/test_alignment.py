import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidegauge.llm import alignment

from ..conftest import SF01
from . import cases

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), byte_of


def brute(text, libraries):
    """Groups of (A ids, B ids) of a whole text, by sets of byte offsets."""
    a, b, byte_of = libraries
    if not text:
        return []
    x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    by_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in x.ids]
    by_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(by_a) != (" " + text).encode() or b"".join(by_b) != (" " + text).encode():
        return []
    ends = [{e: k + 1 for k, e in enumerate(accumulate(map(len, by)))} for by in (by_a, by_b)]
    out, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        out.append((x.ids[i : ends[0][e]], y[j : ends[1][e]]))
        i, j = ends[0][e], ends[1][e]
    return out


def expected(texts, libraries):
    found = [brute(t, libraries) for t in texts]
    count = Counter((a[-1], b[-1]) for g in found for a, b in g)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for g in found:
        links = [(a[-1], b[-1]) for a, b in g]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        sha = hashlib.sha256(said.encode()).hexdigest() if g else ""
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out


def rows(df):
    return {r.doc_id: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()}


def test_contract_over_the_corpus(spark, libraries):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    assert rows(alignment.op13_alignment(spark, SF01)) == dict(zip([r.doc_id for r in docs], expected([r.text for r in docs], libraries)))


def test_random_texts(libraries):
    """Contractions, marks, runs of spaces, other scripts' spaces and special strings."""
    p = alignment.Pair(A, B)
    rng = random.Random(5)
    parts = [*"abcXYZ 019  \n\n\t.,!?'-’é日😀　\xa0\x85\x1c᠎​▁ﬁİ\r\x00", "'s", "'ll", " the", "<|endoftext|>", "</s>", "<0x0A>", "  "]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        cut = p.cut(text) if text else []
        if rng.random() < 0.5:
            p.learn([cut])
        want = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in brute(text, libraries))
        assert ";".join(e[2] for e in p.entries(cut)) == want, repr(text)


def test_odd_rows_blocks_and_memo(spark, libraries, monkeypatch):
    texts = [*cases.TEXTS, "a ▁ b", "same", "x  y", "tab\t end"]
    want = dict(zip(range(len(texts)), expected(texts, libraries)))
    assert rows(alignment.align(cases.docs(spark, texts), A, B)) == want
    assert rows(alignment.align(cases.docs(spark, texts).repartition(3), A, B)) == want
    assert alignment.align(cases.empty(spark), A, B).count() == 0
    twice = spark.createDataFrame([(1, "some text"), (1, "some text"), (None, "some text")], "doc_id long, text string")
    got = alignment.align(twice, A, B).collect()
    assert len(got) == 3 and {r.count_sum for r in got} == {3 * got[0].n_links}


def test_groups_are_spans_of_the_text(spark, libraries):
    texts = ["Hello, world! It's naïve.", "", None, "▁", "日本 語"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sorted(alignment.groups(df, A, B).collect(), key=lambda r: (r.doc_id, r.first)):
        got.setdefault(r.doc_id, []).append((r.first, r.end, r.a_ids, r.b_ids))
    for i, t in enumerate(texts):
        want = brute(t, libraries)
        assert [(a, b) for _, _, a, b in got.get(i, [])] == want
        if want:
            assert [x[0] for x in got[i]] == [0, *(x[1] for x in got[i][:-1])] and got[i][-1][1] == len((" " + t).encode())


def test_a_batch_is_encoded_by_few_calls_and_kept():
    """New words are one text for both tokenizers, and what a batch needs is not let go of within it."""
    pair = alignment.Pair(A, B)
    pair.chunks.size = 50
    words = [a + b + c for a in ("ba", "Ké", "zu", "thr", "ing") for b in ("l", "mo", "tion", "ß") for c in ("ax", "er", "ou", "ly")]
    text = "\n".join(" ".join(w + m for w in words) for m in ("", ",", "", "?!")) + " 12 (x) ▁ ..."
    calls = []

    class Counted:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.of, name)

    pair.a, pair.library = Counted(pair.a), Counted(pair.library)
    for _ in range(3):
        cuts = [pair.cut(text.replace("▁", "")), pair.cut("so be it.")]
        pair.learn(cuts)
        missed, plain = len(calls), alignment.Pair(A, B)
        for cut in cuts:
            got = pair.entries(cut)
            assert got == [plain.entries_of([c], [plain.ids(c)])[0] for c in cut]
    assert len(calls) <= 12 and missed == len(calls), calls
