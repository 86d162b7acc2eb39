import collections
import hashlib
import math
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF01
from tests.llm.cases import TEXTS, docs, empty
from tidegauge.llm import language_id, packing, piece_codec, token_counts, word_ids
from tidegauge.llm.common import Memo

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOK = Tokenizer.from_file(WORDS)
SPECIAL = ["<|endoftext|> <|EndOfText|>", "a<|startoftext|>b\t c"]
some_text = st.text(st.sampled_from("abehtTHE  ▁\n\t'sdé́0 9.,-日😀 　ßΣ<|endoftext|>/"), max_size=80)


@settings(max_examples=400, deadline=None)
@given(some_text | st.text(max_size=60))
def test_pieces_as_the_library(text):
    ids = piece_codec.encode(PIECES, text)
    assert ids == SP.encode(text)
    assert piece_codec.decode(PIECES, ids) == SP.decode(ids)


def test_runs_of_spaces_as_the_library():
    for n in range(1, 70):
        for tail in ("", "a", "\n", "word x", "▁"):
            text = " " * n + tail
            assert piece_codec.encode(PIECES, text) == SP.encode(text), (n, tail)


@settings(max_examples=300, deadline=None)
@given(some_text | st.text(max_size=60))
def test_word_ids_as_the_library(text):
    assert np.frombuffer(word_ids.ids_bytes(WORDS, text), "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_pieces_written_together_as_the_library():
    table = piece_codec._table(PIECES)
    rng, pieces = random.Random(5), [p for p in table.id if p.strip(piece_codec.MARK)]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces).replace("▁", " ") if rng.random() < 0.8 else rng.choice(" aaé日\n") for _ in range(rng.randrange(1, 9)))
        assert piece_codec.encode(PIECES, text) == SP.encode(text), text


def test_parts_are_those_that_plain_merging_reaches():
    table = piece_codec._table(PIECES)
    for p in random.Random(6).sample([p for p in table.id if len(p) > 1 and p.strip(piece_codec.MARK)], 3000):
        i = table.id[p]
        assert (table.head[i] != i) == (table.merge(p) == [p]), p


def test_marks_after_any_letter_as_the_library():
    for c in map(chr, range(0x80, 0x30000)):
        if c.isalpha() or unicodedata.combining(c):
            text = " ".join("Ab" + c + m for m in word_ids.MARKS)
            assert word_ids.ids_bytes(WORDS, text) == np.array(TOK.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(ord(c))


def test_memos_forget_and_stay_right():
    calls = []
    memo = Memo(lambda k: calls.append(k) or k.upper(), 3)
    for k in "abcabcdefabdefx" * 3:
        assert memo[k] == k.upper() and len(memo) <= 3 and len(memo.old) <= 3
    assert memo["y" * 99] == "Y" * 99 and "y" * 99 not in memo


def test_codec_rows(spark):
    got = {r.doc_id: r for r in piece_codec.round_trip(docs(spark), PIECES).collect()}
    for i, t in enumerate(TEXTS):
        ids = [*SP.encode(t or ""), 2]
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), i
        assert got[i].decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest(), i
    assert piece_codec.round_trip(empty(spark), PIECES).count() == 0
    assert {r.doc_id: list(r.ids) for r in piece_codec.encode_texts(docs(spark), PIECES).collect()}[0] == [2]


@pytest.mark.parametrize("path", [WORDS, PIECES])
def test_counts_and_cache(spark, tmp_path, path):
    cache = f"file://{tmp_path}/cache"
    count = (lambda t: len(TOK.encode(t, add_special_tokens=False).ids)) if path == WORDS else (lambda t: len(SP.encode(t)))
    want = {(i, len((t or "").encode()), count(t or "")) for i, t in enumerate(TEXTS)}
    for texts in (TEXTS[:7], TEXTS, TEXTS):
        got = {tuple(r) for r in token_counts.count_tokens(docs(spark, texts), path, cache).collect()}
        assert got == {w for w in want if w[0] < len(texts)}
    rows = spark.read.parquet(cache)
    assert rows.count() == rows.select("digest").distinct().count() == len({t or "" for t in TEXTS})
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_second_run_encodes_only_what_is_new(spark, tmp_path, monkeypatch):
    cache, size = f"file://{tmp_path}/cache", lambda: spark.read.parquet(f"file://{tmp_path}/cache").count()
    run = lambda texts: {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, texts), WORDS, cache, token_counts.fold_spaces).collect()}
    texts = ["one  two", " one two\n", "three", None, "", "İ, ! x", *SPECIAL]
    assert run(texts[:3]) == {0: 2, 1: 2, 2: 1} and size() == 2
    assert run(texts[:3]) == {0: 2, 1: 2, 2: 1} and size() == 2
    assert run(texts) == {i: len(TOK.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert size() == len({" ".join((t or "").split()) for t in texts})
    monkeypatch.setattr(token_counts, "RULE", 99)
    assert run(texts[:3]) == {0: 2, 1: 2, 2: 1} and len(list((tmp_path / "cache").glob("version=*"))) == 2


def test_a_run_reads_the_partitions_of_its_keys(spark, tmp_path):
    cache = f"file://{tmp_path}/c"
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(600)], "doc_id long, text string")
    all_counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORDS, cache).collect()}
    again = docs.where("doc_id < 2").union(spark.createDataFrame([(9000, "a new one")], "doc_id long, text string"))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(again, WORDS, cache).where("doc_id < 9000").collect()} == {i: all_counts[i] for i in (0, 1)}
    version = token_counts.tokenizer_version(WORDS)
    keys = docs.where("doc_id = 0").select(F.unhex(F.sha2("text", 256)).alias("digest"))
    plan = token_counts._read_cache(spark, cache, version, keys)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert token_counts._read_cache(spark, cache, version, keys).count() < 20
    token_counts._read_cache(spark, cache, version).limit(50).select("digest", "n_tokens", token_counts._part()).write.mode("append").partitionBy("part").parquet(f"{cache}/version={version}")
    assert token_counts._read_cache(spark, cache, version).count() == 651
    assert token_counts.compact(spark, cache, WORDS) == 601 == token_counts._read_cache(spark, cache, version).count()
    assert token_counts.compact(spark, f"{cache}-none", WORDS) == 0


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(some_text, min_size=1, max_size=30))
def test_folding_spaces_keeps_counts(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", token_counts.fold_spaces(F.col("t")).alias("u")).collect()
    assert all(word_ids.count(WORDS, r.t) == word_ids.count(WORDS, r.u) for r in rows)


def test_counts_of_the_corpus(spark):
    got = {r.doc_id: r for r in token_counts.op10_token_counts(spark, SF01).collect()}
    for r in spark.read.parquet(f"{SF01}/documents.parquet").collect():
        n = len(TOK.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit, got[r.doc_id].n_bytes) == (n, n > 2048, len((r.text or "").encode()))


def check_pieces(rows, texts):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*TOK.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    return by_seq


def test_packing(spark):
    texts = dict(enumerate(TEXTS))
    check_pieces(packing.pack(docs(spark).repartition(3), WORDS).collect(), texts)
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_packing_of_the_corpus(spark):
    rows = packing.op9_packing(spark, SF01).collect()
    seqs = check_pieces(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()})
    sizes = [sum(r.length for r in s) for s in seqs.values()]
    assert sum(s < 512 for s in sizes) <= 9
    groups = collections.Counter()
    for r in rows:
        groups[r.step_group] += r.length
    full = sorted(groups.values())[1:-1]
    assert not full or max(full) - min(full) <= 2 * 4096


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = [r for r in language_id.op8_language_id(spark, SF01).collect()]
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_cases(spark):
    model = language_id.train(spark.read.parquet(f"{SF01}/documents.parquet"))
    got = {r.doc_id: r for r in language_id.predict(docs(spark), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 13)] == ["und"] * 5 and got[0].score == 0
    assert got[5].lang_pred == got[6].lang_pred != "und" and got[5].score == got[6].score
    assert language_id.predict(empty(spark), model).count() == 0
    none = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.predict(docs(spark), none).collect()} == {"und"}
    one = language_id.train(docs(spark))
    assert language_id.predict(docs(spark), one).where("doc_id = 5").first().lang_pred == "en"


def slow_scores(model_docs, text):
    """Scores of a text by the plain formulas: root counts of trigrams by language, naive
    Bayes for each bit of the codewords, logistic loss weighted by the least margin."""
    def grams(t):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t.encode())
        b = b"  " + b + b"   "
        return [(b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA6B + b[i + 2] * 0xC2B2AE35) % (1 << 32) >> 17 for i in range(len(b) - 2)]

    langs = sorted({x for x, _ in model_docs})
    rate = {}
    for x in langs:
        sums = collections.Counter()
        for lang, t in model_docs:
            if lang == x:
                for g, n in collections.Counter(grams(t)).items():
                    sums[g] += math.sqrt(n)
        every = sum(sums.values()) + 0.5 * language_id.BUCKETS
        rate[x] = collections.defaultdict(lambda every=every: 0.5 / every, {g: (n + 0.5) / every for g, n in sums.items()})
    codes = dict(zip(langs, language_id.codewords(len(langs)).tolist()))
    bits = range(len(codes[langs[0]]))
    mean = lambda g, b, side: np.mean([rate[x][g] for x in langs if codes[x][b] == side])
    weight = lambda g, b: math.log(mean(g, b, 1)) - math.log(mean(g, b, -1))
    known = set().union(*rate.values())
    rest = {x: 1 - sum(rate[x][g] for g in known) for x in langs}  # of trigrams that no text has
    unseen = [weight(-1, b) for b in bits]
    margin = lambda x, b: sum(rate[x][g] * weight(g, b) for g in known) + rest[x] * unseen[b]
    trust = np.array([max(min(margin(x, b) * codes[x][b] for x in langs), 1e-3) for b in bits])
    trust /= trust.sum()
    g = grams(text)
    m = [sum(weight(z, b) for z in g) / len(g) for b in bits]
    x = [-len(bits) * sum(w * math.log1p(math.exp(-language_id.SHARPNESS * v * c)) for w, v, c in zip(trust, m, codes[k])) for k in langs]
    e = [math.exp(v - max(x)) for v in x]
    return dict(zip(langs, np.array(e) / sum(e)))


def test_language_as_the_plain_formulas(spark):
    said = {"aa": ["the cat sat on the mat", "a dog and the cat", "the the the"], "bb": ["le chat est la", "un chien et le chat", "été à la plage"], "cc": ["der hund ist da", "die katze und der hund", "über das haus"]}
    docs_ = [(x, t) for x, ts in said.items() for t in ts] + [("aa", "a dog and the cat")]
    table = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(docs_)], "doc_id long, lang string, text string").repartition(3)
    model = language_id.train(table)
    asked = ["the dog", "le chien à la maison", "hund und katze", "chat the der", "Zürich 12"]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(asked):
        want = slow_scores(docs_, t)
        assert got[i].lang_pred == max(want, key=want.get) and abs(got[i].score - max(want.values())) < 1e-6, (t, want, got[i])


def test_training_takes_few_jobs(spark):
    docs_ = spark.read.parquet(f"{SF01}/documents.parquet").repartition(24)
    spark.sparkContext.setJobGroup("training", "training")
    language_id.train(docs_)
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("training")) <= 6


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 20):
        c = language_id.codewords(n)
        assert len({tuple(x) for x in c}) == n
