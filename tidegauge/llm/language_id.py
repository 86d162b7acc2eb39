"""Language ID by error-correcting output codes (operator 8).

Each language has a binary codeword. For each bit a naive-Bayes classifier over hashed
byte trigrams tells the languages with a 1 from those with a 0. A text's bit margins are
decoded to the codeword of least logistic loss, bits weighted by how well they separate the
training texts; a small lead over the second codeword is flagged as ambiguous. Scores only
compare languages, so a text of none can score 1; a text whose margins agree with its own
codeword far less than the language's mean text does is flagged as foreign.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, texts

BUCKETS = 1 << 15
#: Texts of a language that training reads at most, chosen by a hash of their doc_id.
TRAIN_DOCS = 1500
#: Longest random code, and a lead in score under which a text is ambiguous.
MAX_BITS, AMBIGUOUS = 63, 0.2
#: A text is foreign under this share of its language's mean agreement; texts of fewer
#: trigrams than ENOUGH need proportionally less, as little speaks for or against them.
#: calibrate() lowers the share of a language to MARGIN of what all but LOWEST of its
#: held-out texts reach, about HELD_DOCS of each, so that clean texts stay.
LEAST_FIT, ENOUGH = 0.28, 256
MARGIN, LOWEST, HELD_DOCS = 0.8, 0.002, 500
#: Trigram evidence saturates: a text's mean margin times this is its logit.
SHARPNESS = 12.0
#: ASCII capitals as small letters, everything that is no letter as a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LETTER = regex.compile(r"\p{L}")


def trigrams(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of the texts, and where each text's begin."""
    folded = [b"  " + t.translate(FOLD) + b" " for t in data]
    x = np.frombuffer(b"".join([*folded, b"  "]), np.uint8).astype(np.uint32)
    ids = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)
    return ids, np.cumsum([0, *map(len, folded[:-1])])


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: every split for few languages, else random splits far apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]).T.astype(float)
    rng, best = np.random.default_rng(7), None
    for _ in range(50):
        c = rng.choice([-1.0, 1.0], (n, MAX_BITS))
        least = min(np.abs(a - b).sum() for a, b in itertools.combinations(c, 2))
        if best is None or least > best[0]:
            best = (least, c)
    return best[1]


#: Sums are kept in units of 2**-20, so that they do not depend on the order of tasks.
UNIT = 1 << 20


def _counts(batches):
    """Square roots of each text's trigram counts, summed by language and bucket."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, t in zip(b.column("lang").to_pylist(), texts(b)):
            c = np.bincount(trigrams([t.encode()])[0], minlength=BUCKETS)
            sums[lang] = sums.get(lang, 0) + np.round(np.sqrt(c) * UNIT).astype(np.int64)
    for lang, x in sums.items():
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at])], ["lang", "bucket", "n"])


class Model:
    """Languages, codewords, and the weights of each bit's classifier."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.langs = sorted(sums)
        self.codes = codewords(len(self.langs))
        rates = np.array([(sums[k] + 0.5) / (sums[k] + 0.5).sum() for k in self.langs]).reshape(len(self.langs), BUCKETS)
        bits = self.codes.shape[1] if self.langs else 0
        self.weights = np.zeros((BUCKETS, bits))
        for b in range(bits):
            one, zero = rates[self.codes[:, b] > 0], rates[self.codes[:, b] < 0]
            if len(one) and len(zero):
                self.weights[:, b] = np.log(one.mean(0)) - np.log(zero.mean(0))
        margins = rates @ self.weights  # of each language's mean text
        self.loss_weights = np.maximum((margins * self.codes).min(0), 1e-3) if self.langs else np.zeros(0)
        self.loss_weights = self.loss_weights / max(self.loss_weights.sum(), 1e-9)
        self.usual = (margins * self.codes) @ self.loss_weights  # agreement of mean texts
        self.least = np.full(len(self.langs), LEAST_FIT)

    def margins(self, data: list[bytes]) -> np.ndarray:
        ids, begins = trigrams(data)
        sums = np.add.reduceat(self.weights[ids], begins, axis=0)
        return sums / np.maximum(np.diff([*begins, len(ids)]), 1)[:, None]

    def fit(self, data: list[bytes], margins: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each text agrees with a language's codeword, as a share of its mean text."""
        enough = np.minimum([(len(t) + 1) / ENOUGH for t in data], 1)
        return ((margins * self.codes[codes]) @ self.loss_weights) / (enough * np.maximum(self.usual[codes], 1e-9))

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Score of each language: codewords of small weighted loss score high."""
        loss = np.log1p(np.exp(-np.clip(SHARPNESS * margins[:, None, :] * self.codes[None], -50, 50)))
        x = -len(self.loss_weights) * (loss * self.loss_weights).sum(2)
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


#: Languages that are learned at most: those of most texts, of equal ones the first by name.
LANGS = 1000
OF, ONE = "__language_of", "__language_one"


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on labelled(doc_id, text, lang): of each language the train_docs texts (about)
    whose doc_id hashes lowest, and at most LANGS languages. Rows without text or lang teach nothing; a row that occurs
    twice counts twice; a null doc_id hashes as any other. Sums are added up in the cluster
    in one job; at most BUCKETS figures of each language reach the driver."""
    found = map_batches(_chosen(labelled, 0, train_docs).select("lang", "text"), _counts, "lang string, bucket int, n long")
    rows = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs, bucket, n = np.array(rows["lang"].to_pylist(), object), rows["bucket"].to_numpy(), rows["n"].to_numpy()
    sums = {}
    for lang in set(langs):
        sums[lang] = np.zeros(BUCKETS)
        sums[lang][bucket[langs == lang]] = n[langs == lang] / UNIT
    return Model(sums)


def _chosen(labelled: DataFrame, start: int, end: int) -> DataFrame:
    """Of each language the start-th to end-th text (about) by the hash of doc_id."""
    rows = labelled.where("text is not null and lang is not null")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    shares = [(r["lang"], 1_000_000 / r["count"]) for r in most]
    of = F.broadcast(rows.sparkSession.createDataFrame(shares, f"{OF} string, {ONE} double"))  # LANGS rows at most
    place, one = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)), F.col(ONE)
    return rows.join(of, F.col("lang") == F.col(OF)).where((place < one * end) & (place >= one * start)).drop(OF, ONE)


def calibrate(model: Model, labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Lower what a text of a language must reach, by texts that train() did not read. Only
    about HELD_DOCS figures of each language reach the driver."""

    def run(batches):
        for b in batches:
            rows = [(x, t.encode()) for x, t in zip(b.column("lang").to_pylist(), texts(b)) if x in model.langs and LETTER.search(t)]
            langs, data = [x for x, _ in rows], [t for _, t in rows]
            fit = model.fit(data, model.margins(data), np.array([model.langs.index(x) for x in langs])) if data else []
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(fit, pa.float64())], ["lang", "fit"])

    fits: dict[str, list[float]] = {}
    if len(model.langs) > 1:
        held = _chosen(labelled, train_docs, train_docs + HELD_DOCS).select("lang", "text")
        for r in map_batches(held, run, "lang string, fit double").collect():
            fits.setdefault(r["lang"], []).append(r["fit"])
    for lang, x in fits.items():
        k = model.langs.index(lang)
        model.least[k] = min(LEAST_FIT, MARGIN * float(np.quantile(x, LOWEST)))
    return model


def _predict(model: Model, keep: list[str]):
    def run(batches):
        for batch in batches:
            lang, score, lead, strange = [], [], [], []
            rows = [t.encode() if LETTER.search(t) else b"" for t in texts(batch)]
            at = 0
            while at < len(rows):  # about 128 KB at a time
                size, end = 0, at
                while end < len(rows) and (end == at or size + len(rows[end]) < 128_000):
                    size, end = size + len(rows[end]), end + 1
                part, at = rows[at:end], end
                margins = model.margins(part) if model.langs else None
                p = model.decode(margins) if model.langs else np.zeros((len(part), 1))
                best, top = p.argmax(1), np.sort(p, 1)
                foreign = model.fit(part, margins, best) < model.least[best] if len(model.langs) > 1 else np.zeros(len(part), bool)
                for i, t in enumerate(part):
                    known = bool(t) and bool(model.langs)
                    lang.append(model.langs[best[i]] if known else "und")
                    score.append(float(top[i, -1]) if known else 0.0)
                    lead.append(known and len(model.langs) > 1 and float(top[i, -1] - top[i, -2]) < AMBIGUOUS)
                    strange.append(known and bool(foreign[i]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.bool_()), pa.array(strange, pa.bool_())], [*keep, "lang_pred", "score", "ambiguous", "foreign"])

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score, ambiguous and foreign of docs(text, ...). `und` with
    score 0 for a text that is null or has no letter, or if nothing was learned."""
    kept = docs.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), _predict(model, list(keep)), f"{ddl}, lang_pred string, score double, ambiguous boolean, foreign boolean")


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: one row for each row. Learns from rows with text and
    lang that are not held out; a null doc_id is not held out. Null texts, and texts without
    a letter, give `und` with score 0."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
