"""License scans by an exact set-similarity join (operator 5).

A text block meets a template if it holds at least THRESHOLD of the template's distinct
tokens. Blocks are the lines and, for each template, all windows of REACH times its number
of words, wherever lines break. Tokens are ordered by their frequency over all lines, rare
ones first. A block that meets a template has a token of the template's prefix, enough
tokens (length filter), and enough of them after the first that they share (positional
filter); only such pairs are verified, and only windows about a prefix token are slid over. Templates are parameters, so their vocabulary bounds what is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, texts

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and wording of well-known notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    *((name, form.format(word)) for name, word in (("mit", "mit"), ("bsd", "bsd"), ("isc", "isc")) for form in ("under {} license", "under {} licence", "terms of {} license", "spdx license identifier {}")),
    ("bsd", "under bsd clause license"),
    ("bsd", "under bsd style license"),
    ("mpl-2.0", "under mpl 2 0"),
    ("mpl-2.0", "mozilla public license 2"),
    ("mpl-2.0", "spdx identifier mpl 2"),
)
#: Short notices have at most four tokens, so that THRESHOLD asks for all of them.
REACH = 1.25
THRESHOLD = 0.8
#: A-Z as small letters, what is no word character as a space; line feeds are kept apart.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Templates:
    """Templates' token sets in a global order, with the index of their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        vocabulary = {w for _, t in templates for w in words(t)}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.label = [label for label, _ in templates]
        self.tokens = [sorted(self.rank[w] for w in set(words(t))) for _, t in templates]
        self.least = [math.ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, tokens in enumerate(self.tokens):
            for i, token in enumerate(tokens[: len(tokens) - self.least[t] + 1]):
                self.index.setdefault(token, []).append((t, i))
        self.reach = [math.ceil(REACH * len(words(t))) for _, t in templates]
        self.prefix_words = {w for w, r in self.rank.items() if r in self.index}

    def join(self, block: set[bytes]):
        """(template, containment) for each template that the block meets."""
        mine, seen = sorted(self.rank[w] for w in block if w in self.rank), set()
        for j, token in enumerate(mine):
            for t, i in self.index.get(token, ()):
                if t in seen:
                    continue
                seen.add(t)
                size, least = len(self.tokens[t]), self.least[t]
                if len(block) >= least and 1 + min(size - i - 1, len(mine) - j - 1) >= least:
                    shared = len(set(mine).intersection(self.tokens[t]))
                    if shared >= least:
                        yield t, shared / size

    def windows(self, block: list[bytes], known: set[bytes]):
        """(template, containment) of the best window for each template that one meets."""
        ranks = {self.rank[w] for w in known if w in self.rank}
        open_ = {t for r in ranks for t, _ in self.index.get(r, ()) if len(ranks.intersection(self.tokens[t])) >= self.least[t]}
        if not open_:
            return
        places = [(p, self.rank[w]) for p, w in enumerate(block) if w in self.rank]
        for t in open_:
            mine, reach, best = frozenset(self.tokens[t]), self.reach[t], 0
            prefix = set(self.tokens[t][: len(mine) - self.least[t] + 1])
            about = [p for p, r in places if r in prefix]
            held, first, near, own = Counter(), 0, 0, [x for x in places if x[1] in mine]
            for p, r in own:
                held[r] += 1
                while own[first][0] <= p - reach:
                    q = own[first][1]
                    held[q] -= 1
                    if not held[q]:
                        del held[q]
                    first += 1
                while near < len(about) and about[near] <= p - reach:
                    near += 1
                if near < len(about) and about[near] <= p:
                    best = max(best, len(held))
            if best >= self.least[t]:
                yield t, best / len(mine)


#: Templates that a table may hold: what is broadcast grows with their words only.
MOST_TEMPLATES = 10_000


def templates_of(rows: DataFrame) -> tuple[tuple[str, str], ...]:
    """Templates from a table (label, wording), such as whole license texts; rows without a
    label or a word are left out, repeated ones count once. Larger tables are refused."""
    found = rows.where("label is not null and wording is not null").select("label", "wording").distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(found) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return tuple(sorted((r["label"], r["wording"]) for r in found if words(r["wording"])))


def token_frequency(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many blocks of docs(text, ...) each token of the templates occurs."""
    wanted = frozenset(w for _, t in templates for w in words(t))

    def run(batches):
        n = Counter()
        for b in batches:
            for t in texts(b):
                if not wanted.isdisjoint(words(t)):
                    for line in t.split("\n"):
                        n.update(wanted.intersection(words(line)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

    rows = map_batches(docs.select("text"), run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in rows.collect()}  # at most the templates' vocabulary


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand in the words joined by spaces."""
    out, at, seen, n = [], joined.find(phrase), 0, 0
    while at >= 0:
        n += joined.count(b" ", seen, at)
        out.append(n)
        seen, at = at, joined.find(phrase, at + 1)
    return out


def _scan(index: Templates, phrases: dict[str, str]):
    spaced = {b" " + p.encode() + b" ": label for p, label in phrases.items()}
    keys = {p.split()[0] for p in spaced}

    def run(batches):
        for b in batches:
            rows = []
            for t in texts(b):
                w = words(t)
                known, places, base, labels, score = set(w), [], set(), set(), 0.0
                if not keys.isdisjoint(known):
                    joined = b" " + b" ".join(w) + b" "
                    for p, label in spaced.items():
                        if at := _places(joined, p):
                            places += at
                            base.add(label)
                            score = 1.0
                if not index.prefix_words.isdisjoint(known):
                    for k, c in index.windows(w, known):
                        labels.add(index.label[k])
                        score = max(score, c)
                    for line in t.split("\n"):
                        block = set(words(line))
                        if not index.prefix_words.isdisjoint(block):
                            for k, c in index.join(block):
                                labels.add(index.label[k])
                                score = max(score, c)
                rows.append((len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *NAMES]) if rows else b.select(["doc_id"]).slice(0, 0)

    return run


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Phrases and license labels of docs(doc_id, text, ...). A null or empty text has no
    words, no labels and score 0; every row gives a row. The score is the largest share of
    a template found in a block, 1 where a phrase stands."""
    index = Templates(templates, token_frequency(docs, templates), threshold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), _scan(index, phrases), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: one row for each row, repeated ids included; a null
    text counts as empty: no words, no labels, score 0."""
    return scan(table(spark, sf_dir, "documents"))
