"""Hierarchical multi-length packing (operator 9).

Documents are cut into whole windows of the longest tier and a rest, which goes to the
smallest tier that holds it. Each tier is packed from long to short; the gap that a window
leaves is filled with whole documents of shorter tiers where they fit and with a cut one
where none does, so windows are full. Each task packs the rows of its partition in bounded
buffers; what is left at its end goes into windows whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import word_ids
from .common import map_batches, table, texts

#: Window lengths; all are powers of two, so a full window needs no padding.
TIERS = (512, 1024, 2048, 4096)
#: Tokens that a task gathers before it packs, and tokens of a step group.
BUFFER_TOKENS, GROUP_TOKENS = 4_000_000, 64 * 4096
#: Chunks that the query's workers remember: they hold little else.
MEMO_WORDS = 700_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs pieces (length, order, document, start); a document is [doc_id, ids, tokens]."""

    def __init__(self, tiers=TIERS):
        self.tiers, self.waiting, self.order, self.tokens = sorted(tiers), {t: [] for t in tiers}, 0, 0
        self.windows: list[tuple[int, list]] = []

    def route(self, length: int, doc: list, start: int) -> None:
        """A piece joins the smallest tier that holds it."""
        if length:
            tier = next(t for t in self.tiers if length <= t)
            insort(self.waiting[tier], (length, self.order, doc, start), key=lambda p: p[:2])
            self.order += 1

    def add(self, doc_id, ids: bytes) -> None:
        n, longest = len(ids) // 4, self.tiers[-1]
        doc, whole = [doc_id, ids, n], n - n % longest
        self.windows += [(longest, [(longest, doc, s)]) for s in range(0, whole, longest)]
        self.route(n - whole, doc, whole)
        self.tokens += n

    def fill(self, gap: int, tier: int) -> list | None:
        """Pieces for a gap of a window: whole ones of this and shorter tiers, the longest
        that fits first, then a cut one. None if too little waits."""
        pools = [self.waiting[t] for t in reversed(self.tiers) if t <= tier]
        got: list = []
        while gap:
            for pool in pools:
                if k := bisect_right(pool, gap, key=lambda p: p[0]):
                    length, _, doc, start = pool.pop(k - 1)
                    got.append((length, doc, start))
                    gap -= length
                    break
            else:
                pool = next((p for p in reversed(pools) if p), None)
                if pool is None:
                    for length, doc, start in got:
                        self.route(length, doc, start)
                    return None
                length, _, doc, start = pool.pop()
                got.append((gap, doc, start))
                self.route(length - gap, doc, start + gap)
                gap = 0
        return got

    def pack(self) -> None:
        for tier in reversed(self.tiers):
            while self.waiting[tier]:
                length, _, doc, start = self.waiting[tier].pop()
                rest = self.fill(tier - length, tier)
                if rest is None:
                    self.route(length, doc, start)
                    break
                self.windows.append((tier, [(length, doc, start), *rest]))

    def close(self) -> None:
        """The last pieces, in windows of the powers of two that add up to them."""
        self.pack()
        left = sum(p[0] for pool in self.waiting.values() for p in pool)
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                for size in [self.tiers[-1]] * ((1 << bit) // self.tiers[-1]) or [1 << bit]:
                    self.windows.append((size, self.fill(size, self.tiers[-1])))

    def take(self) -> list[tuple[int, list]]:
        """The windows so far, with the tiers mixed evenly, so that step groups cut from
        this order are alike."""
        by: dict[int, list] = {}
        for w in self.windows:
            by.setdefault(w[0], []).append(w)
        mixed = sorted(((i + 0.5) / len(ws), t, i) for t, ws in by.items() for i in range(len(ws)))
        self.windows, self.tokens = [], 0
        return [by[t][i] for _, t, i in mixed]


def _pack(path: str, end_id: int, memo_words: int):
    def run(batches):
        base, packer = TaskContext.get().partitionId() << 36, Packer()
        number, done, end = 0, 0, end_id.to_bytes(4, "little")

        def rows(windows):
            nonlocal number, done
            out: list[tuple] = []
            for size, pieces in windows:
                at = 0
                for length, (doc_id, ids, n), start in pieces:
                    out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, base + number, at, size, base + done // GROUP_TOKENS))
                    at += length
                number, done = number + 1, done + size
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(SCHEMA), SCHEMA)], schema=SCHEMA)

        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), texts(b)):
                packer.add(doc_id, word_ids.ids_bytes(path, t, memo_words) + end)
                if packer.tokens >= BUFFER_TOKENS:
                    packer.pack()
                    yield rows(packer.take())
        packer.close()
        yield rows(packer.take())

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, memo_words: int = word_ids.MEMO_WORDS) -> DataFrame:
    """Pieces of docs(doc_id, text, ...) in sequences of at most 4096 tokens. Null texts
    count as empty (the end id alone); rows that share a doc_id are packed each by itself.
    No shuffle: each partition is packed where it is read; sequence ids carry its number.
    memo_words: what a worker's memo holds; more of it costs memory and saves time."""
    return map_batches(docs.select("doc_id", "text"), _pack(tokenizer, end_id, memo_words), DDL)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: pieces of every row, also of rows that repeat an id;
    a null text counts as empty and is its end id alone."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), memo_words=MEMO_WORDS)
