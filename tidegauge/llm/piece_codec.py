"""SentencePiece BPE encoding and decoding by a prefix table (operator 3).

The encoding of a prefix ends in one token only. So a table over the prefixes of a word
stores, for each, that last token: an automaton yields the pieces that end at a place, and
the one that is compatible with the last token of the prefix before it (the two, written
together, encode to just these two) is the entry. Ids are recovered from the end. Whether
two pieces are compatible follows from the ranks and parts of the merges that build them.

Words are independent because no piece has a space mark after another character; this is
checked when a model is loaded. Runs of space marks, whose pieces share one score, merge
after everything else and are merged by the plain rule.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, held, map_batches, table, texts

MARK = "▁"
#: A run of marks with the word after it; a line feed, or the rest of a line.
SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
#: Segments in each generation of a worker's memo, and pairs whose compatibility it keeps.
MEMO_WORDS, MEMO_PAIRS = 500_000, 1_000_000


class PieceTable:
    """Pieces, the order in which they merge, and pair compatibility of one model file.

    Each piece has a rank (higher scores merge first; single characters are there from the
    start) and the two parts that its last merge joins.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.end = sp.eos_id()
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.chars = {p for p in self.id if len(p) == 1}
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        for p in self.id:
            if MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and p.strip(MARK)) or not self.chars.issuperset(p):
                raise ValueError(f"words are not independent in this model: {p!r}")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        merged = [p for p in self.id if len(p) > 1 and p.strip(MARK)]
        if len({self.score[p] for p in merged}) != len(merged):
            raise ValueError("pieces share a score")
        self.rank = [-1] * n
        self.head, self.tail = list(range(n)), list(range(n))
        self.joined: dict[tuple[int, int], int] = {}
        self.fitting: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for r, p in enumerate(sorted(merged, key=self.score.__getitem__, reverse=True)):
            self._place(p, r)
        for p in self.chars:
            self.automaton.add_word(p, (self.id[p], 1))
        self.automaton.make_automaton()
        self.segments = Memo(self.encoded, MEMO_WORDS)

    def _place(self, p: str, rank: int) -> None:
        """Give a piece its rank and parts. A piece that merging never builds has no parts
        and is left out of the automaton; as a pair it still can't occur."""
        i = self.id[p]
        self.rank[i] = rank
        halves = [(self.id[p[:k]], self.id[p[k:]]) for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        for a, b in halves:
            made = all(len(self.piece[x]) == 1 or self.head[x] != x for x in (a, b))
            if made and max(self.rank[a], self.rank[b]) < rank and self.apart(a, b, rank):
                self.head[i], self.tail[i] = a, b
                self.automaton.add_word(p, (i, len(p)))
                break
        for pair in halves:
            self.joined[pair] = rank

    def apart(self, a: int, b: int, before: float = math.inf) -> bool:
        """Whether no merge of a rank below `before` crosses the border between a and b
        while these are built. The last merge on either side is undone, step by step; what
        then meets at the border could merge until that merge. Of equal ranks the left one
        comes first."""
        rank, joined = self.rank, self.joined
        while True:
            if joined.get((a, b), math.inf) < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], self.tail[a]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.head[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart, as they are, when written together."""
        if len(self.fitting) >= MEMO_PAIRS:
            self.fitting.clear()
        known = self.fitting[a << 32 | b] = self.apart(a, b)
        return known

    def merge(self, s: str) -> list[str]:
        """Plain merging: the best score first, then the leftmost."""
        sym, left, right = list(s), list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (p := sym[a] + sym[b]) in self.score:
                heapq.heappush(heap, (-self.score[p], a, b, p))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, p = heapq.heappop(heap)
            if sym[a] and sym[b] and right[a] == b and sym[a] + sym[b] == p:
                sym[a], sym[b], right[a] = p, "", right[b]
                if right[b] >= 0:
                    left[right[b]] = a
                offer(left[a], a)
                offer(a, right[a])
        return [x for x in sym if x]

    def word(self, s: str) -> list[int]:
        """Ids of a string of known characters with at most one mark, at its start."""
        last, size = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        fitting = self.fitting
        for i, (p, n) in self.automaton.iter(s):
            i += 1
            if last[i] < 0:
                if n < i:
                    if (before := last[i - n]) < 0:
                        continue
                    known = fitting.get(before << 32 | p)
                    if not (self.fits(before, p) if known is None else known):
                        continue
                last[i], size[i] = p, n
        if min(size[1:], default=1) < 1:
            raise ValueError(f"no piece ends at a place of {s!r}")
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def parts(self, s: str) -> list[str]:
        """Such a string in parts that merge apart: no piece spans two characters that are
        never neighbours in one."""
        inside, found, at = self.inside, [], 0
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in inside:
                found.append(s[at:i])
                at = i
        return [*found, s[at:]]

    def segment(self, s: str) -> list[int]:
        """Ids of one segment: marks, then known characters and, byte by byte, unknown ones."""
        rest = s.lstrip(MARK)
        marks = len(s) - len(rest)
        ids, known = [], MARK if marks else ""
        parts: list[str | int] = []
        for c in rest:
            if c in self.chars:
                known += c
            else:
                parts += [known, *(self.bytes[b] for b in c.encode())]
                known = ""
        for i, p in enumerate([*parts, known]):
            if isinstance(p, int):
                ids.append(p)
            elif p:
                found = [x for part in self.parts(p) for x in self.word(part)]
                if i == 0 and marks:
                    bare = self.piece[found[0]] == MARK
                    ids += [self.id[x] for x in self.merge(MARK * (marks - (not bare)))]
                    found = found[bare:]
                ids += found
        return ids

    def encoded(self, s: str) -> tuple[str, str]:
        """Ids of a segment as text, and the characters that these stand for. Words of known
        characters are put together from their parts, which have been seen more often."""
        if self.chars.issuperset(s) and MARK not in s[1:]:
            parts = self.parts(s)
            if len(parts) > 1:
                found = [self.segments[p] for p in parts]
                return " ".join([x for x, _ in found]), "".join([x for _, x in found])
            ids = self.word(s)
        else:
            ids = self.segment(s)
        return " ".join(map(str, ids)), self.surface(ids)

    def surface(self, ids) -> str:
        """The characters of ids, marks as they are; bytes are put together."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.piece[i] for i in ids if i not in self.hidden])
        return b"".join([bytes([self.byte_of[i]]) if i in self.byte_of else self.piece[i].encode() for i in ids if i not in self.hidden]).decode("utf-8", "replace")

    def decode(self, ids) -> str:
        """The text of ids: marks as spaces, without the first of them."""
        return self.surface(ids).replace(MARK, " ").removeprefix(" ")


def _table(path: str) -> PieceTable:
    return held(("pieces", path), lambda: PieceTable(path))


def _segments(text: str) -> list[str]:
    return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []


def encode(path: str, text: str) -> list[int]:
    """Ids of a whole text as the library gives them, without begin or end id."""
    known = _table(path).segments
    return [int(i) for s in _segments(text) for i in known[s][0].split(" ")]


def decode(path: str, ids: list[int]) -> str:
    return _table(path).decode(ids)


def _codec(path: str):
    def run(batches):
        t = _table(path)
        end = str(t.end)
        for b in batches:
            n, sha, back = [], [], []
            for text in texts(b):
                found = list(map(t.segments.__getitem__, _segments(text)))
                ids = " ".join([*(x for x, _ in found), end])
                decoded = "".join([x for _, x in found]).replace(MARK, " ")[1:]
                n.append(ids.count(" ") + 1)
                sha.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>, the end id last) of docs(doc_id, text, ...). A null text
    is an empty one and gives the end id alone; every row gives a row."""

    def run(batches):
        for b in batches:
            ids = [[*encode(path, t), _table(path).end] for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode it again; counts and digests of docs(doc_id, text, ...).
    Null texts count as empty, every row gives a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), _codec(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: one row for each row; a null text counts as empty
    and has the end id alone."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
