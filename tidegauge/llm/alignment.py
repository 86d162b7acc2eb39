"""Cross-tokenizer alignment (operator 13).

Two tokenizers cut the same bytes. A label for each byte says which of them end a token
there: none, A, B or both. A regex scan over the labels yields the spans up to each both;
the labels within a span count the tokens of its group.

Words that follow a space or line feed are cut apart by both tokenizers, so each distinct
one is labelled once and then looked up. Texts where that is unsure are joined up first.

How often an id pair is linked corpus-wide is asked for block by block: a block (some texts
of one task) sends each of its distinct pairs once, gets back what the corpus says of it, and
its documents are then told by place. So no text, and no link by link row, is shuffled.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, Steps, held, map_batches, table, texts
from .piece_codec import MARK, SEGMENT, PieceTable

#: A space or line feed with what follows; what may not stand before one that is cut off.
CHUNK, OPEN = re.compile(r"[ \n][^ \n]*"), re.compile(r"[^\w!-~](?=[ \n])")
#: A word behind which A's regex cuts; marks that it cuts off.
WORD, MARKS = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,!?;:"
#: Labels of a byte: no end, an end of A, of B, of both; a span up to one of both.
LABELS = bytes.maketrans(bytes(range(4)), b".ab=")
SPAN = re.compile(rb"[^=]*=")
#: Chunks in each generation of a worker's memo.
MEMO_CHUNKS = 300_000
BLOCK = "__alignment_block"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones of
    Latin-1 for themselves, the others, in order, for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def spans(size: int, by_a: list[bytes], by_b: list[bytes]) -> list[bytes]:
    """The labels of each group of tokens, of which both have so many bytes."""
    label = bytearray(size)
    for e in accumulate(map(len, by_a)):
        label[e - 1] = 1
    for e in accumulate(map(len, by_b)):
        label[e - 1] |= 2
    return SPAN.findall(label.translate(LABELS))


class _Chunks(Memo):
    """Entries of chunks. Marks behind a letter that no piece of B joins to it are an entry
    of their own."""

    def __init__(self, pair: Pair):
        super().__init__(lambda c: pair.entries_of([c], [pair.ids(c)])[0], MEMO_CHUNKS)
        self.inside = pair.b.inside

    def core(self, chunk: str) -> str:
        core = chunk.rstrip(MARKS)
        cut = core != chunk and WORD.fullmatch(core) and chunk[len(core) - 1 : len(core) + 1] not in self.inside
        return core if cut else chunk

    def __missing__(self, chunk: str):
        core = self.core(chunk)
        if core == chunk:
            return super().__missing__(chunk)
        return self.keep(chunk, self.joined(chunk, core))

    def joined(self, chunk: str, core: str):
        x, y = self[core], self[chunk[len(core) :]]
        return x and y and (x[0] + y[0], x[1] + y[1], f"{x[2]};{y[2]}", x[3] + y[3])

    def young(self, chunks: Iterable[str]) -> list[str]:
        """Those that it does not know but would hold; what the old generation knows becomes young."""
        new, old = [], self.old
        for c in chunks:
            if c not in self:
                e = old.pop(c, None)
                if e is not None:
                    self[c] = e
                elif len(c) <= self.longest:
                    new.append(c)
        return new

    def learn(self, chunks: set[str], make: Callable[[list[str]], None]) -> None:
        """Know all chunks of a batch, whose new cores `make` adds. Generations change before a batch
        only, so what it needs stays; the young one grows beyond its size by a batch at most."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        new = self.young(chunks)
        cores = [self.core(c) for c in new]
        cut = [(c, core) for c, core in zip(new, cores) if core != c]
        make(self.young({*cores, *(c[len(core) :] for c, core in cut)}))
        for c, core in cut:
            self[c] = self.joined(c, core)


class Pair:
    """Both tokenizers, and what is known of chunks: ids, groups and links."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a, self.b = Tokenizer.from_file(path_a), PieceTable(path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        spec = json.loads(self.a.to_str())
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec.get("normalizer"):
            raise ValueError("A must be byte-level, with its regex and nothing else")
        byte_of = _byte_of()
        self.bytes_a = [bytes([byte_of[c] for c in self.a.id_to_token(i)]) if i < self.a.get_vocab_size(False) else b"" for i in range(self.a.get_vocab_size())]
        self.bytes_b = [p.replace(MARK, " ").encode() for p in self.b.piece]
        for i, b in self.b.byte_of.items():
            self.bytes_b[i] = bytes([b])
        self.sizes = [np.array([len(b) for b in of], np.int64) for of in (self.bytes_a, self.bytes_b)]
        #: Each id as text with the sign behind it: within its group, at the end of its side.
        self.said = [f"{i}{sign}" for of, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for i in range(len(of)) for sign in signs]
        self.said_sizes = np.array([len(t) for t in self.said], np.int64)
        self.chunks = _Chunks(self)

    def marked(self, chunk: str) -> bool:
        """Whether the chunk is a space and a word, to which B adds the same mark."""
        return len(chunk) > 1 and chunk[0] == " " and chunk[1] not in f" {MARK}"

    def ids(self, chunk: str) -> tuple[list[int], list[int]]:
        """As they are in a text."""
        a = self.a.encode(chunk, add_special_tokens=False).ids
        if self.marked(chunk):
            return a, self.library.encode(chunk[1:])
        return a, self.unmarked(chunk)

    def unmarked(self, chunk: str) -> list[int]:
        """B's ids of a chunk whose marks are its own."""
        return [i for s in SEGMENT.findall(chunk.replace(" ", MARK)) for i in self.b.segment(s)]

    def groups(self, chunks: list[str], ids: list[tuple[list[int], list[int]]]):
        """Of each chunk the spans of its groups, as labels, and its tokens' ids; None if
        either tokenizer loses a byte. All are labelled and scanned at once."""
        flat = [[i for x in ids for i in x[k]] for k in (0, 1)]
        joined = [list(map(of.__getitem__, f)) for of, f in zip((self.bytes_a, self.bytes_b), flat)]
        data = [c.encode() for c in chunks]
        whole = b"".join(data)
        if b"".join(joined[0]) == whole and b"".join(joined[1]) == whole:
            out, own, at, ends = [], [], 0, [*accumulate(map(len, data)), -1]
            for s in spans(len(whole), *joined):
                own.append(s)
                at += len(s)
                if at == ends[len(out)]:
                    out.append(own)
                    own = []
            if len(out) == len(chunks):
                return out
        return [None] if len(chunks) == 1 else [g for c, x in zip(chunks, ids) for g in self.groups([c], [x])]

    def entries_of(self, chunks: list[str], ids: list[tuple[list[int], list[int]]]) -> list:
        """Tokens of A and B, groups as text, codes of the linked ids; None if bytes are lost."""
        told = self.told(chunks, [list(chain.from_iterable([x[k] for x in ids])) for k in (0, 1)])
        if told is None:
            return [None] if len(chunks) == 1 else [e for c, x in zip(chunks, ids) for e in self.entries_of([c], [x])]
        return told

    def told(self, chunks: list[str], ids: list[list[int]]) -> list | None:
        """Entries of chunks by the ids of A and of B behind each other; None if bytes are lost or
        a token goes over the end of a chunk. A token's end is a place in the joined bytes, and
        its text brings the sign that follows it in its group."""
        whole = "".join(chunks).encode()
        if any(b"".join(map(of.__getitem__, f)) != whole for of, f in zip((self.bytes_a, self.bytes_b), ids)):
            return None
        flat = [np.array(f, np.int64) for f in ids]
        bounds, ends = np.cumsum([len(c.encode()) for c in chunks]), [np.cumsum(of[f]) for of, f in zip(self.sizes, flat)]
        stops = [np.searchsorted(e, bounds, "right") for e in ends]
        if any((e[s - 1] != bounds).any() for e, s in zip(ends, stops)):
            return None
        both = []
        for mine, other in (ends, ends[::-1]):
            at = np.zeros(len(whole) + 1, bool)
            at[other] = True
            both.append(at[mine])
        codes = (flat[0][both[0]] << 32 | flat[1][both[1]]).tobytes()
        order = np.argsort(np.concatenate([2 * (np.cumsum(x) - x) + k for k, x in enumerate(both)]), kind="stable")
        said = np.concatenate([base + 2 * f + x for base, f, x in zip((0, 2 * len(self.bytes_a)), flat, both)])[order]
        text = "".join(map(self.said.__getitem__, said.tolist()))
        upto = np.cumsum(self.said_sizes[said])[stops[0] + stops[1] - 1].tolist()
        links = (np.cumsum(both[0])[stops[0] - 1] * 8).tolist()
        sizes = [np.diff(s, prepend=0).tolist() for s in stops]
        return [(n, m, text[f : t - 1], codes[i:j]) for n, m, f, t, i, j in zip(*sizes, [0, *upto], upto, [0, *links], links)]

    def learn(self, cuts: list[list[str]]) -> None:
        """Encode the new chunks of several texts, each once and many at a call."""
        self.chunks.learn(set(chain.from_iterable(cuts)), self.add)

    def add(self, new: list[str]) -> None:
        """Entries of chunks. A space and a word are cut apart from the next of this kind by both
        tokenizers, so many of them are one text; others are encoded one by one."""
        words, rest = [], []
        for c in new:
            (words if c[0] == " " and WORD.fullmatch(c) else rest).append(c)
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            text = "".join(some)
            found = self.told(some, [self.a.encode(text, add_special_tokens=False).ids, self.library.encode(text[1:])])
            if found is None:
                rest += some
            else:
                self.chunks.update(zip(some, found))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            of_a = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            marked = iter(self.library.encode([c[1:] for c in some if self.marked(c)], num_threads=1))
            of_b = [next(marked) if self.marked(c) else self.unmarked(c) for c in some]
            self.chunks.update(zip(some, self.entries_of(some, list(zip(of_a, of_b)))))

    def cut(self, text: str) -> list[str]:
        """A space and the text in chunks that both tokenizers cut apart. What ends in a
        letter, digit or mark of ASCII, or in a letter of another script, is one; else it
        goes together with the next."""
        text = " " + text
        chunks = CHUNK.findall(text)
        if not OPEN.search(text):
            return chunks
        out, open_ = [], []
        for c in chunks:
            open_.append(c)
            if len(c) > 1 and not OPEN.match(c[-1] + " "):
                out.append("".join(open_) if len(open_) > 1 else c)
                open_ = []
        return [*out, "".join(open_)] if open_ else out

    def entries(self, cut: list[str]) -> list[tuple]:
        """Entries of a text's chunks; none of a text without tokens."""
        found = list(map(self.chunks.__getitem__, cut))
        return [] if None in found else found


def _pair(path_a: str, path_b: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return held(("alignment", path_a, path_b), lambda: Pair(path_a, path_b))


def _blocks(path_a: str, path_b: str):
    """Documents with their figures and the places of their links in the block's distinct
    pairs; the first row of a block holds these pairs and how often each is linked."""

    def run(batches):
        p, part = _pair(path_a, path_b), TaskContext.get().partitionId()
        gc.disable()  # a memo of plain values has no cycles that would be worth the search
        for no, b in enumerate(batches):
            rows, own = [], []
            cuts = [p.cut(t) if t else [] for t in texts(b)]
            p.learn(cuts)
            for cut in cuts:
                e = p.entries(cut)
                n_a, n_b, said, codes = zip(*e) if e else ((), (), (), ())
                codes = np.frombuffer(b"".join(codes), np.int64)
                own.append(np.unique(codes, return_counts=True))
                rows.append((sum(n_a), sum(n_b), len(codes), hashlib.sha256(";".join(said).encode()).hexdigest() if e else ""))
            if not rows:
                continue
            times = np.concatenate([n for _, n in own])
            pairs, at = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, times)
            ends = np.cumsum([len(c) for c, _ in own])[:-1]
            packed = [[x.astype(np.int32).tobytes() for x in np.split(y, ends)] for y in (at, times)]
            rest = [None] * (len(rows) - 1)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            lists = [pa.array([x.tolist(), *rest], pa.list_(pa.int64())) for x in (pairs, total)]
            block = pa.array([part << 32 | no] * len(rows), pa.int64())
            names = [BLOCK, "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "at", "times", "pairs", "total"]
            yield pa.RecordBatch.from_arrays([block, b.column("doc_id"), *cols, *(pa.array(x, pa.binary()) for x in packed), *lists], names)

    return run


def _told(docs: pa.Table, known: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links."""
    count, best = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
    place = known["i"].to_numpy()
    count[place], best[place] = known["count"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)
    sums = []
    for at, times in zip(docs["at"].to_pylist(), docs["times"].to_pylist()):
        i, n = np.frombuffer(at, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
        sums.append((int(n[best[i]].sum()), int((n * count[i]).sum())))
    out = docs.select(["doc_id", "n_a", "n_b", "n_links", "groups_sha256"])
    for j, name in enumerate(("n_best", "count_sum")):
        out = out.append_column(name, pa.array([s[j] for s in sums], pa.int64()))
    return out


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count and best: links of each id pair, and whether no other pair of its B id has
    more. A B id has no more pairs than A has entries."""
    each = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "total")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.total").alias("count"))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    high = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(high, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row
    of docs(doc_id, text, ...).

    A takes a space and the text, B the text, to which it adds a space. A text that is null
    or empty, or of which either loses a byte (such as one that holds B's mark for a space),
    has no tokens: zeros and an empty groups_sha256; it says nothing of id pairs. A group ends
    where both tokenizers end a token, so its last tokens are its one link. Rows that repeat
    count each time; an empty table gives no rows; other columns are not read.
    """
    steps = Steps(docs.sparkSession, "alignment")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"{BLOCK} long, doc_id {kind}, n_a long, n_b long, n_links long, groups_sha256 string, at binary, times binary, pairs array<long>, total array<long>"
    blocks = steps.store("blocks", map_batches(docs.select("doc_id", "text"), _blocks(path_a, path_b), schema))
    counts = steps.store("counts", pair_counts(blocks))
    asked = blocks.where("pairs is not null").select(F.col(BLOCK).alias("of"), F.posexplode("pairs").alias("i", "pair"))
    known = asked.join(counts, "pair").select("of", "i", "count", "best").groupBy("of")
    told = blocks.drop("pairs", "total").groupBy(BLOCK).cogroup(known)
    out = "doc_id {}, n_a long, n_b long, n_links long, groups_sha256 string, n_best long, count_sum long".format(kind)
    rows = steps.store("told", told.applyInArrow(_told, out))
    steps.drop("blocks", "counts")
    return rows.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, first and end (bytes of a space and the text), a_ids and b_ids of each group."""

    def run(batches):
        p = _pair(path_a, path_b)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b)):
                at, found = 0, []
                for chunk in p.cut(text) if text else []:
                    a, b_ = p.ids(chunk)
                    own = p.groups([chunk], [(a, b_)])[0]
                    if own is None:
                        found = []
                        break
                    for s in own:
                        n, m = s.count(b"a") + 1, s.count(b"b") + 1
                        found.append((doc, at, at + len(s), a[:n], b_[:m]))
                        at, a, b_ = at + len(s), a[n:], b_[m:]
                rows += found
            kinds = (b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "first", "end", "a_ids", "b_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, first long, end long, a_ids array<int>, b_ids array<int>")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: one row for each row; see align."""
    import public_tokenizers as public

    return align(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
