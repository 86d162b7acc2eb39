"""Removal of repeated byte strings by bucket-pointer refinement (operator 2).

Of a suffix array only the order of equal strings of LENGTH bytes matters here, so sorting
stops at that depth. Suffixes are sampled: each string is represented by the least of its
q-grams, and neighbouring strings with the same one form a run.

1. Initial buckets: runs with the same q-gram. Most buckets hold one run and are done, and
   in many all runs have the same text: all but the first run repeat it.
2. Mixed buckets are refined. Of each text the first run is cut out of its document; its
   strings are put in buckets by their first bytes, and a bucket is sorted on the bucket
   identifiers at a later offset (see refine). The identifiers that this gives are used
   again for the next offset, twice as far, until they stand for whole strings. Buckets of
   one string are left alone. Buckets of very many texts are refined across tasks first:
   a round halves their runs and groups the halves by bucket and by the bytes at the later
   offset that all strings of a half have, until buckets are small (refine_wide). Runs stay
   runs there, so that a text adds a few rows, not one for each of its places.
3. Runs that follow each other in a document and in the one they repeat are chained. Before
   bytes are removed, the digest of a chain is compared with that of the bytes it repeats.

Buckets are hash partitioned, and joins on them can be split, so a passage that a third of
the documents share is no single task's work. Texts are worked on in overlapping chunks.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, map_batches, table

#: Length of the strings that count as repeated, and of the q-grams that name a bucket.
LENGTH, Q = 100, 24
GRAMS = LENGTH - Q + 1  # q-grams of a string
_rng = np.random.default_rng(1618)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = {n: np.uint64(int(_rng.integers(0, 1 << 62)) * 2 + 1) for n in (1, 2, 4, 8, 16, 32, 64, 96, 24)}


def pointers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the q-gram and of the whole string that start at each place: those of
    length n are made from the ones of a smaller length at the place and at later offsets."""
    h = {1: _BYTE[x]}
    for n in (1, 2, 4, 8, 16, 32):
        h[2 * n] = h[n][:-n] * _STEP[n] + h[n][n:]
    grams = h[16][: len(x) - 23] * _STEP[24] + h[8][16:]
    long = h[64][: len(x) - 95] * _STEP[64] + h[32][64:]
    return grams, long[: len(x) - 99] * _STEP[96] + h[4][96:]


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


def runs(x: np.ndarray, ends: np.ndarray, base: int = 1 << 20):
    """Runs of neighbouring strings that have the same sampled q-gram, the least (leftmost)
    of their q-grams. x: bytes of documents one after the other; ends: where each ends.
    Returns for each run its start, strings, bucket and identifier of its whole text."""
    n = len(x) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2
    grams, long = pointers(x)
    least = (_mix(grams) & ~np.uint64(base - 1)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < GRAMS:
        least = np.minimum(least[: n], least[GRAMS - width :][:n])
    at = (least & np.uint64(base - 1)).astype(np.int64)
    fits = np.ones(n, bool)
    for e in ends[:-1]:
        fits[max(e - LENGTH + 1, 0) : min(e, n)] = False
    fits = np.concatenate([[False], fits, [False]])
    at = np.concatenate([[-1], at, [-1]])
    new = fits[1:-1] & (~fits[:-2] | (at[1:-1] != at[:-2]))
    last = fits[1:-1] & (~fits[2:] | (at[1:-1] != at[2:]))
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    m = grams[at[1:-1][a]]
    f = _mix(_mix(long[a] + (b - a).astype(np.uint64)) + long[b])
    return a, b - a + 1, m.view(np.int64), f.view(np.int64)


#: Bytes that are worked on at a time, texts of a bucket from which it is more than a task's
#: work, and bytes of a source's piece.
CHUNK, WIDE, PIECE = 64_000, 2000, 16_384
#: Names that no column of the input has.
NO, KEPT, OF, START = (f"__repeats_{x}" for x in ("no", "kept", "of", "start"))


def proof(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _chunks(batch: pa.RecordBatch, size_of: int):
    """About size_of bytes at a time: number, offset and bytes of texts or parts of texts. The
    parts of a text overlap, so that each string lies in one of them."""
    some, size = [], 0
    for no, t in zip(batch.column(NO).to_pylist(), batch.column("text").to_pylist()):
        t = (t or "").encode()
        for at in range(0, max(len(t) - LENGTH + 1, 0), size_of):
            part = t[at : at + size_of + LENGTH - 1]
            if some and size + len(part) > size_of:
                yield some
                some, size = [], 0
            some.append((no, at, part))
            size += len(part)
    if some:
        yield some


def _find_runs(shift: int, size_of: int):
    def run(batches):
        for b in batches:
            for some in _chunks(b, size_of):
                x, sizes = np.frombuffer(b"".join([t for _, _, t in some]), np.uint8), np.array([len(t) for _, _, t in some])
                ends = np.cumsum(sizes)
                a, n, m, f = runs(x, ends, 1 << max(20, int(len(x)).bit_length()))
                of = np.searchsorted(ends, a, side="right")
                place = (np.array([no for no, _, _ in some], np.int64)[of] << shift) + np.array([at for _, at, _ in some])[of] + a - (ends - sizes)[of]
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(f), pa.array(place), pa.array(n.astype(np.int16))], ["m", "f", "place", "n"])

    return run


def _chain(shift: int, piece_of: int):
    """Runs (place, n, src), in the order of place, as chains: each goes on in its document
    as its source does, within one piece of the source."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            place, n, src = (b.column(c).to_numpy().astype(np.int64) for c in ("place", "n", "src"))
            piece = (src & ((1 << shift) - 1)) // piece_of
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1] + n[:-1]) | (src[1:] != src[:-1] + n[:-1]) | (piece[1:] != piece[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(place[at]), pa.array(np.add.reduceat(n, at)), pa.array(src[at])], ["place", "n", "src"])

    return run


def _pieces(piece_of: int):
    """Texts as packed pieces, each with what a chain that starts in it may need."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for no, t in zip(b.column(NO).to_pylist(), b.column("text").to_pylist()):
                data = (t or "").encode()
                out += [(no, i // piece_of, pack.compress(data[i : i + piece_of + 2 * LENGTH])) for i in range(0, max(len(data) - LENGTH + 1, 0), piece_of)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], [NO, "piece", "data"])

    return run


def _cut(shift: int, piece_of: int):
    """The bytes of the runs that are to be refined, and the proof of those that are not."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            texts, proofs = [], []
            for src, piece, n, m, packed in zip(*(b.column(c).to_pylist() for c in ("src", "piece", "n", "m", "data"))):
                at = (src & ((1 << shift) - 1)) - piece * piece_of
                text = unpack.decompress(packed)[at : at + n + LENGTH - 1]
                texts.append(None if m is None else text)
                proofs.append(proof(text) if m is None else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("src", "n", "m", "wide")), pa.array(texts, pa.binary()), pa.array(proofs, pa.binary())], ["src", "n", "m", "wide", "snippet", "proof"])

    return run


def refine(x: np.ndarray, ends: np.ndarray, depth: int = 8) -> np.ndarray:
    """A bucket identifier for each place of x: places whose strings of LENGTH bytes are
    equal have equal ones, and no others do. x: texts one after the other; ends: where each
    ends; strings lie within a text, and only places where one starts mean anything.

    Places start in the buckets of their first `depth` bytes. A round sorts the buckets of
    several places on the identifiers at the offset `depth` (less in the last round), which
    stand for `depth` bytes there, and the new ones stand for all these bytes.
    """
    room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(x))
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.zeros(depth - 1, np.uint8)]), depth)
    pointer = np.unique(np.ascontiguousarray(words).view(f"V{depth}" if depth != 8 else np.uint64).ravel(), return_inverse=True)[1].astype(np.int64)
    count, used = np.bincount(pointer), int(pointer.max(initial=-1)) + 1
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        depth += step
        open_ = np.flatnonzero((room >= depth) & (count[pointer] > 1))
        if not len(open_):
            break
        place = np.unique(pointer[open_] * used + pointer[open_ + step], return_inverse=True)[1]
        pointer[open_] = used + place
        used += int(place.max()) + 1
        count = np.bincount(pointer, minlength=used)
    return pointer


def _places(place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of some runs: the run, the number in the run, and the place."""
    of = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, within, place[of] + within


def _refined(t: pa.Table) -> pa.RecordBatch:
    """The strings of whole buckets that also start earlier, as runs."""
    n, place, snippets = t["n"].to_numpy().astype(np.int64), t["src"].to_numpy(), t["snippet"].to_pylist()
    sizes = np.array([len(s) for s in snippets])
    of, within, at = _places(place, n)
    pointer = refine(np.frombuffer(b"".join(snippets), np.uint8), np.cumsum(sizes))[(np.cumsum(sizes) - sizes)[of] + within]
    order = np.lexsort((at, pointer))
    later = np.zeros(len(at), bool)
    later[order[1:]] = pointer[order[1:]] == pointer[order[:-1]]
    found = np.flatnonzero(later)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (of[found[1:]] != of[found[:-1]])  # a run ends with its snippet
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(at[found[first]]), pa.array(np.diff(first, append=len(found)))], ["place", "n"])


def _sort_buckets(batches):
    """Buckets, in the order of m, a few at a time."""
    rest = None
    for b in batches:
        new = pa.Table.from_batches([b])
        t = new if rest is None else pa.concat_tables([rest, new])
        m = t["m"].to_numpy()
        other = np.flatnonzero(m != m[-1]) if len(m) else m
        whole = int(other[-1]) + 1 if len(other) else 0  # the last bucket may go on
        rest = t.slice(whole)
        if whole:
            yield _refined(t.slice(0, whole))
    if rest is not None and len(rest):
        yield _refined(rest)


#: Runs of one range of left contexts, those from low to high. A string's left context is how many of
#: its bytes lie before its sampled q-gram; left is that of the run's first string.
SPAN = "id long, low int, high int, src long, n long, left int, snippet binary"


def _spans(batches):
    """Runs of wide buckets, with their first string's left context."""
    for b in batches:
        m, snippets = b.column("m").to_numpy(), b.column("snippet").to_pylist()
        if not snippets:
            continue
        sizes = np.array([len(t) for t in snippets])
        grams = pointers(np.frombuffer(b"".join(snippets), np.uint8))[0].view(np.int64)
        of_first = grams[(np.cumsum(sizes) - sizes)[:, None] + np.arange(GRAMS)]
        left, same = np.argmax(of_first == m[:, None], axis=1), np.zeros(len(m), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(same), pa.array(same + GRAMS - 1), b.column("src"), b.column("n"), pa.array(left.astype(np.int32)), b.column("snippet")], ["id", "low", "high", "src", "n", "left", "snippet"])


def _halve(batches):
    """The strings of each run whose left contexts lie in either half of the range, as runs, with the
    bytes that all strings of the half have and those of the whole range need not have (key), and two
    identifiers of their text. The whole range of a q-gram is not known to share more than that one's
    identifier, so there the key is all that the half shares."""
    for b in batches:
        out = []
        for m, low, high, src, n, left, snippet in zip(*(b.column(c).to_pylist() for c in ("id", "low", "high", "src", "n", "left", "snippet"))):
            mid = (low + high) // 2
            for a, z in ((low, mid), (mid + 1, high)):
                most, least = min(z, left), max(a, left - n + 1)
                if least > most:
                    continue
                at, count = left - most, most - least + 1
                text, first = snippet[at : at + count + LENGTH - 1], high - low == GRAMS - 1
                since = left - a if first or a > low else left - high + LENGTH
                until = left - z + LENGTH if first or a == low else left - low
                one, two = np.frombuffer(proof(text), np.int64).tolist()
                out.append((m, a, z, src + at, count, most, text, snippet[since:until], one, two))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 10, kinds)], ["id", "low", "high", "src", "n", "left", "snippet", "key", "one", "two"])


def refine_wide(runs_: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Of runs_(m, src, n, snippet) of wide buckets: place and n of those that repeat an earlier one
    whole, and the runs of buckets that are left to refine, which are not wide.

    A round halves the range of left contexts of a bucket's runs. All strings of a half share further
    bytes at a later offset of its strings (or, in the other half, an earlier one), and a bucket is
    refined by the half and these bytes; the least place of a bucket is its new identifier. Of each text
    of a half the first run goes on, the others repeat it, and a text that is alone in its bucket is
    done. So texts that go on are those that part within the half, a few halves each, however many
    strings they have; at last a bucket is of one string.
    """
    wide, done, k = runs_, [], 0
    while True:
        halve = _halve if k else lambda batches: _halve(_spans(batches))  # one Python step, so one worker a task
        halves = steps.store(f"halves-{k}", map_batches(wide, halve, f"{SPAN}, key binary, one long, two long"))
        bucket = ["id", "low", "key"]
        texts = halves.groupBy(*bucket, "one", "two").agg(F.min("src").alias("first"))
        refined = texts.groupBy(*bucket).agg(F.min("first").alias("least"), F.count("*").alias("c"))
        rows = halves.join(texts, [*bucket, "one", "two"]).join(refined, bucket).where("c > 1 or src != first")
        whole = F.col("src") != F.col("first")
        rows = steps.store(f"spans-{k}", rows.select(F.col("least").alias("id"), "low", "high", "src", "n", "left", F.when(~whole, F.col("snippet")).alias("snippet"), (F.col("c") > WIDE).alias("wide"), whole.alias("whole")))
        steps.drop(f"halves-{k}")
        done.append(rows)
        wide, k = rows.where("wide and not whole").select("id", "low", "high", "src", "n", "left", "snippet"), k + 1
        if wide.isEmpty():
            break
    rows = reduce(DataFrame.union, done)
    return rows.where("whole").select(F.col("src").alias("place"), "n"), rows.where("not whole and not wide").select(F.col("id").alias("m"), "src", "n", "snippet")


def _pack(batches):
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(NO), pa.array([z.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())], [NO, "packed"])


def _trim(shift: int):
    def run(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for no, packed, found in zip(*(b.column(c).to_pylist() for c in (NO, "packed", "found"))):
                data = z.decompress(packed)
                edge = np.zeros(len(data) + 1, np.int32)
                for r in found:
                    at = r["place"] & ((1 << shift) - 1)
                    end = at + r["n"] + LENGTH - 1
                    if r["proof"] is not None and proof(data[at:end]) != r["proof"]:
                        raise ValueError(f"two texts share an identifier: {r['place']}")
                    edge[at] += 1
                    edge[end] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((no, int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], [NO, "n_removed", "n_spans", "kept_sha256", KEPT])

    return run


def _numbered(docs: DataFrame, steps: Steps) -> tuple[DataFrame, int]:
    """docs with a number for each row, in the order of doc_id, and the bits that a place in
    a text needs. Numbers are the ids themselves if these are unique and small enough; else
    rows are sorted by doc_id, nulls first, and by the text's digest, and counted."""
    m = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.octet_length("text")).alias("size"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    shift = max(int(m["size"] or 1).bit_length(), 7)
    unique = m["rows"] == m["ids"] and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if unique and (m["rows"] == 0 or m["high"] - m["low"] < 1 << (62 - shift)):
        return docs.withColumn(NO, F.col("doc_id").cast("long") - F.lit(m["low"] or 0)), shift
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.sha2("text", 256))
    rows = steps.store("numbered", ordered.withColumn(NO, F.monotonically_increasing_id()))
    part, at = F.shiftright(NO, 33), F.col(NO).bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    starts = [(r["part"], s) for r, s in zip(counts, accumulate((r["count"] for r in counts), initial=0))]
    of = F.broadcast(docs.sparkSession.createDataFrame(starts, f"{OF} long, {START} long"))
    return rows.join(of, part == F.col(OF)).withColumn(NO, F.col(START) + at).drop(OF, START), shift


def repeats(docs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """docs with a number NO for each row, and for those that lose something NO and columns, of
    n_removed, n_spans, kept_sha256 and KEPT (the bytes that stay as text, torn characters left out).

    Each byte goes that is covered by a string of LENGTH bytes which also starts earlier: in
    a document of smaller doc_id, or further left in the same one. Texts shorter than that,
    empty and null ones lose nothing. Rows that share a doc_id come in the order of their
    texts' digests, those without one first; an empty table gives no rows.
    """
    steps = Steps(docs.sparkSession, "repeats")
    docs, shift = _numbered(docs, steps)
    no = lambda c: F.shiftright(F.col(c), shift).alias(NO)
    piece = F.floor(F.col("src").bitwiseAND((1 << shift) - 1) / PIECE).alias("piece")

    found = map_batches(docs.select(NO, "text"), _find_runs(shift, CHUNK), "m long, f long, place long, n short")
    buckets = found.groupBy("m").agg(F.count("*").alias("c"), F.min("f").alias("f0"), F.max("f").alias("f1"), F.min("place").alias("first")).where("c > 1")
    buckets = steps.store("buckets", buckets.select("m", F.when(F.col("f0") == F.col("f1"), F.col("first")).alias("src")))
    hits = found.join(buckets, "m").where("src is null or place != src")
    mixed = F.col("src").isNull()
    hits = steps.store("hits", hits.select(F.when(mixed, F.col("m")).alias("m"), F.when(mixed, F.col("f")).alias("f"), "place", "n", "src"))
    steps.drop("buckets")

    several = hits.where(mixed)
    texts = steps.store("texts", several.groupBy("m", "f").agg(F.min("place").alias("src"), F.max("n").cast("long").alias("n")))
    later = several.drop("src").join(texts.select("m", "f", "src"), ["m", "f"]).where("place != src").select("place", "n", "src")
    copies = hits.where(~mixed).select("place", "n", "src").union(later)
    copies = copies.withColumn(NO, no("place")).repartition(NO).sortWithinPartitions("place").select("place", "n", "src")
    chains = steps.store("chains", map_batches(copies, _chain(shift, PIECE), "place long, n long, src long"))
    steps.drop("hits")

    sizes = steps.store("sizes", texts.groupBy("m").agg((F.count("*") > WIDE).alias("wide")))
    proofs = chains.select("src", "n").distinct().select("src", "n", F.lit(None).cast("long").alias("m"), F.lit(False).alias("wide"))
    asked = texts.join(sizes, "m").select("src", "n", "m", "wide").union(proofs).select(no("src"), piece, "src", "n", "m", "wide")
    # Dealt out even where one side is small: broadcast, both Python steps would share a stage, with two workers a task.
    pieces = map_batches(docs.select(NO, "text"), _pieces(PIECE), f"{NO} long, piece long, data binary").hint("merge")
    cut = map_batches(asked.join(pieces, [NO, "piece"]).select("src", "piece", "n", "m", "wide", "data"), _cut(shift, PIECE), "src long, n long, m long, wide boolean, snippet binary, proof binary")
    cut = steps.store("cut", cut)
    steps.drop("texts", "sizes")

    narrow = cut.where("m is not null and not wide").select("m", "src", "n", "snippet")
    wide = cut.where("wide").select("m", "src", "n", "snippet")
    refined = []
    if not wide.isEmpty():
        whole, rest = refine_wide(wide, steps)
        refined, narrow = [whole], narrow.union(rest)
    refined.append(map_batches(narrow.repartition("m").sortWithinPartitions("m"), _sort_buckets, "place long, n long"))
    refined = reduce(DataFrame.union, refined).withColumn("proof", F.lit(None).cast("binary"))
    proven = chains.join(cut.where("m is null").select("src", "n", "proof"), ["src", "n"]).select("place", "n", "proof")
    gone = steps.store("found", refined.union(proven).groupBy(no("place")).agg(F.collect_list(F.struct("place", "n", "proof")).alias("found")))
    steps.drop(*(name for name in list(steps.paths) if name not in ("numbered", "found")))

    packed = map_batches(docs.select(NO, "text"), _pack, f"{NO} long, packed binary").hint("merge")  # as above
    gone = map_batches(gone.join(packed, NO).select(NO, "packed", "found"), _trim(shift), f"{NO} long, n_removed long, n_spans long, kept_sha256 string, {KEPT} string")
    gone = steps.store("gone", gone.select(NO, *columns))
    steps.drop("found")
    return docs, gone


def remove(docs: DataFrame) -> DataFrame:
    """docs, all columns, with repeated bytes taken out of the texts; null texts stay null."""
    numbered, gone = repeats(docs, KEPT)
    out = numbered.join(gone, NO, "left")
    return out.withColumn("text", F.coalesce(KEPT, "text")).select(*docs.columns)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: one row for each row; null texts count as empty."""
    docs, gone = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "n_removed", "n_spans", "kept_sha256")
    text = F.coalesce("text", F.lit(""))
    base = docs.select(NO, "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(gone, NO, "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
