"""Media columns for interleaved document sequences (operator 4).

HTML is parsed into an ordered array of structs: text, or a reference to media by digest
with its caption. Payloads lie in a store keyed by that digest, as 8-bit greyscale PNG
images 64 samples wide. The store's bytes are read back, checked and described, and a join
on the digest resolves each reference while its position and caption stay beside it.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, table, texts

WIDTH = 64
PREFIX = "media:sha256:"
PNG = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
LOCAL_DIGESTS = 200_000


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as rows of an 8-bit greyscale image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; raises if it is damaged."""
    if media[:8] != PNG:
        raise ValueError("no PNG signature")
    at, parts, shape, ended = 8, [], None, False
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        parts += [data] if kind == b"IDAT" else []
        ended |= kind == b"IEND"
        at += 12 + size
    if shape is None or not ended or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale image")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only filter type 0 is written here")
    return lines[:, 1:].tobytes()


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def feature(data: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step from one to the next."""
    x = np.frombuffer(data, np.uint8)
    n = np.bincount(x, minlength=256)
    v = np.arange(256)
    mean = float((n * v).sum()) / len(x)
    dev = math.sqrt(max(float((n * v * v).sum()) / len(x) - mean * mean, 0.0))
    p = n[n > 0] / len(x)
    steps = np.abs(np.diff(x.astype(np.int16))).sum() / max(len(x) - 1, 1)
    return f"mean={mean:.4f};dev={dev:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};step={steps:.4f}"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.caption, self.skip = [], [], None, 0

    def flush(self):
        if joined := " ".join("".join(self.text).split()):
            self.items.append({"kind": "text", "text": joined, "digest": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "img":
            self.flush()
            a = dict(attrs)
            src = a.get("src") or ""
            self.items.append({"kind": "media", "text": None, "digest": src.removeprefix(PREFIX) if src.startswith(PREFIX) else None, "caption": a.get("alt")})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "figure", "article", "section", "tr", "ul", "ol", "table"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(self.skip - 1, 0)
        elif tag == "figcaption" and self.caption is not None:
            last = next((i for i in reversed(self.items) if i["kind"] == "media"), None)
            if last is not None:
                last["caption"] = " ".join("".join(self.caption).split())
            self.caption = None
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "figure", "article", "section", "tr", "ul", "ol", "table"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(page: str | None) -> list[dict]:
    """Texts and media references of a page in reading order; none for a null page."""
    p = _Sequence()
    p.feed(page or "")
    p.close()
    p.flush()
    return [{"pos": i, **x} for i, x in enumerate(p.items)]


def parse(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and sequence of pages(key, html, ...); an empty sequence for an empty page."""
    kind = pages.schema[key].dataType.simpleString()
    item = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([sequence_of(h) for h in b.column("html").to_pylist()], pa.list_(item))], [key, "sequence"])

    return map_batches(pages.select(key, "html"), run, f"{key} {kind}, sequence {SEQUENCE}")


def _store(batches):
    seen: set[bytes] = set()
    for b in batches:
        rows = []
        for t in texts(b):
            d = hashlib.sha256(t.encode()).digest()
            if d not in seen:
                if len(seen) >= LOCAL_DIGESTS:
                    seen.clear()
                seen.add(d)
                rows.append((d.hex(), len(t.encode()), to_png(payload(t))))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.binary()))], ["digest", "n_bytes", "media"])


def build_store(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the texts of docs(text, ...) as media keyed by digest and read the table again.
    Null texts are empty ones. A digest that several tasks meet may be stored by each; the
    bytes are the same."""
    return stored(map_batches(docs.select("text"), _store, "digest string, n_bytes long, media binary"), "media-store", path)


def _describe(batches):
    for b in batches:
        rows = []
        for d, n, m in zip(*(b.column(c).to_pylist() for c in ("digest", "n_bytes", "media"))):
            data = from_png(m)
            if hashlib.sha256(data[:n]).hexdigest() != d:
                raise ValueError(f"stored bytes differ from their digest {d}")
            rows.append((d, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), feature(data)))
        s, i = pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, (s, i, i, s, i, i, s, s))], [x.split()[0] for x in FEATURES.split(", ")])


def describe(store: DataFrame) -> DataFrame:
    """Features of the stored bytes, one row for each digest; rows without media are an
    error, as are bytes that differ from their digest."""
    rows = map_batches(store.select("digest", "n_bytes", "media"), _describe, FEATURES)
    names = [c for c in rows.columns if c != "digest"]
    return rows.groupBy("digest").agg(F.max(F.struct(*names)).alias("m")).select("digest", "m.*")


def resolve(sequences: DataFrame, features: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each item of the sequences, in any order: the columns beside sequence, pos,
    kind, text, digest, caption, and what the store has for its digest (null where it has
    nothing). Items without a digest, such as texts, find nothing and are spread by their
    key and place. Rows that share a key, or have none, keep their items apart only by
    their other columns."""
    items = sequences.select(*[c for c in sequences.columns if c != "sequence"], F.inline("sequence"))
    spread = F.concat(F.lit("-"), F.xxhash64(key, "pos").cast("string"))
    found = features.withColumnRenamed("digest", "__media_of")
    return items.withColumn("__media_of", F.coalesce("digest", spread)).join(found, "__media_of", "left").drop("__media_of")


def page_of(text: Column) -> Column:
    """A page of a text: its lines as paragraphs, and after the first of them a figure that
    refers to the text's payload."""
    lines = F.split(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "\n")
    caption = F.concat(F.lit("text of "), F.length(text).cast("string"), F.lit(" characters"))
    figure = F.concat(F.lit(f'<figure><img src="{PREFIX}'), F.sha2(text, 256), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "</p><p>")
    return F.concat(F.lit("<article><p>"), lines[0], F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: each row's text as a page, of whose items the figure
    is resolved; pos is its place among n_items. Null texts count as empty, and rows that
    repeat an id or a text each give a row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    features = stored(describe(build_store(docs)), "features")  # a plain join side: Spark can split hot digests
    sequences = parse(docs.select("doc_id", page_of(F.col("text")).alias("html")), "doc_id")
    items = resolve(sequences.withColumn("n_items", F.size("sequence")), features, "doc_id").where("kind = 'media'")
    return items.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "n_items", "caption")
