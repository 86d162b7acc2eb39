"""Secret scans with DataFrame functions only (operator 1).

Base kinds are regular expressions. Positions come from the pieces between the matches:
a match starts after all pieces and matches before it. Beyond these, candidate strings of
a character class are slid over by a window; counts are kept for each character, and a step
changes two of them and the sum of n*log2(n) by what these two add. Where a window's
Shannon entropy reaches the class's threshold, its span is found, unless the candidate is
on the allow-list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Base kinds in the order of their rank: pattern, and least length of a group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # whole runs, as of [0-9a-f]+, that are long enough
WINDOW = 20


@dataclass(frozen=True)
class CharClass:
    """Candidates of a character class and the entropy, in bits, that a window needs."""

    kind: str
    pattern: str
    bits: float
    mixed: bool  # a candidate needs letters and digits


CLASSES = (
    CharClass("entropy_hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", 3.0, True),
    CharClass("entropy_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", 3.6, True),
)
#: Spans with such a part are placeholders or alphabets, not secrets.
ALLOW = r"(?i)example|sample|dummy|placeholder|change_?me|your[_-]|redacted|(.)\1{7}|0123456789|abcdefghij"
#: Candidates that are one of these from end to end (UUIDs) are identifiers, not secrets.
ALLOW_WHOLE = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
#: Matches that are gathered at a time, so that the cost of a text grows with their number.
GATHER = 256
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of struct(start, hit)."""
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(hits, pieces, lambda hit, piece: F.struct(F.coalesce(F.length(piece), F.lit(0)).alias("before"), hit.alias("hit")))
    steps = F.filter(steps, lambda s: s["hit"].isNotNull())
    none = "cast(array() as array<struct<start:int,hit:string>>)"

    def step(z: Column, s: Column) -> Column:
        at = z["at"] + s["before"]
        found = F.array_append(z["found"], F.struct(at.alias("start"), s["hit"].alias("hit")))
        return F.struct((at + F.length(s["hit"])).alias("at"), found.alias("found"))

    def part(z: Column, i: Column) -> Column:
        part_of = F.slice(steps, i * GATHER + 1, F.lit(GATHER))
        done = F.aggregate(part_of, F.struct(z["at"].alias("at"), F.expr(none).alias("found")), step)
        return F.struct(done["at"].alias("at"), F.array_append(z["found"], done["found"]).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,hit:string>>>)").alias("found"))
    parts = F.sequence(F.lit(0), F.floor(F.size(steps) / GATHER).cast("int"))
    walk = F.aggregate(parts, zero, part, lambda z: F.flatten(z["found"]))
    return F.when(text.rlike(pattern), walk)


def _spans(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["hit"])).alias("end"), F.lit(kind).alias("kind")))


def _dense(hit: Column, bits: float) -> Column:
    """struct(first, last): where the first window that reaches bits starts and the last
    one ends in hit; null fields if there is none."""
    need = WINDOW * F.log2(F.lit(float(WINDOW))) - WINDOW * bits  # the sum of n*log2(n) at most
    chars = F.filter(F.split(hit, ""), lambda c: c != "")
    gain = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(WINDOW + 1)])
    alphabet = F.array_distinct(chars)
    coded = F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int"))
    zero = F.struct(F.transform(alphabet, lambda c: F.lit(0)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), coded.alias("s"))

    def step(z: Column, c: Column) -> Column:
        gone = F.when(z["i"] >= WINDOW, F.element_at(z["s"], z["i"] - WINDOW + 1)).otherwise(F.lit(0))
        had, lost = F.element_at(z["n"], c), F.greatest(F.element_at(z["n"], F.greatest(gone, F.lit(1))), F.lit(1))
        same = gone == c
        at = lambda n: F.element_at(gain, n + 1)
        total = z["sum"] + F.when(same, F.lit(0.0)).otherwise(at(had + 1) - at(had) + F.when(gone > 0, at(lost - 1) - at(lost)).otherwise(0.0))
        counts = F.when(same, z["n"]).otherwise(F.transform(z["n"], lambda n, j: n + F.when(j + 1 == c, 1).otherwise(0) - F.when(j + 1 == gone, 1).otherwise(0)))
        hot = (z["i"] + 1 >= WINDOW) & (total <= need + 1e-9)
        return F.struct(counts.alias("n"), total.alias("sum"), (z["i"] + 1).alias("i"), F.coalesce(z["first"], F.when(hot, z["i"] + 1 - WINDOW)).alias("first"), F.when(hot, z["i"] + 1).otherwise(z["last"]).alias("last"), z["s"].alias("s"))

    return F.aggregate(coded, zero, step, lambda z: F.struct(z["first"].alias("first"), z["last"].alias("last")))


def _entropy_spans(text: Column, c: CharClass, rank: int, allow: str, whole: str) -> Column:
    """A candidate's span runs from its first dense window to the end of its last one, with
    whatever lies between them."""
    fit = lambda m: ~m["hit"].rlike(whole) & ((m["hit"].rlike("[A-Za-z]") & m["hit"].rlike("[0-9]")) if c.mixed else F.lit(True))
    dense = F.transform(F.filter(_matches(text, c.pattern), fit), lambda m: F.struct(m["start"].alias("start"), m["hit"].alias("hit"), _dense(m["hit"], c.bits).alias("w")))
    kept = F.filter(dense, lambda d: d["w"]["first"].isNotNull() & ~d["hit"].substr(d["w"]["first"] + 1, d["w"]["last"] - d["w"]["first"]).rlike(allow))

    def span(d: Column) -> Column:
        first, last = d["start"] + d["w"]["first"], d["start"] + d["w"]["last"]
        return F.struct(first.alias("start"), F.lit(rank).alias("rank"), last.alias("end"), F.lit(c.kind).alias("kind"))

    return F.transform(kept, span)


def _or_empty(spans: Column) -> Column:
    return F.coalesce(spans, F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds: array of struct(start, rank, end, kind), by start and rank."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 12)
    access = F.filter(_matches(text, ACCESS), lambda m: F.length(m["hit"]) >= 18)
    found = [_spans(assign, 1, "assign"), _spans(access, 2, "access"), _spans(_matches(text, HEX), 3, "hex")]
    return F.array_sort(F.concat(*map(_or_empty, found)))


def entropy_spans(text: Column, classes=CLASSES, allow: str = ALLOW, allow_whole: str = ALLOW_WHOLE) -> Column:
    """Spans of candidates that hold a dense window and are not on the allow-list."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(_or_empty(_entropy_spans(text, c, 4 + i, allow, allow_whole)) for i, c in enumerate(classes)))


def find(docs: DataFrame, base: str = "base_found", found: str = "found", **options) -> DataFrame:
    """docs(text, ...) with two columns more, named by base and found (columns of these
    names are replaced): arrays of struct(start, rank, end, kind), by start and rank. Null
    and empty texts have none; every row gives a row, equal rows included. All other
    columns stay as they are."""
    out = docs.withColumn(base, base_spans(F.col("text")))
    return out.withColumn(found, F.array_sort(F.concat(base, entropy_spans(F.col("text"), **options))))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with each stretch of overlapping spans in its text replaced by mark; texts
    without spans, null ones included, and all other columns are left as they are."""
    private = "__secret_scan_"  # no column of docs
    text, names = F.col("text"), (f"{private}base", f"{private}found")
    found = F.col(names[1])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(z: Column, s: Column) -> Column:
        before = F.substring(text, z["at"] + 1, s["start"] - z["at"])
        apart = (s["start"] >= z["at"]) & ((s["start"] > 0) | (z["at"] == 0))
        out = F.when(apart, F.concat(z["out"], before, F.lit(mark))).otherwise(z["out"])
        return F.struct(F.greatest(z["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda z: F.concat(z["out"], F.substring(text, z["at"] + 1, F.length(text)))
    clean = F.when(F.size(found) > 0, F.aggregate(found, zero, step, rest)).otherwise(text)
    return find(docs, *names, **options).withColumn("text", clean).select(*docs.columns)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over `documents`: one row for each row, repeated ids included; a null
    text counts as empty and has no spans."""
    docs = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base_found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined("base_found"), 256).alias("base_sha256"), _joined("found").alias("spans"))
