"""Secret scans: three base patterns, and sliding-window Shannon entropy per character class over candidate strings.

Spark expressions only. The entropy of a window is kept by incremental counts: moving it by one character takes one
count down and one up, and changes the sum of c*log2(c) by those two terms. A candidate whose text matches the allow
list is suppressed; a candidate that other spans cover wholly adds nothing new and is left out. One that they cover in
part is a span of its own, so spans may overlap. What base spans leave of the text is also tested by itself, so that
the allow list can't suppress a secret for the base span that it is joined to.

Defined cases: a null or empty text has no spans. Repeated rows are scanned alike; extra columns stay, whatever their
names, but for `base_spans` and `spans`, which are replaced. An empty table gives an empty result. Very long texts and
candidates cost in proportion to their length, and spans little more than their number. Offsets count code points, the
end is exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ROW, enclosed, let, scan as running, table

#: The base patterns of the contract as (kind, pattern, group that is measured, least length).
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Character classes as (kind, alphabet, candidate pattern, window, least entropy in bits). A candidate has a digit and a letter.
CLASSES = [
    ("entropy_hex", "0123456789abcdefABCDEF", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{20,}+(?![A-Za-z0-9+/_-])", 16, 2.9),
    ("entropy_base64", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-=", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", 20, 3.7),
]
#: Candidates that are no secrets: examples and placeholders, dates, UUIDs, paths, and words joined by - _ or /.
ALLOW = [
    r"(?i)example|placeholder|changeme|your[_-]|dummy|0123456789abcdef|abcdefghijkl|x{6,}",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^/?[a-z]++(?:[/_-](?:[a-z]++|[0-9]++))++/?$",  # possessive: Java repeats a group by recursion, else, and runs out of stack
]

SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, value): the texts between matches give the offsets."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
    found = F.zip_with(values, gaps, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))

    def placed(hits: Column) -> Column:
        ends = running(hits, F.lit(0), "bigint", lambda at, x: at + x["gap"] + F.char_length(x["value"]))
        return F.zip_with(hits, ends, lambda x, end: F.struct((end - F.char_length(x["value"])).alias("start"), x["value"].alias("value")))

    # one gap more than matches: the text after the last
    return let(F.filter(found, lambda x: x["value"].isNotNull()), placed)


def _spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["value"])).alias("stop"), m["value"].alias("value")),
    ).cast(SPAN)


def base_spans(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of one base kind. Matches whose measured group is too short fail, but have used up their text."""
    long_enough = lambda m: F.char_length(F.regexp_extract(m["value"], pattern, group)) >= least
    # The group is matched again inside its own match, which starts at the same place and takes the same path.
    found = F.filter(matches(text, pattern), long_enough)
    return F.when(text.rlike(pattern), _spans(found, kind, rank)).otherwise(F.array().cast(SPAN))


def window_entropy(value: Column, alphabet: str, window: int) -> Column:
    """Largest Shannon entropy, in bits, of any window of the value, by incremental counts.

    State: the counts as a string with one character a symbol (chr(32 + count)), the sum of c*log2(c), and the least sum of a full window."""
    terms = F.split(F.lit(" ".join(repr(c * math.log2(c) if c else 0.0) for c in range(window + 2))), " ").cast("array<double>")
    symbols = F.transform(F.split(value, "", -1), lambda c: F.position(c, F.lit(alphabet)))
    zero = F.struct(F.lit(" " * len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))

    def count(counts: Column, total: Column, at: Column, sign: int) -> Column:
        c = F.ascii(F.substring(counts, at, F.lit(1))) - 32
        return let(c, lambda c: F.struct(F.overlay(counts, F.char(c + sign + 32), at, F.lit(1)).alias("counts"), (total + F.element_at(terms, c + sign + 1) - F.element_at(terms, c + 1)).alias("total")))

    def move(s: Column, x: Column) -> Column:
        """What leaves the window goes first: c is 0 while the window fills, and the last character's is the window's."""
        old = F.struct(s["counts"].alias("counts"), s["total"].alias("total"))
        left = F.when(x["out"] > 0, count(s["counts"], s["total"], x["out"], -1)).otherwise(old)
        now = let(left, lambda w: count(w["counts"], w["total"], x["in"], 1))
        return let(now, lambda w: F.struct(w["counts"].alias("counts"), w["total"].alias("total"), F.when(x["full"], F.least(s["least"], w["total"])).otherwise(s["least"]).alias("least")))

    def moves(at: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(0), window), at)
        step = F.zip_with(F.transform(at, lambda a, i: F.struct(a.alias("a"), (i >= window - 1).alias("full"))), F.slice(gone, F.lit(1), F.size(at)), lambda a, out: F.struct(a["a"].alias("in"), out.alias("out"), a["full"].alias("full")))
        return F.aggregate(step, zero, move, lambda s: F.lit(math.log2(window)) - s["least"] / window)

    return let(symbols, moves)


def entropy_spans(text: Column, kind: str, alphabet: str, pattern: str, window: int, least: float, rank: int) -> Column:
    """Spans of candidates with a window of enough entropy, without those that the allow list names."""

    def secret(m: Column) -> Column:
        v = m["value"]
        plain = v.rlike("|".join(f"(?:{p})" for p in ALLOW))
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~plain & (window_entropy(v, alphabet, window) >= least)

    return F.when(text.rlike(pattern), _spans(F.filter(matches(text, pattern), secret), kind, rank)).otherwise(F.array().cast(SPAN))


def _uncovered(spans: Column, others: Column) -> Column:
    """Spans that the others don't cover wholly. Both are walked at once in order of start, with how far the others reach without a gap."""
    tagged = lambda c, mine: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(mine).alias("mine"), s.alias("span")))
    both = F.array_sort(F.concat(tagged(others, False), tagged(spans, True)))  # at one start others come first
    reach = lambda at, x: F.when(x["mine"], at).when(x["start"] <= at, F.greatest(at, x["span"]["stop"])).otherwise(x["span"]["stop"])

    def open_(marks: Column) -> Column:
        at = F.zip_with(marks, running(marks, F.lit(-1), "bigint", reach), lambda x, r: F.struct(x["mine"].alias("mine"), x["span"].alias("span"), (r < x["span"]["stop"]).alias("open")))
        return F.transform(F.filter(at, lambda x: x["mine"] & x["open"]), lambda x: x["span"])

    return F.when(F.size(spans) == 0, spans).when(F.size(others) == 0, spans).otherwise(let(both, open_))


def _joined(spans: Column) -> Column:
    """Spans in order of start as (start, stop), with those that overlap made one."""
    grow = lambda s, x: F.when(x["start"] >= s["stop"], F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).otherwise(F.struct(s["start"].alias("start"), F.greatest(s["stop"], x["stop"]).alias("stop")))
    states = running(spans, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop")), "struct<start:bigint,stop:bigint>", grow)
    return let(states, lambda all_: F.filter(all_, lambda s, i: (i == F.size(all_) - 1) | (F.get(all_, i + 1)["start"] != s["start"])))


def _rewritten(text: Column, spans: Column, mark: Callable[[Column], Column], size: int = 256) -> Column:
    """text with mark(length) in place of each span; spans: in order, apart from each other.

    They are taken `size` at a time with the part of the text that they lie in: cutting a string costs as much as it is long."""
    cut = lambda t, start, stop: F.substring(t, (start + 1).cast("int"), (stop - start).cast("int"))

    def put(at: Column, head: Column, part: Column) -> Column:
        step = lambda s, x: F.struct(x["stop"].alias("at"), F.concat(s["out"], F.array(F.concat(cut(head, s["at"] - at, x["start"] - at), mark((x["stop"] - x["start"]).cast("int"))))).alias("out"))
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: F.array_join(s["out"], ""))

    def step(s: Column, part: Column) -> Column:
        end = F.element_at(part, -1)["stop"]
        head = let(cut(s["rest"], F.lit(0), end - s["at"]), lambda head: put(s["at"], head, part))
        return F.struct(end.alias("at"), F.substring(s["rest"], (end - s["at"] + 1).cast("int"), F.char_length(s["rest"])).alias("rest"), F.concat(s["out"], F.array(head)).alias("out"))

    def whole(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda k: F.slice(all_, k * size + 1, F.lit(size)))
        zero = F.struct(F.lit(0).cast("long").alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))
        return F.when(F.size(all_) > 0, F.aggregate(parts, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), s["rest"]))).otherwise(text)

    return let(spans, whole)


def _blanked(text: Column, spans: Column) -> Column:
    """text with spaces in place of the spans, so that what is joined to them stands alone at its own offsets."""
    return _rewritten(text, _joined(spans), lambda n: F.repeat(F.lit(" "), n))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row`, docs' columns as a struct, and beside it `base_spans` and `spans` (base ones and the method's), arrays of (start, rank, kind, stop, value) by start, then kind."""
    text = F.coalesce(F.col(ROW)[text_col], F.lit(""))
    raw = {f"base_{kind}": base_spans(text, kind, pattern, group, least, rank) for rank, (kind, pattern, group, least) in enumerate(BASE)}
    entropy = lambda t, name: {name + kind: entropy_spans(t, kind, alphabet, pattern, window, least, len(BASE) + i) for i, (kind, alphabet, pattern, window, least) in enumerate(CLASSES)}
    raw |= entropy(text, "")
    parts = entropy(F.col("rest"), "rest_")
    df = enclosed(docs).withColumns(raw)
    df = df.withColumn("base_spans", F.array_sort(F.concat(*(F.col(f"base_{b[0]}") for b in BASE))))
    df = df.withColumn("rest", F.when(F.size("base_spans") > 0, _blanked(text, F.col("base_spans")))).withColumns(parts)
    spans = F.col("base_spans")
    for name in [kind for kind, *_ in CLASSES] + list(parts):
        df = df.withColumn("spans", F.array_sort(F.concat(spans, _uncovered(F.col(name), spans))))
        spans = F.col("spans")
    return df.select(ROW, "base_spans", "spans")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `base_spans` and `spans`, as `scanned` has them."""
    return scanned(docs.drop("base_spans", "spans"), text_col).select(f"{ROW}.*", "base_spans", "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each span, or run of overlapping spans, replaced by the mark."""
    return _rewritten(text, _joined(spans), lambda n: F.lit(mark))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind, *_ in BASE), F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
