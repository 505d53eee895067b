"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, schemes, digits and the marks before them, and words that
introduce an identifier. At each anchor a deterministic parser expands to the left and right and validates what it finds:
mail addresses, network addresses, card and account numbers, phone numbers. Each parser goes on where it last ended, so a
text costs in proportion to its length.

The base kinds (email, ip, card, phone) are the contract's patterns, leftmost and non-overlapping per kind. The method's
own kinds are added unless a base span covers them: mail addresses beyond ASCII, IPv6 addresses, user names and passwords
in URLs, tel: numbers, IBANs, social security numbers and account numbers that a cue names.

Defined cases: a null or empty text has no spans. Repeated rows are scanned alike; extra columns stay, whatever their
names, but for `spans`, which is replaced (and `text`, by `redact`). An empty table gives an empty result. Offsets count
code points, the end is exclusive. Numbers are ASCII digits.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import ROW, enclosed, table

#: Kinds in order of rank; the first four are the contract's base kinds.
KINDS = ["email", "ip", "card", "phone", "email_intl", "ip6", "userinfo", "tel", "iban", "ssn", "account"]
N_BASE = 4
SPAN = T.ArrayType(T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))

SCHEMES = ["http://", "https://", "ftp://", "sftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://"]
ACCOUNT_CUES = ["account", "acct", "konto", "compte", "cuenta", "passport", "customer id", "user id", "member id"]
SSN_CUES = ["ssn", "social security"]

DIGITS = frozenset("0123456789")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HEX_COLON = frozenset("0123456789abcdefABCDEF:.")
#: What a parser takes at its place, with no choice on the way: no two parts of a pattern can take the same character.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
INTL_DOMAIN = re.compile(r"[^\W_](?:[^\W_]|-)*(?:\.[^\W_](?:[^\W_]|-)*)*\.[^\W\d_]{2,}(?![^\W_])")
USERINFO = re.compile(r"[^\s/?#@\[\]<>\"']+(?=@[A-Za-z0-9\[])")
TEL = re.compile(r"[0-9][\x20().0-9-]*[0-9]")
#: Between a cue and its value: a word or a sign, with a few spaces.
GAP = r"\x20{0,3}(?:number|nummer|no\.?|nr\.?|id)?\x20{0,3}[:=#]?\x20{0,3}"
IBAN = re.compile(GAP + r"([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){10,30})")
SSN = re.compile(GAP + r"(([0-9]{3})-([0-9]{2})-([0-9]{4}))(?![0-9-])")
ACCOUNT = re.compile(GAP + r"([A-Za-z0-9-]{6,20})(?![A-Za-z0-9-])")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    words = {"@": "at", "::": "colons"} | {d: "digit" for d in DIGITS} | {f".{d}": "dot" for d in DIGITS} | {f"+{d}": "plus" for d in DIGITS}
    words |= {s: "scheme" for s in SCHEMES} | {"tel:": "tel", "iban": "iban"} | {c: "ssn" for c in SSN_CUES} | {c: "account" for c in ACCOUNT_CUES}
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


ANCHORS = _anchors()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (10 if c in DIGITS else 100) + int(c, 36)) % 97
    return rest == 1


class Scan:
    """The parsers' state over one text: how far each has come, and the spans found."""

    def __init__(self, text: str):
        self.text = text
        self.done = [0] * len(KINDS)
        self.found: list[tuple[int, int, int]] = []

    def _add(self, kind: str, start: int, stop: int) -> None:
        self.found.append((KINDS.index(kind), start, stop))

    def _back(self, at: int, floor: int, allowed: frozenset[str]) -> int:
        while at > floor and self.text[at - 1] in allowed:
            at -= 1
        return at

    def at(self, p: int, length: int) -> None:
        start = self._back(p, self.done[0], LOCAL)
        m = DOMAIN.match(self.text, p + 1) if start < p else None
        if m:
            self._add("email", start, m.end())
            self.done[0] = m.end()
        wide = p
        while wide > self.done[4] and (self.text[wide - 1] in LOCAL or self.text[wide - 1].isalnum()):
            wide -= 1
        m = INTL_DOMAIN.match(self.text, p + 1) if wide < p else None
        if m and not self.text[wide : m.end()].isascii():
            self._add("email_intl", wide, m.end())
        self.done[4] = p + 1

    def dot(self, p: int, length: int) -> None:
        if p < self.done[1]:
            return
        start = self._back(p, self.done[1], DIGITS)
        m = QUADS.match(self.text, start) if start < p else None
        if not m:
            return
        self.done[1] = m.end()
        parts, at = m.group().split("."), start
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = at + sum(map(len, four)) + 3
            if all(map(octet, four)):
                self._add("ip", at, stop)
            at = stop + 1

    def digit(self, p: int, length: int) -> None:
        m = GROUPED.match(self.text, p) if p >= self.done[2] else None
        if m:
            self.done[2] = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                self._add("card", p, m.end())

    def plus(self, p: int, length: int) -> None:
        m = PHONE.match(self.text, p)
        if m and 8 <= sum(c in DIGITS for c in m.group()) <= 15:
            self._add("phone", p, m.end())

    def colons(self, p: int, length: int) -> None:
        if p < self.done[5]:
            return
        start, stop = self._back(p, self.done[5], HEX_COLON), p
        while stop < len(self.text) and self.text[stop] in HEX_COLON:
            stop += 1
        self.done[5] = stop
        stop = start + len(self.text[start:stop].rstrip("."))
        value = self.text[start:stop]
        outside = self.text[start - 1 : start] + self.text[stop : stop + 1]
        if len(value) <= 45 and sum(map(bool, value.split(":"))) >= 3 and not any(c.isalnum() or c == "_" for c in outside):
            try:
                ipaddress.IPv6Address(value)
            except ValueError:
                return
            self._add("ip6", start, stop)

    def scheme(self, p: int, length: int) -> None:
        m = USERINFO.match(self.text, p + length) if p + length >= self.done[6] else None
        if m:
            self._add("userinfo", m.start(), m.end())
            self.done[6] = m.end()

    def tel(self, p: int, length: int) -> None:
        m = TEL.match(self.text, p + length) if self._starts(p) else None
        if m and 7 <= sum(c in DIGITS for c in m.group()) <= 15:
            self._add("tel", m.start(), m.end())

    def iban(self, p: int, length: int) -> None:
        m = IBAN.match(self.text, p + length) if self._starts(p) else None
        stop = m.end(1) if m else 0
        while m and stop - m.start(1) >= 15:  # the longest part up to a space that is valid
            value = self.text[m.start(1) : stop].replace(" ", "").upper()
            if len(value) <= 34 and mod97(value) and not self.text[stop : stop + 1].isalnum():
                self._add("iban", m.start(1), stop)
                return
            stop = self.text.rfind(" ", m.start(1), stop)

    def ssn(self, p: int, length: int) -> None:
        m = SSN.match(self.text, p + length) if self._starts(p) else None
        if m and m[2] not in ("000", "666") and m[2] < "900" and m[3] != "00" and m[4] != "0000":
            self._add("ssn", m.start(1), m.end(1))

    def account(self, p: int, length: int) -> None:
        m = ACCOUNT.match(self.text, p + length) if self._starts(p) else None
        if m and m.start(1) > p + length and sum(c in DIGITS for c in m[1]) >= 4:
            self._add("account", m.start(1), m.end(1))

    def _starts(self, p: int) -> bool:
        """The cue at p begins a word."""
        return p == 0 or not self.text[p - 1].isalnum()


def _lower(text: str) -> str:
    """Lower case with every character at its place, as offsets count."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, stop) of every span, by rank, then start."""
    if not text:
        return []
    scan = Scan(text)
    for end, (kind, length) in ANCHORS.iter(_lower(text)):
        getattr(scan, kind)(end - length + 1, length)
    base = sorted(s for s in scan.found if s[0] < N_BASE)
    return base + _uncovered(sorted(s for s in scan.found if s[0] >= N_BASE), base)


def _uncovered(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that no base span covers wholly. Both are walked in order of start: base spans that begin no later reach to `reach` at most."""
    kept, reach, k = [], 0, 0
    by_start = sorted((start, stop) for _, start, stop in base)
    for rank, start, stop in sorted(spans, key=lambda s: s[1]):
        while k < len(by_start) and by_start[k][0] <= start:
            reach, k = max(reach, by_start[k][1]), k + 1
        if stop > reach:
            kept.append((rank, start, stop))
    return sorted(kept)


@F.arrow_udf(SPAN)
def spans_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    for batch in texts:
        each = []
        for t in batch:
            text = t.as_py()
            each.append([{"rank": r, "start": a, "stop": b, "kind": KINDS[r], "value": text[a:b]} for r, a, b in find(text)])
        yield pa.array(each, kind)


@F.arrow_udf(T.StringType())
def _redacted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in batches:
        yield pa.array([redacted(t.as_py(), [(s["start"], s["stop"], s["kind"]) for s in found.as_py()]) for t, found in zip(texts, spans, strict=True)], pa.string())


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """text with [kind] in place of each span; of spans that overlap, the first names the mark of all."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, stop, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row`, docs' columns as a struct, and beside it `spans`: (rank, start, stop, kind, value) by kind as listed, then start. Only the text goes to Python."""
    return enclosed(docs).withColumn("spans", spans_of(F.col(ROW)[text_col]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `spans`, as `scanned` has them."""
    return scanned(docs.drop("spans"), text_col).select(f"{ROW}.*", "spans")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with [kind] in place of each span of the text."""
    rows = scanned(docs, text_col).withColumn("clean", _redacted(F.col(ROW)[text_col], F.col("spans")))
    return rows.select(*(F.col("clean").alias(c) if c == text_col else F.col(ROW)[c].alias(c) for c in docs.columns))


def base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < N_BASE)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank, kind: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")
    counts = [count(rank, kind) for rank, kind in enumerate(KINDS[:N_BASE])]
    return found.select("doc_id", *counts, F.sha2(spans_text(base(F.col("spans"))), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
