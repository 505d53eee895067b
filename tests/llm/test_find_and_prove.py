"""Personal data, ranked search and the Merkle manifest, each against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import lexical_search, merkle, pii
from millrace.llm.queries import ORACLES
from tests.compare import same
from tests.llm.helpers import awkward, empty, saved

# --- personal data ---


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    """The contract's patterns by a backtracking engine."""
    text, out = text or "", []
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        out += [(2, *m.span())] * (16 <= len(digits) <= 19 and luhn(digits))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["ab@.-", "01.2", "0123456789 -", "+0 ().-1@a", "a@.é_%", "1234567890.@+ -a"])
def test_base_spans_by_brute_force(alphabet):
    rng = random.Random(alphabet)
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find(text) if s[0] < pii.N_BASE] == base_spans(text), text


@pytest.mark.parametrize(
    "text,found",
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 and", [("iban", "DE89 3704 0044 0532 0130 00")]), ("IBAN: DE88 3704 0044 0532 0130 00", []),
        ("İ IBAN DE89370400440532013000", [("iban", "DE89370400440532013000")]), ("ssn 123-45-6789.", [("ssn", "123-45-6789")]), ("ssn 666-45-6789", []),
        ("account no. 12345678, x", [("account", "12345678")]), ("accountant 12345678", []), ("on account of rain", []), ("https://bob:pw1@host/", [("userinfo", "bob:pw1")]), ("https://host/a@b", []),
        ("tel:030 1234567", [("tel", "030 1234567")]), ("hotel:030 1234567", []), ("an müller@bücher.de, x", [("email_intl", "müller@bücher.de")]),
        ("std::vector a::b 2001:db8::8a2e:370:7334.", [("ip6", "2001:db8::8a2e:370:7334")]),
    ],
)
def test_own_kinds(text, found):
    assert [(pii.KINDS[r], text[a:b]) for r, a, b in pii.find(text)] == found


@pytest.mark.parametrize("unit", ["1", "1.", "@", "a@", "+1", "::", "1 ", "http://", "account ", "iban ", "é@", "tel:1"])
def test_long_texts_in_linear_time(unit):
    assert isinstance(pii.find("iban" + " " * 200_000 + unit * 200_000), list)


def test_pii_of_awkward_rows(spark):
    rows = awkward(spark, "spans").withColumn("text", F.when(F.col("doc_id") == 8, "Ask jo@x.org, +1 (017) 555-7713 or 4952935900253052 at 7.88.85.226").otherwise(F.col("text")))
    found = pii.scan(rows)
    assert sorted(found.columns) == sorted(rows.columns) and found.count() == rows.count()
    assert [s["value"] for s in found.where("doc_id = 8").first()["spans"]] == ["jo@x.org", "7.88.85.226", "4952935900253052", "+1 (017) 555-7713"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(rows.drop("spans")).collect()}
    assert clean[8] == "Ask [email], [phone] or [card] at [ip]" and clean[4] is None and clean[3] == ""
    assert pii.scan(empty(spark)).count() == 0


def test_op11(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    folder = saved(rows.unionByName(awkward(spark).select("doc_id", "text")), tmp_path)
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        spans = base_spans(r["text"])
        counts = [sum(s[0] == k for s in spans) for k in range(pii.N_BASE)]
        want.append((r["doc_id"], *counts, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    got = [tuple(r)[:6] for r in pii.op11_pii(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] for r in got)


# --- ranked search ---


def ranked(docs, items, k=10):
    """The contract's scores, document by document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(d, w) for d, t in docs if (w := words(t))]
    n_docs, length, out = len(held), sum(len(w) for _, w in held), []
    counts = [(d, len(w), {x: w.count(x) for x in set(w)}) for d, w in held]
    for item, text in items:
        score = [0] * n_docs
        for term in set(words(text)):
            df = sum(term in c for _, _, c in counts)
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for i, (_, n, c) in enumerate(counts):
                if term in c:
                    score[i] += weight * (10**9 * c[term] // (1000 * c[term] + 8 * (10 + 90 * n * n_docs // length)))
        best = sorted((-s, held[i][0] is None, held[i][0] or 0) for i, s in enumerate(score) if s > 0)[:k]
        out += [(item, rank + 1, None if null else doc, -s) for rank, (s, null, doc) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_search_by_brute_force(spark, monkeypatch, seed):
    """Few words, so that ties and repeated texts abound; shards and blocks small enough for several of each."""
    monkeypatch.setattr(lexical_search, "SHARD", 300)
    monkeypatch.setattr(lexical_search, "BLOCK", 40 if seed == 1 else 1 << 18)
    monkeypatch.setattr(lexical_search, "LOOKUPS", 0 if seed == 2 else 1 << 18)
    rng = random.Random(seed)
    word = lambda: f"W{int(rng.paretovariate(0.7)) % 60}é"
    docs = [(i // 2 if rng.random() < 0.3 else i, " ".join(word() for _ in range(rng.choice([1, 3, 20, 60])))) for i in range(250)] + [(None, "W1É w2é"), (7, None), (8, ""), (9, "!?")]
    items = [(i % 12, ",".join(word() for _ in range(rng.choice([1, 2, 9, 25])))) for i in range(14)] + [(50, None), (51, "nowhere"), (None, "w1é")]
    got = lexical_search.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 5)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.rank(empty(spark), items).count() == 0
    assert lexical_search.rank(awkward(spark), items.limit(0)).count() == 0
    assert [r["doc_id"] for r in lexical_search.rank(awkward(spark, "score"), items).collect()] == [1, 2, 7, 7, None]


def test_search_reads_little_below_the_threshold(spark):
    """A word that all documents hold is cut by the threshold: it is read for candidates only."""
    docs = [(i, "the " * 20 + (f"rare{i % 40}" if i < 400 else "common")) for i in range(3000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = lexical_search.rank(rows, spark.createDataFrame([(1, "the rare3")], "item_id long, text string"), k=3)
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == [(1, 1, 3), (1, 2, 43), (1, 3, 83)]


def test_op12(spark):
    same(lexical_search.op12_lexical_search(spark, "/root/testdata/sf0.001"), "/root/testdata/sf0.001", ORACLES["op12_lexical_search"])


# --- Merkle manifest ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_proofs(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = {g: plain_levels([plain_leaf(r) for r in groups[g]]) for g in langs}
    top = plain_levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now, siblings = plain_leaf(r, 1 if changed else 0), []
            for tree, at in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    beside = at ^ 1
                    if beside < len(level):
                        siblings.append(level[beside])
                        now = h(level[beside], now) if at % 2 else h(now, level[beside])
                    else:
                        now = h(now)
                    at //= 2
            out.append((r["doc_id"], plain_leaf(r), trees[g][-1][0], top[-1][0], h(*siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


def proofs(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted((tuple(r) for r in merkle.prove(merkle.build(df, tampered)).collect()), key=str)


def test_manifest_of_awkward_rows(spark):
    rows = awkward(spark, "idx")
    assert proofs(rows) == plain_proofs([r.asDict() for r in rows.collect()])
    assert proofs(empty(spark)) == []
    one = rows.where("doc_id = 9")
    assert proofs(one) == plain_proofs([r.asDict() for r in one.collect()])


def test_manifest_with_many_groups_and_a_hot_one(spark, monkeypatch):
    """Sizes around powers of two and of a step, more groups than are broadcast, repeated ids."""
    monkeypatch.setattr(merkle, "GROUPS", 3)
    rows = [(i, f"text {i}", "hot", "s", i) for i in range(1100)]
    rows += [(i, f"text {i}", f"g{size}", None, None) for size in (1, 2, 3, 5, 255, 256, 257) for i in range(size)]
    rows += [(5, "text", "hot", "s", 1)] * 3 + [(None, "x", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert proofs(df) == plain_proofs([r.asDict() for r in df.collect()])


def test_op13(spark, tmp_path):
    got = sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()), key=str)
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got == plain_proofs(rows) and 0 < sum(not r[-1] for r in got) < len(got)
