"""Exact dedup, n-gram join, components and Bloom filters against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import bloom, components, exact_dedup, ngram_join
from tests.llm.helpers import WORD, awkward, empty


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_classes(spark):
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.classes(awkward(spark, "members")).collect()]
    docs = awkward(spark).collect()
    groups = {}
    for d in docs:
        groups.setdefault(normal(d.text), []).append(d.doc_id)
    want = []
    for text, ids in groups.items():
        least = min(i for i in ids if i is not None)
        want += [(i, least, len(ids), i == least, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert exact_dedup.classes(empty(spark)).count() == 0


@pytest.mark.parametrize("extra", ["members", "keep_id", "__keep"])
def test_deduplicate_keeps_the_smallest(spark, extra):
    docs = awkward(spark, extra)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 8, 9]
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en", "a", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, awkward(spark).schema)
    out = exact_dedup.classes(df)
    assert out.where("keep_id = 0").count() == 1000
    assert out.where("kept").count() == 2001


def test_op5_sql(spark, tmp_path):
    from millrace.llm.queries import ORACLES
    from tests.compare import same

    awkward(spark).toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    same(exact_dedup.op5_exact_dedup(spark, str(tmp_path)), str(tmp_path), ORACLES["op5_exact_dedup"])


def test_bloom_misses_no_repeated_key(spark):
    rng = random.Random(1)
    keys = [rng.getrandbits(63) for _ in range(3000)]
    repeated = keys[:300]
    df = spark.createDataFrame([(k,) for k in keys + repeated], "key long").repartition(5)
    filt = bloom.repeated_filter(df, 3300)
    assert filt.maybe(np.array(repeated)).all()
    assert filt.maybe(np.array(keys[300:])).mean() < 0.1
    tiny = bloom.Filter(1 << bloom.BLOCK_BITS, np.full((1 << bloom.BLOCK_BITS) >> 3, 255, np.uint8))
    assert tiny.maybe(np.array(keys)).all()


def roots(edges, vertices):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [tuple(rng.sample(range(200, 300), 2)) for _ in range(60)]
    rng.shuffle(edges)
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots(edges, {x for e in edges for x in e})
    assert got == {u: v for u, v in want.items() if u != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_classes(rows, percent, n):
    sets = []
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    named = [(i, s) for i, s in sets if i is not None]
    edges = [(i, j) for a, (i, s) in enumerate(named) for j, t in named[a + 1 :] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    least = roots(edges, {i for i, _ in named})
    return sorted(((i, len(s), least.get(i) if s or i is None else i) for i, s in sets), key=str)


def variants(rng, groups, copies, size):
    """Groups of texts with a few words changed, cut or added, some chained from copy to copy."""
    out, next_id = [], 0
    for g in range(groups):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice(size))]
        for _ in range(rng.randrange(1, copies)):
            text = list(words)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [text[k], text[k]]])
                text = text or ["z"]
            if rng.random() < 0.4:
                words = text
            out.append((next_id, " ".join(text).upper() if rng.random() < 0.2 else " ".join(text)))
            next_id += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("percent", "n", "size", "seed"), [(90, 3, [12, 14, 20, 25], 1), (90, 3, [40, 80, 150], 2), (80, 5, [9, 12, 18, 40, 90], 3), (80, 3, [4, 6, 30, 33, 200], 4)])
def test_join_agrees_with_brute_force(spark, percent, n, size, seed):
    rows = variants(random.Random(seed), 40, 9, size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in ngram_join.classes(df, percent=percent, n=n).collect()), key=str)
    assert got == brute_classes(rows, percent, n)


def test_far_lists_take_several_rounds(spark, monkeypatch):
    """Many unrelated texts with one long passage in common."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 3, 4, 30])))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.classes(df).collect()), key=str)
    assert got == brute_classes(rows, 90, 3)


def test_join_of_awkward_rows(spark):
    docs = awkward(spark, "members")
    got = sorted((tuple(r) for r in ngram_join.classes(docs).collect()), key=str)
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1, 8: 8, 9: 9, None: None}
    assert [(r[0], r[2]) for r in got] == sorted(((d.doc_id, want[d.doc_id]) for d in docs.collect()), key=str)
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6, 8, 9]
    assert ngram_join.classes(empty(spark)).count() == 0
    assert ngram_join.deduplicate(empty(spark)).count() == 0


def test_rule():
    rule = ngram_join.Rule(90)
    for a in range(1, 60):
        for b in range(1, 60):
            linked = [c for c in range(min(a, b) + 1) if 100 * c >= 90 * (a + b - c)]
            if linked:
                assert linked[0] == rule.overlap(a, b) and b in rule.partners(a)
                assert a - linked[0] < rule.prefix(a)
            else:
                assert rule.overlap(a, b) > min(a, b)
    assert rule.boundary({}, 0) == 0
    assert rule.boundary({12: 1000}, 0) >= 12
    assert len(rule.keys(np.arange(12, dtype=np.uint64))) == rule.subsets(12)


def test_a_light_boundary_is_used(spark):
    """Texts of few words go by subsets; both ways agree."""
    rows = [(i, " ".join(f"w{k}" for k in range(14) if k != i % 14) + f" t{i // 14}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = ngram_join._sets(df, ngram_join.Rule(90), 3).collect()
    assert any(r.subsets for r in sets)
    assert sorted((tuple(r) for r in ngram_join.classes(df, percent=90).collect()), key=str) == brute_classes(rows, 90, 3)


def test_templated_texts_end_in_few_rounds(spark, monkeypatch):
    """Texts of eight out of twelve sentences in random order: lists are long and few pairs link."""
    rng = random.Random(4)
    sentences = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(10)) for _ in range(12)]
    docs = [(i, " ".join(rng.sample(sentences, 8))) for i in range(500)] + [(1000 + i, " ".join(sentences[:8])) for i in range(3)]
    rounds, stars = [], ngram_join._stars
    monkeypatch.setattr(ngram_join, "_stars", lambda *a: rounds.append(a) or stars(*a))
    got = {r.doc_id: r.component_id for r in ngram_join.classes(spark.createDataFrame(docs, "doc_id long, text string"), percent=60, n=5).collect()}
    sets = {i: set(ngram_join.shingles(t, 5).tolist()) for i, t in docs}
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 60 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    assert got == {i: root(i) for i in ids} and len(set(got.values())) < len(ids) - 3
    assert 3 <= len(rounds) <= 8
