"""Dedup operators against brute force, with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strandwork.llm import jaccard_join, suffix_dedup
from strandwork.llm.exact_dedup import drop_exact_copies, exact_groups
from strandwork.llm.jaccard_join import Rule, boundary, drop_near_duplicates, jaccard_pairs, least_difference, near_duplicates, odd_sketch
from strandwork.llm.rows import number_rows
from strandwork.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(seed, letters, joiner, count=60):
    """Texts that share passages of a few bases."""
    rng = random.Random(seed)
    base = [[rng.choice(letters) for _ in range(60)] for _ in range(4)]
    docs = []
    for i in range(count):
        t = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, 40)
            t += rng.choice(base)[a : a + rng.randint(5, 60)]
        docs.append((i, joiner.join(t)))
    return docs + [(900, None), (901, ""), (902, docs[3][1]), (903, docs[3][1]), (904, joiner.join(["a"] * 90))]


def words_removed(docs, width):
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = WORDS.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("width", [20, 7])
def test_substring_dedup(spark, width):
    docs = mixed(1, ["a", "bé", "c", "D"], " \n")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(spark.createDataFrame(docs, SCHEMA), width).collect()}
    assert got == words_removed(docs, width)


def test_substring_dedup_ties_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long, "x"), (1, long, "x"), (None, long, "y"), (2, "short text", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ROW string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(False, 1, 30, 30), (False, 1, 30, 30), (False, 2, 2, 0), (True, 0, 30, 0)]  # the null id comes first
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def bytes_removed(docs, width):
    data = {i: (t or "").encode() for i, t in docs}
    count = collections.Counter(b[p : p + width] for b in data.values() for p in range(len(b) - width + 1))
    out = {}
    for i, b in data.items():
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if count[b[p : p + width]] > 1:
                gone[p : p + width] = [True] * width
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("width,suffixes", [(60, 4096), (60, 3), (33, 2)])
def test_suffix_dedup(spark, width, suffixes):
    docs = mixed(2, ["a", "bé", "c", "D"], "")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_byte_repeats(spark.createDataFrame(docs, SCHEMA), width, group_suffixes=suffixes).collect()}
    assert got == bytes_removed(docs, width)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_byte_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_interval_tree():
    nodes, parent, inner = suffix_dedup.interval_tree(suffix_dedup.common_prefixes([b"aa", b"aab", b"ab", b"b", b"bc"]))
    assert set(nodes) == {(0, 1, 2), (0, 2, 1), (3, 4, 1)}
    assert [nodes[i] for i in inner] == [(0, 1, 2), (0, 1, 2), (0, 2, 1), (3, 4, 1), (3, 4, 1)]
    assert nodes[parent[inner[0]]] == (0, 2, 1) and parent[inner[3]] == -1


def test_exact_groups(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (5, "a "), (6, "b" * 100 + "x"), (7, "b" * 100 + "y")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, KEPT long")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.copies, r.keep_id, r.kept) for r in exact_groups(df).collect()))
    assert got == [(False, 1, 4, 2, False), (False, 2, 4, 2, False), (False, 2, 4, 2, True), (False, 3, 2, 4, False), (False, 4, 2, 4, True), (False, 5, 1, 5, True), (False, 6, 1, 6, True), (False, 7, 1, 7, True), (True, 0, 4, 2, False)]
    kept = drop_exact_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7] and kept.columns == df.columns
    assert drop_exact_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def near_components(docs, rule):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, links = {}, set()
    for i, t in docs:
        w = WORDS.findall((t or "").translate(lower))
        k = rule.words
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    comp = {i: i for i in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and rule.den * shared >= rule.num * len(sets[a] | sets[b]):
                links.add((a, b))
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}, links


def near_docs(seed):
    rng, docs = random.Random(seed), []
    for _ in range(25):
        base = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"W{rng.randint(0, 40)}"
            docs.append((len(docs), " ".join(w)))
    return docs + [(900, None), (901, " "), (902, "A b"), (903, "a B")]


@pytest.mark.parametrize("rule", [Rule(4, 85, 100), Rule(1, 7, 10)])
def test_near_duplicates(spark, rule):
    docs = near_docs(3)
    df = spark.createDataFrame(docs, SCHEMA)
    want, _ = near_components(docs, rule)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, rule).collect()} == want
    assert sorted(r.doc_id for r in drop_near_duplicates(df, rule).collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_all_links_between_classes(spark):
    rule, docs = Rule(2, 8, 10), near_docs(4)
    numbered = number_rows(spark.createDataFrame(docs, SCHEMA))
    member, links = jaccard_pairs(numbered, rule)
    ids = {r._row: r.doc_id for r in numbered.collect()}
    rep = {ids[r._row]: ids[r.rep] for r in member.collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in links.collect()}
    _, want = near_components(docs, rule)
    assert got == {tuple(sorted((rep[a], rep[b]))) for a, b in want if rep[a] != rep[b]}


def test_jaccard_ties_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 7, 7), (False, 7, 7), (False, 8, 8), (True, 0, 7)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_never_rules_out_a_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.8], rng.integers(0, 1 << 62, rng.integers(1, 200)).astype(np.uint64)]))
        assert least_difference(odd_sketch(x), odd_sketch(y)) <= len(np.setxor1d(x, y))
    assert boundary({}, Rule()) == 0 and 0 < boundary({n: 1000 for n in range(1, 33)}, Rule(4, 85, 100)) < 32


def test_hot_group_has_no_pair_blow_up(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:50] + [f"u{i}"] + base[50:])) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = near_duplicates(df, Rule(1, 9, 10)).agg(F.count_distinct("component_id"), F.count("*")).first()
    assert tuple(got) == (1, 300)


def test_candidates_grow_with_the_rows(spark, monkeypatch):
    """Texts that share a long passage and do not link: twice the texts, about twice the pairs."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(80))
    met = []
    real = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, sets, rule: met.append(pairs.count()) or real(pairs, sets, rule))
    counts = []
    for n in (150, 300):
        met.clear()
        texts = [(i, passage + " " + " ".join(f"u{i}_{j}" for j in range(rng.randint(8, 13)))) for i in range(n)]
        got = near_duplicates(spark.createDataFrame(texts, SCHEMA), Rule(4, 85, 100))
        assert got.filter("component_id <> doc_id").count() == 0
        counts.append(sum(met))
    assert counts[1] <= 2.5 * counts[0] + 50
