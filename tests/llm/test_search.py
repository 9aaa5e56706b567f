"""Lexical search against plain loops; shared sums against their item sets."""

import collections
import math
import random
import re

import pytest

from strandwork.llm import lexical_search
from strandwork.llm.lexical_search import block_plans, item_blocks, search, share

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, k):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        own = set(terms(text))
        rows = []
        for d, c in counts:
            score = 0
            for t in own & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * sum(c.values()) * n_docs // total)))
            if score > 0:
                rows.append((-score, d is not None, d or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(rows)[:k], 1)]
    return collections.Counter(out)


def tables():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É漢", "Apple", "x1"]
    common = rng.sample(words, 12)
    docs = [(i, rng.choice([" ", "-", "_\n"]).join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)]
    docs += [(200, None), (201, ""), (None, docs[0][1]), (202, docs[0][1]), (202, docs[0][1]), (203, "w1 " * 30_000), (204, "...")]
    items = [(i, " ".join(rng.sample(common, 6) + rng.sample(words, 5))) for i in range(25)]
    items += [(90, None), (91, "!!"), (None, "APPLE apple É漢"), (3, "w1 w2"), (92, "nowhere")]
    return docs, items


@pytest.mark.parametrize("sizes", [(50_000, 1_000_000, 1 << 22, 64), (20, 40, 500, 2)])
def test_search_equals_plain_loops(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_TERMS", "PASS_TERMS", "CELLS", "BUCKETS"), sizes):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = tables()
    one = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, ID string, rank int").repartition(5)
    two = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, block string")
    for k in (50, 3):
        got = collections.Counter((r.item_id, r.rank, r.doc_id, r.score) for r in search(one, two, k=k).collect())
        assert got == ranked(docs, items, k)


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    assert search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), items).count() == 0


def test_nodes_sum_to_their_items():
    rng = random.Random(1)
    for _ in range(60):
        items = [sorted(rng.sample(range(14), rng.randint(1, 9))) for _ in range(rng.randint(1, 12))]
        plan = share(items)
        sums = [collections.Counter(a) for a in plan.atoms]
        for a, b in zip(plan.left, plan.right):
            sums.append(sums[a] + sums[b])
        for own, nodes in zip(items, plan.items):
            assert sum((sums[n] for n in nodes), collections.Counter()) == collections.Counter(own)
        held = collections.Counter(n for nodes in plan.items for n in nodes) + collections.Counter(plan.left + plan.right)
        assert all(held[n] for n in range(len(sums)))  # no node is made for nothing
        assert plan.additions() <= sum(len(i) - 1 for i in items)
    same = share([[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 6], [7]])
    assert sorted(map(sorted, same.atoms))[0] == [1, 2, 3] and same.additions() == 5


def test_blocks_keep_every_item(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 15)
    items = tables()[1]
    blocks = item_blocks(spark.createDataFrame(items, "item_id long, text string"))
    assert blocks.count() == sum(bool(terms(t)) for _, t in items)
    assert block_plans(blocks).count() == blocks.select("block").distinct().count() > 5
