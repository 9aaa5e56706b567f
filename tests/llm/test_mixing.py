"""Source mixing against plain loops and numeric integrals."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strandwork.llm.source_mixing import cycled_weights, integrated, mix_documents, mixed_texts, progress_at, sized_rows, source_targets, taken_words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, _row string, SIZE int, copy string"


def documents():
    rng = random.Random(7)
    sources = ["a"] * 6 + ["b", "é", "\U0001f600", "c", None]
    rows = [(i, " \n".join(["w"] * rng.randint(0, 30)), rng.choice(sources)) for i in range(300)]
    rows += [(400, None, "a"), (401, "", "empty"), (402, "x " * 50_000, "long"), (403, "one\ttwo", "a"), (403, "one\ttwo", "a"), (None, "a b c", "b")]
    return [(*r, "x", 1, "z") for r in rows]


def filled(sizes, weights, most):
    """Targets by resharing, round after round."""
    total, out = sum(sizes), [0.0] * len(sizes)
    open_ = {i for i, w in enumerate(weights) if w > 0}
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        above = {i for i in open_ if share[i] > most * sizes[i]}
        for i in open_:
            out[i] = most * sizes[i] if i in above else share[i]
        if not above:
            break
        open_ -= above
    return out


def test_mix_equals_plain_loops(spark):
    rows = sized_rows(spark.createDataFrame(documents(), SCHEMA).repartition(4))
    schedule = cycled_weights(rows, (1, 2, 3), rise=(1.5, 1.0, 0.5))
    mix, targets = mix_documents(rows, schedule, most=3)
    got = sorted((r.id is None, r.id or 0, r.size, r.source_size, round(r.target, 6), r.taken) for r in taken_words(rows, mix, targets).collect())

    by_source = {}
    for d, text, source, *_ in documents():
        by_source.setdefault(source, []).append((d, len(WORDS.findall(text or ""))))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n in by_source[s]) for s in names]
    targets = filled(sizes, [1 + i % 3 for i in range(len(names))], 3)
    want = []
    for s, size, target in zip(names, sizes, targets):
        wanted, before = int(target + 0.5), 0
        laid = sorted(by_source[s], key=lambda r: hashlib.md5((f"{r[0]}|0" if r[0] is not None else "0").encode()).hexdigest())
        for d, n in laid:
            taken = sum(max(0, min(n, wanted - (c * size + before))) for c in range(3))
            want.append((d is None, d or 0, n, size, round(target, 6), taken))
            before += n
    assert got == sorted(want)
    assert sum(w[-1] for w in want) == pytest.approx(sum(sizes), abs=len(names))


def test_order_follows_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "early" if i % 2 else "late") for i in range(2000)], "doc_id long, text string, source string")
    rows = sized_rows(docs)
    schedule = spark.createDataFrame([("early", 0.0, 2.0), ("early", 1.0, 0.0), ("late", 0.0, 0.0), ("late", 1.0, 2.0)], "source string, at double, weight double")
    mix, _ = mix_documents(rows, schedule)
    order = [r.source for r in mix.orderBy("position").collect()]
    assert len(order) == 2000
    # By progress t the early source has delivered 2t - t^2 of its words.
    for t in (0.25, 0.5, 0.75):
        due = [r.source for r in mix.filter(F.col("progress") <= t).collect()]
        assert due.count("early") / 1000 == pytest.approx(2 * t - t * t, abs=0.01)
        assert due.count("late") / 1000 == pytest.approx(t * t, abs=0.01)
    again, _ = mix_documents(rows, schedule)
    assert mix.collect() == again.collect()


def test_inverse_of_the_area(spark):
    knots = [("s", 0.2, 1.0), ("s", 0.5, 3.0), ("s", 0.6, 0.0), ("s", 0.8, 0.0), ("s", 0.9, 2.0), ("n", 0.5, None), ("m", 0.3, -1.0)]
    curve = integrated(spark.createDataFrame(knots, "source string, at double, weight double"))
    got = {r.source: r for r in curve.collect()}
    assert got["s"].weight == pytest.approx(0.2 + 0.6 + 0.15 + 0.1 + 0.2)
    assert got["n"].weight == got["m"].weight == 0
    areas = curve.filter("source = 's'").select("parts", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2, 0.5, 0.81, 0.9, 0.97, 1.04, 1.25)])).alias("area"))
    for r in areas.select("area", progress_at(F.col("parts"), F.col("area")).alias("t")).collect():
        area, steps = 0.0, 20_000
        for i in range(int(r.t * steps)):
            x = (i + 0.5) / steps
            area += (1 if x < 0.2 else 1 + (x - 0.2) / 0.3 * 2 if x < 0.5 else (0.6 - x) * 30 if x < 0.6 else 0 if x < 0.8 else (x - 0.8) * 20 if x < 0.9 else 2) / steps
        assert area == pytest.approx(r.area, abs=2e-3)


def test_targets_with_caps(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 5, 100, 1000]) for _ in range(9)]
        weights = [rng.choice([0.0, 1.0, 2.0, 50.0]) for _ in range(9)]
        one = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        two = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(weights)], "source string, weight double")
        got = {r.source: r.target for r in source_targets(one, two, 3).collect()}
        assert [got[f"s{i}"] for i in range(9)] == pytest.approx(filled(sizes, weights, 3))


def test_texts_of_the_mix(spark):
    docs = spark.createDataFrame([(1, "a b  c", "s", "x"), (1, "a b  c", "s", "y"), (2, "d", "s", "z"), (None, None, None, None)], "doc_id long, text string, source string, _digest string")
    rows = sized_rows(docs)
    mix, _ = mix_documents(rows, spark.createDataFrame([("s", 0.0, 1.0)], "source string, at double, weight double"))
    texts = mixed_texts(docs, mix).collect()
    assert sorted(r.text for r in texts) == ["a b  c", "a b  c", "d"]
    assert [r.position for r in texts] == sorted(r.position for r in texts)
    half = mix.withColumn("words", F.lit(2).cast("long")).filter("id = 1").limit(1)
    assert [r.text for r in mixed_texts(docs, half).collect()] == ["a b"]


def test_mix_of_an_empty_table(spark):
    rows = sized_rows(spark.createDataFrame([], "doc_id long, text string, source string"))
    mix, targets = mix_documents(rows, cycled_weights(rows, (1, 2, 3), (1.0, 1.0, 1.0)))
    assert taken_words(rows, mix, targets).count() == 0
