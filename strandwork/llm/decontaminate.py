"""Benchmark decontamination by spaced seeds, in DataFrame expressions only.

A seed is the hash of the words under a fixed mask; the places that the mask
leaves out may differ. Seeds of the benchmark items meet the seeds at every
place of every document. A hit fixes the shift between item and document, and
the whole item is then compared along it, word by word: substituted words count
as misses and do not end the overlap. Where too little of the item lies on the
one shift, a long stretch of it is looked for, and the words that stand in order
near the shift are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import free_name, number_rows, text_of

# The places that each mask reads. Any substitution pattern that
# leaves four of five words alone leaves some window clean under one of them.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 4, 7))
SPAN = 1 + max(max(m) for m in MASKS)
#: Seeds (three numbers each) and items up to which the benchmark is broadcast.
BROADCAST_SEEDS, BROADCAST_WORDS = 1_000_000, 4_000_000
OVERLAP = 0.8
#: Words of a stretch that is evidence by itself, and how far words put in or left
#: out may move the rest of an item.
LONG, DRIFT = 13, 8


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(hashes: str) -> Column:
    """array<struct<at, seed>>: every mask at every place where its span fits."""
    places = F.when(F.size(hashes) >= SPAN, F.sequence(F.lit(0), F.size(hashes) - SPAN)).otherwise(F.array().cast("array<int>"))

    def under(number: int, mask: tuple[int, ...]) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(number), *[F.get(F.col(hashes), i + k) for k in mask]).alias("seed")))

    return F.concat(*[under(n, m) for n, m in enumerate(MASKS)])


def _best_span(same: Column) -> Column:
    """Matched words of the best stretch of at least LONG places with OVERLAP of
    them matched, the first and last among these, 0 where there is none. A match counts 1 and a miss -4, so a
    stretch of sum 0 and more has four fifths; each place ends the best one that
    is long enough (sums so far, the LONG last of them apart from the least earlier one)."""
    point = "named_struct('sum', 0L, 'hits', 0L)"
    start = F.expr(f"named_struct('recent', array({point}), 'low', cast(null as struct<sum:bigint,hits:bigint>), 'best', named_struct('sum', -1L, 'hits', 0L))")

    def step(a: Column, m: Column) -> Column:
        before = F.element_at(a["recent"], -1)
        now = F.struct((before["sum"] + F.when(m == 1, F.lit(1)).otherwise(F.lit(-4))).alias("sum"), (before["hits"] + m).alias("hits"))
        full = F.size(a["recent"]) == LONG
        first = F.element_at(a["recent"], 1)
        low = F.when(full & (F.get(a["recent"], F.lit(1))["hits"] > first["hits"]), F.least(a["low"], first)).otherwise(a["low"])
        span = F.when(low.isNotNull() & (m == 1), F.struct((now["sum"] - low["sum"]).alias("sum"), (now["hits"] - low["hits"]).alias("hits")))
        recent = F.concat(F.when(full, F.slice(a["recent"], 2, LONG - 1)).otherwise(a["recent"]), F.array(now))
        return F.struct(recent.alias("recent"), low.alias("low"), F.greatest(a["best"], span).alias("best"))

    return F.aggregate(same, start, step, lambda a: a["best"]["hits"])


def _in_order(shift: Column) -> Column:
    """Words of the item found in order in the document, where words put in or
    left out move the place by at most DRIFT from ``shift``. Entry d of the state
    is the most words matched when the last place was at shift + d - DRIFT: words
    put in raise d, a word left out lowers it by one."""
    width = 2 * DRIFT + 1
    start = F.array_repeat(F.lit(0), width)

    def step(a: Column, t: Column) -> Column:
        def entry(d: Column) -> Column:
            hit = F.coalesce(F.get("words", shift + t + d - DRIFT) == F.get("item_words", t), F.lit(False)).cast("int")
            return F.greatest(F.array_max(F.slice(a, 1, d + 1)) + hit, F.coalesce(F.get(a, d + 1), F.lit(0)))

        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), entry)

    return F.aggregate(F.sequence(F.lit(0), F.size("item_words") - 1), start, step, lambda a: F.array_max(a).cast("long"))


def _overlap(hits: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Compare item and document along each shift and around it; the best shift of
    a pair stays, and one that holds the whole item goes before the others."""
    along = F.transform(F.sequence(F.lit(0), F.size("item_words") - 1), lambda t: F.coalesce(F.get("words", F.col("shift") + t) == F.get("item_words", t), F.lit(False)).cast("int"))
    # explode() of one value: what stands in it is computed once.
    found = hits.select(*keys, "item_id", "shift", "words", "item_words", F.size("item_words").cast("long").alias("item_size"), F.explode(F.array(along)).alias("same"))
    matched = F.aggregate("same", F.lit(0).cast("long"), lambda a, m: a + m)
    found = found.withColumn("matched", F.explode(F.array(matched)))
    least = share * F.col("item_size")
    rest = F.struct(_best_span(F.col("same")).alias("span"), _in_order(F.col("shift")).alias("chain"))
    found = found.withColumn("rest", F.explode(F.array(F.when(F.col("matched") < least, rest))))
    whole, chain = F.col("matched") >= least, F.when(F.col("rest.chain") >= least, F.col("rest.chain")).otherwise(F.lit(0))
    found = found.select(*keys, "item_id", "item_size", "shift", whole.alias("whole"), F.when(whole, F.col("matched")).otherwise(F.greatest("rest.span", chain)).alias("matched"))
    best = found.filter("matched > 0").groupBy(*keys, "item_id", "item_size").agg(F.max(F.struct("whole", "matched", (-F.col("shift")).alias("s"))).alias("b"))
    return best.select(*keys, "item_id", F.col("b.matched").alias("matched"), "item_size", (-F.col("b.s")).cast("long").alias("shift"))


def benchmark_overlaps(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = OVERLAP) -> DataFrame:
    """(text_key, ident, item_id, matched, item_size, shift) of contaminated documents.

    A pair is reported when at least ``share`` of the item's words stand at their
    places in the document, or in order at places that words put in or left out
    have moved by DRIFT at most, or when four fifths of LONG or more consecutive
    places of the item match, from a match to a match. ``matched`` counts the words found by the first of
    these that holds, or the more of the last two. ``shift`` is the word of the document where the item
    would start (negative where its head is cut off). ``text_key`` is the hash of
    the document's text, by which rows can be dropped whatever their ids. Items
    of fewer words than a mask spans are no evidence and have no seeds; null
    texts have no words; items of equal words are reported each under its id,
    repeated rows once.
    """
    bench = items.select(F.col(item).alias("item_id"), text_of(item_text).alias("t")).distinct().withColumn("item_words", word_hashes(F.col("t"))).drop("t")
    ours = bench.filter(F.size("item_words") >= SPAN).withColumn("item", F.xxhash64("item_id", "item_words"))
    item_seeds = ours.select("item", F.inline(seeds("item_words"))).withColumnRenamed("at", "item_at").distinct()
    size = ours.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0))).first()[0]
    small = size <= BROADCAST_WORDS and size * len(MASKS) <= BROADCAST_SEEDS
    rows = docs.select(F.col(ident).alias("id"), text_of(text).alias("t"))
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    if small:
        # One pass over the documents: both sides of the benchmark are at hand in
        # every task, and only hits leave the scan.
        hashed = rows.select("id", F.xxhash64("t").alias("text_key"), word_hashes(F.col("t")).alias("words"))
        found = hashed.select("id", "text_key", "words", F.inline(seeds("words")))
        hits = found.join(F.broadcast(item_seeds), "seed").select("id", "text_key", "words", "item", shift)
        pairs = hits.join(F.broadcast(ours), "item")
    else:
        row = "_row"
        numbered = number_rows(rows, row, "id", "t")
        hashed = numbered.select(row, "id", F.xxhash64("t").alias("text_key"), word_hashes(F.col("t")).alias("words"))
        found = hashed.select(row, "words").select(row, F.inline(seeds("words")))
        hits = found.join(item_seeds, "seed").select(row, "item", shift).distinct()
        pairs = hits.join(hashed, row).join(ours, "item")
    return _overlap(pairs, ["text_key", "id"], share).withColumnRenamed("id", ident)


def drop_contaminated(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    key = free_name(docs, "_text_key")
    gone = benchmark_overlaps(docs, items, ident, text, **named).select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(text_of(text))).join(gone, key, "left_anti").drop(key)
