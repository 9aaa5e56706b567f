"""Mixing sources to target weights along a time-varying curriculum.

A schedule gives every source a weight that changes with training progress, from 0
to 1, linear between its knots. The area under it is the source's weight in the
whole mix; what the source has delivered by some progress follows the area up to
there. A source lays its documents end to end in a hashed order, as often as
its target asks for, and the place of a copy in this row, as a share of the target,
is inverted along the area: the progress at which the copy is due. Sorted by it,
copies of all sources interleave as the schedules ask.

Only thin rows (id, source, digest, number of words) are moved; running totals are
taken in shards of the hashed order, so one source may hold most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ordered_scan
from ..session import cut_lineage
from .rows import number_rows

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that are broadcast at most; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Hexadecimal digits of the hashed order that make a shard.
SHARD_DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def integrated(schedule: DataFrame) -> DataFrame:
    """(source, parts, weight) of a schedule (source, at, weight).

    ``parts`` are the linear stretches with the area before each; ``weight`` is the
    whole area. The first weight holds before its knot and the last one behind
    it; knots at one place follow their weight. Null and negative weights are 0. A source's knots are a given list, one row
    of the result.
    """
    knot = F.struct(F.col("at").cast("double").alias("at"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"))
    knots = schedule.groupBy("source").agg(F.array_sort(F.collect_list(knot)).alias("k"))
    end = lambda at, i: F.struct(F.lit(at).alias("at"), F.element_at("k", i)["w"].alias("w"))
    knots = knots.withColumn("k", F.concat(F.array(end(0.0, 1)), "k", F.array(end(1.0, -1))))
    pairs = F.transform(F.sequence(F.lit(1), F.size("k") - 1), lambda i: F.struct(F.element_at("k", i).alias("a"), F.element_at("k", i + 1).alias("b")))
    pairs = F.filter(pairs, lambda p: p["b"]["at"] > p["a"]["at"])
    start = F.struct(F.lit(0.0).alias("area"), F.array().cast("array<struct<from:double,upto:double,w0:double,w1:double,before:double>>").alias("parts"))

    def step(acc, p):
        part = F.struct(p["a"]["at"].alias("from"), p["b"]["at"].alias("upto"), p["a"]["w"].alias("w0"), p["b"]["w"].alias("w1"), acc["area"].alias("before"))
        area = acc["area"] + (p["b"]["at"] - p["a"]["at"]) * (p["a"]["w"] + p["b"]["w"]) / 2
        return F.struct(area.alias("area"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    return knots.withColumn("all", F.aggregate(pairs, start, step)).select("source", F.col("all.parts").alias("parts"), F.col("all.area").alias("weight"))


def progress_at(parts: Column, area: Column) -> Column:
    """Progress at which ``area`` has been reached: the stretch by its start, then the
    root of its quadratic in the form that does not cancel."""
    part = F.element_at(F.filter(parts, lambda p: (p["before"] <= area) & (p["w0"] + p["w1"] > 0)), -1)
    rest = area - part["before"]
    slope = (part["w1"] - part["w0"]) / (part["upto"] - part["from"])
    root = F.sqrt(F.greatest(part["w0"] * part["w0"] + 2 * slope * rest, F.lit(0.0)))
    step = F.when(rest <= 0, 0.0).otherwise(2 * rest / (part["w0"] + root))
    return F.least(part["upto"], part["from"] + step)


def source_targets(sizes: DataFrame, weights: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, target): all words shared by weight, no more than ``most``
    times what a source has.

    ``sizes`` is (source, source_size), ``weights`` (source, weight). What capped
    sources leave is shared again by weight until none is above, which ends where a
    source gets the less of its cap and ``level * weight``. With the sources in the
    order of cap over weight, the level is the largest of (words left) over
    (weights left) before each. A source without weight gets nothing.
    """
    w = weights.select(F.col("source").alias("_s"), "weight")
    rows = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rows = rows.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "cap": (most * F.col("source_size")).cast("double")})
    rows = cut_lineage(rows)
    part = rows.filter("weight > 0").withColumn("ratio", F.col("cap") / F.col("weight"))
    scanned = cut_lineage(ordered_scan(part, ["ratio", "source"], {"caps": F.col("cap"), "upto": F.col("weight")}))
    words, weights = rows.agg(F.sum("source_size")).scalar(), part.agg(F.sum("weight")).scalar()
    left = (F.col("words") - (F.col("caps") - F.col("cap"))) / (F.col("weights") - (F.col("upto") - F.col("weight")))
    level = scanned.withColumns({"words": words, "weights": weights}).agg(F.max(left)).scalar()
    shared = rows.withColumn("level", level)
    target = F.when(F.col("weight") > 0, F.least("cap", F.col("level") * F.col("weight"))).otherwise(0.0)
    return shared.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def sized_rows(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """A written table (_row, id, source, digest, size) of all documents, without texts."""
    digest = F.hex(F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    thin = docs.select(F.col(ident).alias("id"), F.col(source).alias("source"), digest.alias("digest"), word_count(text).alias("size"))
    return number_rows(thin, "_row", "id", "digest")


def mix_documents(rows: DataFrame, schedule: DataFrame, most: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mix, targets) for a table of ``sized_rows`` and a schedule (source, at, weight).

    ``mix`` has a row for every copy that is taken, in training order: (_row, id,
    digest, source, copy, words, progress, position); ``position`` is the progress
    in words of the whole mix. Whole passes over a source come first, then documents
    of the hashed order as far as the target reaches; the last one is taken in
    part, so that each source gives its target to the word. A document is never
    taken more often than ``most`` times. The hash of id and seed alone decides, so
    reruns agree; repeated rows count as rows of their own. Null sources are one
    source; documents without words are in no copy; a source that the schedule does not
    name is not taken; an empty table gives empty tables.
    """
    curve = cut_lineage(integrated(schedule))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, curve, most))
    per = targets.join(curve.select(F.col("source").alias("_s"), "parts", "weight"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    per = cut_lineage(per.filter("target > 0").withColumn("wanted", F.floor(F.col("target") + 0.5)).withColumnRenamed("source", "_s"))
    near = F.broadcast(per) if per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else per
    whole = targets.agg(F.sum("target")).scalar()
    keyed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")))
    laid = ordered_scan(keyed.filter("size > 0"), ["_h", "_row"], {"upto": F.col("size")}, ["source"], F.substring("_h", 1, SHARD_DIGITS))
    copies = laid.join(near, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    start = F.col("copy") * F.col("source_size") + F.col("upto") - F.col("size")
    copies = copies.withColumn("_start", start).filter("_start < wanted")
    copies = copies.withColumn("words", F.least("size", F.col("wanted") - F.col("_start")))
    middle = (F.col("_start") + F.col("words") / 2) / F.col("wanted") * F.col("weight")
    copies = copies.withColumn("progress", progress_at(F.col("parts"), middle)).withColumn("whole", whole)
    mix = copies.select("_row", "id", "digest", "source", "copy", "words", "progress", (F.col("progress") * F.col("whole")).alias("position"))
    order = ["position", "_row", "copy"]
    return cut_lineage(mix.repartitionByRange(*order).sortWithinPartitions(*order)), targets


def mixed_texts(docs: DataFrame, mix: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(position, id, copy, text) in training order; a copy that is taken in part has its
    first words, joined by one space."""
    digest = F.hex(F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    texts = docs.select(F.col(ident).alias("_id"), digest.alias("_digest"), F.col(text).alias("text")).dropDuplicates(["_id", "_digest"])
    rows = mix.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.when(word_count() > F.col("words"), F.array_join(F.slice(words, 1, F.col("words").cast("int")), " ")).otherwise(F.col("text"))
    return rows.select("position", "id", "copy", part.alias("text")).repartitionByRange("position", "id", "copy").sortWithinPartitions("position", "id", "copy")


def taken_words(rows: DataFrame, mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: what its source should give and
    how many of its words the mix takes, repeats counted."""
    taken = mix.groupBy("_row").agg(F.sum("words").alias("taken"))
    near = targets.withColumnRenamed("source", "_s")
    near = F.broadcast(near) if near.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else near
    out = rows.join(taken, "_row", "left").join(near, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def cycled_weights(rows: DataFrame, cycle: tuple[float, ...], rise: tuple[float, ...]) -> DataFrame:
    """A schedule (source, at, weight): sources in the order of code points, null last, weigh
    the values of ``cycle`` in turn; each starts at its ``rise`` times the weight and ends as
    far on the other side of it, so that the area is the weight."""
    sources = rows.select("source").distinct().withColumn("_null", F.col("source").isNull())
    ranked = ordered_scan(sources, ["_null", "source"], {"rn": F.lit(1).cast("long")})
    place = ((F.col("rn") - 1) % len(cycle) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), place)
    ends = F.array(F.struct(F.lit(0.0).alias("at"), (pick(cycle) * pick(rise)).alias("weight")), F.struct(F.lit(1.0).alias("at"), (pick(cycle) * (2 - pick(rise))).alias("weight")))
    return ranked.select("source", F.inline(ends))
