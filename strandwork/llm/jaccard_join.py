"""N-gram Jaccard join: a size-aware heavy-light set similarity join.

Two sets of sizes n and m reach the threshold only if they share at least
``overlap(n, m)`` shingles. Light sets, of few shingles, list all their subsets
of that size; two of them meet where one subset is the same. Heavy sets are
found by scanning inverted lists. The boundary is the size at which listing
subsets costs more rows than the lists, for the sizes at hand.

A list of a common passage would hold a third of all documents, so lists are kept
for the rarest shingles only. Counting all shingles of all documents would be as
wrong a price: first the shingles of least hash, a share of each set that is
larger than what similar sets may differ in, tell which sets have enough in
common with others at all; shingles are counted among those sets alone.

Texts with equal sets are one class. Classes that lists connect are compared by
their differences from what most of them hold, which are short, so a group of many
near copies never is expanded into all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table, free_shuffles
from .components import components
from .rows import free_name, number_rows, text_of
from .words import as_long, mix, text_slices, window_sums, word_hashes

_FACTOR = 0xD1342543DE82EF95
_SALT, _SUM, _PART = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
#: Sizes up to which subsets are considered at all; the boundary lies below.
MOST_LIGHT = 32
#: Cost of a list entry against a subset: it also meets false candidates.
SCAN_COST = 4
#: Row numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Link when ``den * intersection >= num * union`` of the sets of ``words``-word shingles."""

    words: int = 5
    num: int = 8
    den: int = 10

    def overlap(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def least(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def most(self, n: int) -> int:
        return self.den * n // self.num

    def subset_sizes(self, n: int, light: int) -> list[int]:
        """Overlaps that a set of n must share with light partners."""
        return sorted({self.overlap(n, m) for m in range(max(1, self.least(n)), min(self.most(n), light) + 1)} - {0})

    def prefix(self, n: int) -> tuple[int, int]:
        """(shingles of least hash to look at, how many of them must be in other sets).

        A set may differ from a similar one in n - least(n) shingles; whatever is
        looked at beyond that has to be shared.
        """
        need = max(1, n // 10)
        return n - self.least(n) + need, need


def shingle_sets(data: np.ndarray, offsets: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a shorter text is one shingle."""
    hashes, starts = word_hashes(data, offsets, lower=True)
    sums = mix(window_sums(hashes, rule.words, _FACTOR) + np.uint64(rule.words)) if len(hashes) >= rule.words else hashes[:0]
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= rule.words:
            out.append(np.unique(sums[a : b - rule.words + 1]))
        elif b > a:
            out.append(mix(window_sums(hashes[a:b], b - a, _FACTOR) + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def _set_digests(docs: DataFrame, rule: Rule) -> DataFrame:
    """(_row, n, s1, s2): size of every set and two sums over it, equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(data, offsets, rule)
                one = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                two = np.array([mix(s ^ _SALT).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(as_long(one)), pa.array(as_long(two))], ["_row", "n", "s1", "s2"])

    return docs.select("_row", "text").mapInArrow(run, "_row long, n long, s1 long, s2 long")


def boundary(sizes: dict[int, int], rule: Rule) -> int:
    """The largest light size for the least number of rows; ``sizes`` counts sets up to MOST_LIGHT."""

    def cost(light: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= light:
                total += count * sum(comb(n, c) for c in rule.subset_sizes(n, light))
            if rule.most(n) > light:
                total += count * SCAN_COST * rule.prefix(n)[0]
        return total

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def _subset_keys(values: np.ndarray, rule: Rule, light: int) -> list[int]:
    """Keys of the subsets of one light set: the sum over the set less that over what is left out."""
    full, n, out = int(mix(values ^ _SUM).sum(dtype=np.uint64)), len(values), []
    each = [int(x) for x in mix(values ^ _SUM)]
    for size in rule.subset_sizes(n, light):
        if size <= n:
            out += [(full - sum(left)) * int(_SUM) + size * int(_PART) & (1 << 64) - 1 for left in combinations(each, n - size)]
    return out


def _keys(docs: DataFrame, rule: Rule, light: int) -> DataFrame:
    """(key, _row, need): subsets of light sets (need 0), shingles of least hash of heavy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row").to_pylist()
            for a, _, data, offsets in text_slices(batch.column("text")):
                keys, who, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for i, values in enumerate(shingle_sets(data, offsets, rule)):
                    n = len(values)
                    found = _subset_keys(values, rule, light) if 0 < n <= light else []
                    if found:
                        keys.append(np.array(found, np.uint64))
                        who.append(np.full(len(found), rows[a + i]))
                        needs.append(np.zeros(len(found), np.int32))
                    if n and rule.most(n) > light:
                        size, need = rule.prefix(n)
                        keys.append(values[:size])  # values are sorted hashes
                        who.append(np.full(len(keys[-1]), rows[a + i]))
                        needs.append(np.full(len(keys[-1]), need, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(keys))), pa.array(np.concatenate(who)), pa.array(np.concatenate(needs))], ["key", "_row", "need"])

    return docs.mapInArrow(run, "key long, _row long, need int")


def odd_sketch(values: np.ndarray) -> bytes:
    """Parities of the number of shingles per bucket, about one bucket a shingle.

    Two sets differ in at least as many shingles as their sketches do in bits.
    """
    bits = max(64, 1 << (len(values) - 1).bit_length())
    buckets = (values % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(buckets, minlength=bits) & 1).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """The bits in which two sketches differ; the longer one is folded to the shorter."""
    one, two = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(one) > len(two):
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    while len(two) > len(one):
        two = two[: len(two) // 2] ^ two[len(two) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


def _candidate_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(_row, n, sketch, set): the sorted shingle hashes as bytes, and their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                found = shingle_sets(data, offsets, rule)
                yield pa.RecordBatch.from_arrays([
                    batch.column("_row").slice(a, b - a), pa.array([len(s) for s in found], pa.int64()),
                    pa.array([odd_sketch(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary()),
                ], ["_row", "n", "sketch", "set"])

    return docs.select("_row", "text").mapInArrow(run, "_row long, n long, sketch binary, set binary")


def _sided(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both sides. The hub's side comes last: it is
    read once for all of its partners."""
    for side in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("_row").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in ("a", "b")])


def _possible(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out; no linked pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            far = (least_difference(x, y) for x, y in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()))
            keep = pa.array([d <= i + j - 2 * rule.overlap(i, j) for i, j, d in zip(n, m, far)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    sided = _sided(pairs, sets, ["n", "sketch"])
    near = F.least("n_a", "n_b") * rule.den >= F.greatest("n_a", "n_b") * rule.num
    return sided.filter(near).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, shared, n, m) of the pairs that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in ("set_a", "set_b"))
                n, m = len(x), len(y)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if rule.den * shared >= rule.num * (n + m - shared):
                    out.append((batch.column("a")[i].as_py(), batch.column("b")[i].as_py(), shared, n, m))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "shared", "n", "m"])

    possible = cut_lineage(_possible(pairs, sets, rule))
    return _sided(possible, sets, ["set"]).mapInArrow(run, "a long, b long, shared long, n long, m long")


def _compared(left: DataFrame, sets: DataFrame, rule: Rule, every: bool = False) -> DataFrame:
    """Links (a, b) between the rows of ``left`` (key, _row, place, slack, comp) that share a
    list and, but with ``every``, lie in two components.

    Each pair meets once, at the first key that both look at, and only where slack is
    left there; so one of the two has slack of its own.
    """
    earlier = F.collect_list("key").over(Window.partitionBy("_row").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1))
    left = cut_lineage(left.withColumn("earlier", earlier))  # one set's own keys, as many as it looks at
    one = left.filter("slack >= 0").select("key", *[F.col(c).alias(f"{c}_a") for c in ("_row", "comp", "slack", "earlier")])
    two = left.select("key", *[F.col(c).alias(f"{c}_b") for c in ("_row", "comp", "slack", "earlier")])
    once = F.expr("slack_a + slack_b >= 0 and (slack_b < 0 or _row_a < _row_b) and not arrays_overlap(earlier_a, earlier_b)")
    apart = F.col("_row_a") != F.col("_row_b") if every else F.col("comp_a") != F.col("comp_b")
    rest = one.join(two, (one["key"] == two["key"]) & apart & once)
    rest = rest.select(F.least("_row_a", "_row_b").alias("a"), F.greatest("_row_a", "_row_b").alias("b")).distinct()
    found = cut_lineage(_verified(rest, sets, rule).select("a", "b"))
    drop_table(left)
    return found


def _links(lists: DataFrame, sets: DataFrame, rule: Rule) -> list[DataFrame]:
    """Links (a, b) between classes, enough to join all that are linked.

    Sets that lists connect are one group. Inside it every set is written as its
    difference from what most of the group hold. The difference of two sets is that of
    their differences, so two that add up to no more than a link allows are linked
    without a look, and the set with the most room to spare joins all of those. Any
    other two that link share an element of their differences, which are short and
    of rare elements where the sets are alike: these are the lists that are compared.
    """
    rows = _differences(lists, sets)
    spare = F.col("n") * (rule.den - rule.num) - F.col("size") * (rule.num + rule.den)
    rows = cut_lineage(rows.withColumn("spare", spare))
    first = rows.groupBy("g").agg(F.max_by(F.struct("_row", "spare"), F.struct("spare", -F.col("_row"))).alias("core"))
    sure = cut_lineage(rows.join(_near_at_hand(first), "g").filter("_row <> core._row and spare + core.spare >= 0").select(F.col("core._row").alias("a"), F.col("_row").alias("b")))
    reach = F.floor(F.col("n") * (rule.den - rule.num) / rule.num)
    short = cut_lineage(_rarest(rows.select("_row", "n", "g", "set"), rule, reach))
    rest = _compared(_open_lists(short, sure), sets, rule)
    drop_table(rows, short)
    return [sure, rest]


def _cells(sets: DataFrame) -> DataFrame:
    """(key, _row, n, g): one row per element; elements of two groups ``g`` are different keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values, group = np.frombuffer(batch.column("set")[i].as_buffer(), np.uint64), batch.column("g")[i].as_py()
                if group:
                    values = mix(values ^ mix(np.array([group], np.int64).view(np.uint64)))
                rest = (np.full(len(values), batch.column(c)[i].as_py(), np.int64) for c in ("_row", "n", "g"))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(values)), *map(pa.array, rest)], ["key", "_row", "n", "g"])

    return sets.select("_row", "n", "g", "set").mapInArrow(run, "key long, _row long, n long, g long")


def _differences(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(_row, n, g, size, set): the group of every set in a list, and its elements that most of
    the group do not hold with those of the most that it does not hold."""
    hub = lists.groupBy("key").agg(F.min("_row").alias("b"), F.max("_row").alias("top"), F.max("slack").alias("most")).filter("b <> top and most >= 0").select("key", "b")
    group = components(lists.join(hub, "key").select(F.col("_row").alias("a"), "b").filter("a <> b").distinct())
    # Group numbers are rows plus one: 0 stands for no group.
    mine = cut_lineage(sets.join(group.select(F.col("node").alias("_row"), (F.col("comp") + 1).alias("g")), "_row"))
    whole = mine.groupBy("g").agg(F.count("*").alias("members"))
    held = mine.select("_row", "n", F.lit(0).cast("long").alias("g"), "set")
    held = _cells(held).select("key", "_row").join(mine.select("_row", "g"), "_row").groupBy("g", "key").agg(F.count("*").alias("c"))
    # No more than twice the mean size of a group's sets; one row per group.
    most = cut_lineage(held.join(_near_at_hand(whole), "g").filter("2 * c > members").groupBy("g").agg(F.collect_list("key").alias("most")))
    cells = most.agg(F.sum(F.size("most"))).first()[0] or 0
    joined = mine.join(F.broadcast(most) if cells <= BROADCAST_ROWS else most, "g", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                values, most = np.frombuffer(batch.column("set")[i].as_buffer(), np.uint64), batch.column("most")[i].values
                most = np.zeros(0, np.uint64) if most is None else most.to_numpy(zero_copy_only=False).view(np.uint64)
                out.append(np.setxor1d(values, most, assume_unique=True))
            sizes = pa.array([len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "n", "g")), sizes, pa.array([x.tobytes() for x in out], pa.binary())], ["_row", "n", "g", "size", "set"])

    return joined.select("_row", "n", "g", "set", "most").mapInArrow(run, "_row long, n long, g long, size long, set binary")


def _rarest(sets: DataFrame, rule: Rule, reach) -> DataFrame:
    """(key, _row, place, slack): inverted lists of the rarest elements of ``sets`` (_row, n, g, set).

    ``reach`` bounds how many elements of a set may stand before the first that it
    shares with one it links to. Elements are looked at from the rarest on, so what is
    found in one set alone stands first and never meets anything: a text with many words of
    its own has no list left to be scanned.

    If two sets share no rarer element, all that stands before this one in either is
    part of their difference, and so is bounded by ``slack``: two sets link only
    where theirs add up to 0 or more.
    """
    cells = _cells(sets).withColumn("held", F.count("*").over(Window.partitionBy("_row"))).repartition("key")
    often = cells.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    shared = cells.join(often, "key")
    per_row = Window.partitionBy("_row")  # one text's own elements
    before = F.row_number().over(per_row.orderBy("df", "key")) - 1 + F.col("held") - F.count("*").over(per_row)
    placed = shared.withColumns({"before": before, "reach": reach}).filter("before <= reach")
    slack = F.col("n") * (rule.den - rule.num) - F.col("before") * (rule.num + rule.den)
    return placed.select("key", "_row", F.col("before").cast("int").alias("place"), slack.alias("slack"))


def _open_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(key, _row, place, slack, comp) of the lists that may still join two components."""
    comp = components(links).select(F.col("node").alias("_row"), "comp")
    named = lists.join(comp, "_row", "left").select("key", "_row", "place", "slack", F.coalesce("comp", "_row").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("slack").alias("most")).filter("lo <> hi and most >= 0").select("key")
    return cut_lineage(named.join(mixed, "key", "left_semi"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def _near_at_hand(rows: DataFrame) -> DataFrame:
    """Row numbers as the small side of a join: sent to every task up to
    BROADCAST_ROWS of eight bytes, which spares the texts a shuffle; shuffled beyond."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _classes(numbered: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """((_row, n, rep) of all rows, lists (key, _row) of the classes' first rows, their sets)."""
    digests = cut_lineage(_set_digests(numbered, rule))
    rep = digests.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("_row").alias("rep"))
    member = cut_lineage(digests.join(rep, ["n", "s1", "s2"], "left").select("_row", "n", F.coalesce("rep", "_row").alias("rep")))
    drop_table(digests)
    first = member.filter("rep = _row and n > 0")
    small = {r.n: r.c for r in first.filter(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}  # one row per small size
    others = member.filter("rep <> _row or n = 0").select("_row")
    texts = numbered.select("_row", "text").join(_near_at_hand(others), "_row", "left_anti")
    # One shuffle of the keys serves both the counting and the choice.
    count = F.count("*").over(Window.partitionBy("key"))
    met = cut_lineage(_keys(texts, rule, boundary(small, rule)).withColumn("_n", count).filter("_n > 1").drop("_n"))
    free_shuffles(numbered.sparkSession)
    light = met.filter("need = 0").select("key", "_row", F.lit(0).alias("place"), F.lit(0).cast("long").alias("slack"))  # a shared subset is all they must share
    heavy = met.filter("need > 0").groupBy("_row").agg(F.count("*").alias("c"), F.first("need").alias("need")).filter("c >= need")
    heavy = cut_lineage(heavy.select("_row"))
    both = cut_lineage(heavy.unionAll(light.select("_row")).distinct())
    sets = cut_lineage(_candidate_sets(numbered.select("_row", "text").join(_near_at_hand(both), "_row", "left_semi"), rule))
    free_shuffles(numbered.sparkSession)
    long = sets.join(_near_at_hand(heavy), "_row", "left_semi").select("_row", "n", F.lit(0).cast("long").alias("g"), "set")
    lists = cut_lineage(_rarest(long, rule, F.col("n") - F.ceil(F.col("n") * rule.num / rule.den)).unionAll(light))
    drop_table(met, heavy, both)
    return member, lists, sets


def jaccard_components(docs: DataFrame, rule: Rule, row: str = "_row") -> DataFrame:
    """(row, n, comp): set size and the least row that links reach, for a written
    table (row, text) of ``number_rows``.

    A set holds the distinct shingles of ``rule.words`` words, A to Z in lower
    case; a text with fewer words is one shingle, and one without words, or null,
    has an empty set that links with nothing. Repeated rows link like other rows.
    """
    numbered = docs.select(F.col(row).alias("_row"), text_of("text").alias("text"))
    member, lists, sets = _classes(numbered, rule)
    links = _links(lists, sets, rule)
    drop_table(lists, sets)
    comp = components(_union(links))
    out = member.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    return out.select(F.col("_row").alias(row), "n", F.coalesce("comp", "rep").alias("comp"))


def jaccard_pairs(docs: DataFrame, rule: Rule, row: str = "_row") -> tuple[DataFrame, DataFrame]:
    """((row, n, rep), (a, b)): membership in classes of equal sets, and every link
    between two classes' first rows. Copies are not expanded into pairs."""
    numbered = docs.select(F.col(row).alias("_row"), text_of("text").alias("text"))
    member, lists, sets = _classes(numbered, rule)
    return member.withColumnRenamed("_row", row), _compared(lists.withColumn("comp", F.col("_row")), sets, rule, every=True)


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_shingles, component_id): the least id among the rows that links reach.

    Null ids come before all others and are no one's component id unless they are
    alone. An empty table gives an empty table; other columns are not read.
    """
    numbered = number_rows(docs.select(F.col(ident).alias("id"), text_of(text).alias("text")), "_row", "id")
    named = jaccard_components(numbered, rule).join(numbered.select("_row", "id"), "_row")
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    return named.join(least, "comp").select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least id."""
    row = free_name(docs, "_row")
    numbered = number_rows(docs, row, ident, text)
    gone = jaccard_components(numbered.select(row, F.col(text).alias("text")), rule, row).filter(F.col(row) != F.col("comp")).select(row)
    return numbered.join(gone, row, "left_anti").drop(row)
