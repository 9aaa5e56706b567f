"""Suffix-array dedup over bytes: maximal repeats from a common-prefix interval tree.

A string of the wanted length has an anchor, the quarter of it of least hash, and
equal strings have equal anchors. Suffixes that start at an anchor that
stands in several places are sorted with their common-prefix lengths; a scan with
a stack gives the tree of common-prefix intervals. Going up the tree from a
suffix, the prefix that it shares gets shorter and the suffixes that share it
more; among them the longest common left extension decides whether the two
together make a repeat. All occurrences are looked at, not neighbours alone.

The work of a group is a *cell*: the strings that start ``low`` to ``high - 1``
bytes before an anchor. All strings of a cell share a core, and suffixes meet by
the hash of that core. Groups with many different surroundings are not gathered:
their cells are halved, which makes the core longer, down to single strings
whose equality is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table, free_shuffles
from .rows import number_rows, text_of
from .words import _BYTE, as_long, mix, powers, text_slices, window_starts, window_sums

#: Least bytes of an anchor; a longer string has one of a quarter of its length, so
#: that a common line is not an anchor.
ANCHOR = 32
#: Different surroundings up to which a group is sorted by one task; larger groups are split.
GROUP_SUFFIXES = 4096
_FACTOR, _FACTOR2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_CELL = "_row long, at int, low int, high int"


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = pick(values[: len(values) - step], values[step:])
        span += step
    return values


def anchor_bytes(length: int) -> int:
    return max(ANCHOR, length // 4)


def _anchor_level(docs: DataFrame, length: int) -> DataFrame:
    """(hash, _row, at): the anchors of all strings of ``length`` bytes."""
    size = anchor_bytes(length)
    width = length - size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            for a, _, data, offsets in text_slices(batch.column("text")):
                if len(data) < length:
                    continue
                short = mix(window_sums(_BYTE[data], size, _FACTOR))
                least = _slide(short, width, np.minimum)
                least[~window_starts(offsets, length, len(least))] = 0
                # A place is an anchor if it holds the least hash of some string around it.
                pad = np.zeros(width - 1, np.uint64)
                place = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), width, np.maximum) == short) & (short > 0))
                of = np.searchsorted(offsets, place, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(as_long(short[place])), pa.array(rows[a + of]), pa.array((place - offsets[of]).astype(np.int32))], ["hash", "_row", "at"])

    return docs.mapInArrow(run, "hash long, _row long, at int")


def _with_cells(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Texts with their cells; a list is as long as its own text's anchors."""
    lists = cells.groupBy("_row").agg(F.collect_list(F.struct("at", "low", "high")).alias("c"))
    return docs.join(lists, "_row").select("_row", "text", *[F.col(f"c.{n}").alias(n) for n in ("at", "low", "high")])


def _cells_of(batch: pa.RecordBatch):
    rows = batch.column("_row").to_numpy()
    for a, b, data, offsets in text_slices(batch.column("text")):
        lists = [batch.column(n).slice(a, b - a) for n in ("at", "low", "high")]
        of = np.repeat(np.arange(b - a), np.diff(lists[0].offsets.to_numpy()))
        at, low, high = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        yield data, offsets, rows[a:b], of, at + offsets[of], low, high


def _bounds(offsets, of, place, low, high, length):
    """(left end, core start, core end, right end) of every cell's surroundings, cut at the text."""
    begin, end = offsets[of], offsets[of + 1]
    return np.maximum(begin, place - high + 1), place - low, place + length - high + 1, np.minimum(end, place + length - low)


def _meet(docs: DataFrame, cells: DataFrame, length: int) -> DataFrame:
    """(key, around, _row, at, low, high): hash of the core, and of core and surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, rows, of, place, low, high in _cells_of(batch):
                left, start, stop, right = _bounds(offsets, of, place, low, high, length)
                # Without room for the wanted length around it, a cell holds no string.
                ok = (start >= offsets[of]) & (stop <= offsets[of + 1]) & (right - left >= length)
                of, place, low, high, left, start, stop, right = (x[ok] for x in (of, place, low, high, left, start, stop, right))
                shape = mix((low * 4096 + high).astype(np.uint64) + np.uint64(1))
                key = mix(_range_hash(data, start, stop, _FACTOR) + shape)
                around = mix(_range_hash(data, left, right, _FACTOR2) + mix((place - left).astype(np.uint64) << np.uint64(32) | (right - place).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), pa.array(as_long(around)), pa.array(rows[of]), *(pa.array(x.astype(np.int32)) for x in (place - offsets[of], low, high))], ["key", "around", "_row", "at", "low", "high"])

    return _with_cells(docs, cells).mapInArrow(run, f"key long, around long, {_CELL}")


def _range_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray, factor: int) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(n, factor), out=total[1:])
    return (total[stop] - total[start]) * powers(n + 1, pow(factor, -1, 1 << 64))[start] + mix((stop - start).astype(np.uint64))


def _suffixes(docs: DataFrame, cells: DataFrame, length: int) -> DataFrame:
    """(key, left, right, _row, at, low, high): the surroundings themselves; ``left`` is reversed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, rows, of, place, low, high in _cells_of(batch):
                left, start, stop, right = _bounds(offsets, of, place, low, high, length)
                shape = mix((low * 4096 + high).astype(np.uint64) + np.uint64(1))
                key = mix(_range_hash(data, start, stop, _FACTOR) + shape)
                raw = data.tobytes()
                before = [raw[a:b][::-1] for a, b in zip(left.tolist(), start.tolist())]
                after = [raw[a:b] for a, b in zip(stop.tolist(), right.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(rows[of]), *(pa.array(x.astype(np.int32)) for x in (place - offsets[of], low, high))], ["key", "left", "right", "_row", "at", "low", "high"])

    return _with_cells(docs, cells).mapInArrow(run, f"key long, left binary, right binary, {_CELL}")


def _cut_out(docs: DataFrame, cells: DataFrame, length: int) -> DataFrame:
    """(_row, base, text, at, low, high): each cell with its surroundings as a text of
    its own, which starts ``base`` bytes into the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, rows, of, place, low, high in _cells_of(batch):
                left, _, _, right = _bounds(offsets, of, place, low, high, length)
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(left.tolist(), right.tolist())]
                numbers = [pa.array(x.astype(np.int32)) for x in (left - offsets[of], place - left, low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[of]), numbers[0], pa.array(texts, pa.binary()), *numbers[1:]], ["_row", "base", "text", "at", "low", "high"])

    return _with_cells(docs, cells).mapInArrow(run, "_row long, base int, text binary, at int, low int, high int")


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the common prefix of every string with the next."""
    n = len(strings)
    if n < 2:
        return np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    width = int(sizes.max()) if n else 0
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
    differ = flat[1:] != flat[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width) if width else np.zeros(n - 1, np.int64)
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def interval_tree(shared: np.ndarray) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """Common-prefix intervals of a sorted list of suffixes, by a scan with a stack.

    Returns the nodes (first suffix, last suffix, depth), the parent of every
    node and the innermost node of every suffix, -1 where there is none.
    """
    n = len(shared) + 1
    nodes, parent, inner = [], [], [-1] * n
    stack: list[list] = [[0, 0, []]]  # first suffix, depth, nodes below
    for i in range(n):
        depth = int(shared[i]) if i < n - 1 else 0
        first, below = i, []
        while stack[-1][1] > depth:
            first, at, children = stack.pop()
            number = len(nodes)
            nodes.append((first, i, at))
            parent.append(-1)
            for c in children:
                parent[c] = number
            if stack[-1][1] >= depth:
                stack[-1][2].append(number)
            else:
                below = [number]
        if stack[-1][1] < depth:
            stack.append([first, depth, below])
    for number, (first, last, _) in enumerate(nodes):  # inner nodes come before outer ones
        for s in range(first, last + 1):
            if inner[s] < 0:
                inner[s] = number
    return nodes, parent, inner


def group_repeats(left: list[bytes], right: list[bytes], need: int) -> list[tuple[int, int]]:
    """For suffixes of one group, sorted by ``right``: the farthest that repeats reach
    to the left and to the right of the core, (-1, -1) for none.

    A repeat with another suffix shares l bytes of ``left`` and r of ``right``, and
    counts where l + r >= need.
    """
    n = len(right)
    shared = common_prefixes(right)
    by_left = sorted(range(n), key=left.__getitem__)
    left_shared = common_prefixes([left[i] for i in by_left])
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    beside = np.concatenate([[0], shared, [0]])
    most_right = np.maximum(beside[:-1], beside[1:])
    beside = np.concatenate([[0], left_shared, [0]])
    most_left = np.maximum(beside[:-1], beside[1:])[rank]
    out = [(-1, -1)] * n
    open_ = np.flatnonzero(most_left + most_right >= need)
    if not len(open_):
        return out
    nodes, parent, inner = interval_tree(shared)
    # Depth 0 is shared by the whole group.
    for x in open_.tolist():
        far_left = far_right = -1
        node, below, above = inner[x], -1, n
        seen_first, seen_last = x, x
        while True:
            first, last, depth = nodes[node] if node >= 0 else (0, n - 1, 0)
            if depth + most_left[x] < need:
                break
            # Of the suffixes that come in at this node, the nearest in left order.
            for a, b in ((first, seen_first), (seen_last + 1, last + 1)):
                if b > a:
                    came = rank[a:b]
                    lower, upper = came[came < rank[x]], came[came > rank[x]]
                    below = max(below, int(lower.max())) if len(lower) else below
                    above = min(above, int(upper.min())) if len(upper) else above
            seen_first, seen_last = first, last
            reach = max(int(left_shared[below : rank[x]].min()) if below >= 0 else 0, int(left_shared[rank[x] : above].min()) if above < n else 0)
            if reach + depth >= need:
                far_left, far_right = max(far_left, reach), max(far_right, depth)
            if node < 0 or (far_left == most_left[x] and far_right == most_right[x]):
                break
            node = parent[node]
        out[x] = (far_left, far_right)
    return out


def _tree_spans(suffixes: DataFrame, length: int) -> DataFrame:
    """(_row, begin, end): bytes that repeats cover, group by group.

    Rows come sorted by key and suffix; a group may run over several batches and
    is bounded by GROUP_SUFFIXES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple[int, int, int]] = []

        def settle() -> None:
            if len(held) > 1:
                low, high = held[0][5:7]
                reaches = group_repeats([r[1] for r in held], [r[2] for r in held], high - low - 1)
                for (_, _, _, row, at, _, _), (a, b) in zip(held, reaches):
                    if a >= 0:
                        found.append((row, at - low - a, at + length - high + 1 + b))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["_row", "begin", "end"])
            found.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    settle()
                held.append(row)
            if found:
                yield batch_of()
        settle()
        if found:
            yield batch_of()

    ordered = suffixes.repartition("key").sortWithinPartitions("key", "right")
    return ordered.select("key", "left", "right", "_row", "at", "low", "high").mapInArrow(run, "_row long, begin int, end int")


def repeat_spans(docs: DataFrame, without: DataFrame, length: int, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """(_row, begin, end): bytes covered by strings of ``length`` bytes that also
    start elsewhere, for a written table (_row, text) without the rows in
    ``without``. Spans overlap."""
    spark = docs.sparkSession
    anchors = cut_lineage(_anchor_level(docs, length).join(without, "_row", "left_anti"))
    free_shuffles(spark)
    many = anchors.groupBy("hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("hash")
    spans, cells = [], cut_lineage(anchors.join(many, "hash", "left_semi").select("_row", "at", F.lit(0).alias("low"), F.lit(length - anchor_bytes(length) + 1).alias("high")))
    drop_table(anchors)
    pieces = None  # cells of large groups, cut out of their texts
    while True:
        met = cut_lineage(_meet(docs, cells, length))
        free_shuffles(spark)
        alike = cut_lineage(met.groupBy("key", "around").agg(F.count("*").alias("n"), F.min(F.struct("_row", "at", "low", "high")).alias("first")))
        # Equal surroundings: every string of the cell repeats, whatever else there is.
        twins = met.join(alike.filter("n > 1").select("key", "around"), ["key", "around"], "left_semi")
        twins = twins.select("_row", (F.col("at") - F.col("high") + 1).alias("begin"), (F.col("at") + length - F.col("low")).alias("end"))
        # Others are compared with one suffix of each kind of surroundings.
        sizes = alike.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
        left = cut_lineage(alike.join(sizes.select("key", "kinds"), "key").select("kinds", "first.*"))
        covered = cut_lineage(_at_home(twins, pieces))
        drop_table(met, alike, cells)
        trees = _tree_spans(_suffixes(docs, left.filter(F.col("kinds") <= group_suffixes), length), length)
        spans += [covered, cut_lineage(_at_home(trees, pieces))]
        free_shuffles(spark)
        large = left.filter((F.col("kinds") > group_suffixes) & (F.col("high") - F.col("low") > 1))
        if large.limit(1).count() == 0:
            drop_table(left)
            break
        if pieces is None:
            pieces = cut_lineage(_cut_out(docs, large, length).withColumn("piece", F.monotonically_increasing_id()))
            docs = pieces.select(F.col("piece").alias("_row"), "text")
            large = pieces.select(F.col("piece").alias("_row"), "at", "low", "high")
        half = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("low").alias("low"), half.alias("high")), F.struct(half.alias("low"), F.col("high").alias("high"))))
        cells = cut_lineage(large.select("_row", "at", halves.alias("c")).select("_row", "at", "c.low", "c.high"))
        drop_table(left)
    out = spans[0]
    for s in spans[1:]:
        out = out.unionAll(s)
    return out


def _at_home(spans: DataFrame, pieces: DataFrame | None) -> DataFrame:
    """Spans of pieces as spans of the rows that they were cut out of."""
    if pieces is None:
        return spans
    named = spans.withColumnRenamed("_row", "piece").join(pieces.select("piece", "_row", "base"), "piece")
    return named.select("_row", (F.col("begin") + F.col("base")).alias("begin"), (F.col("end") + F.col("base")).alias("end"))


def remove_byte_repeats(docs: DataFrame, length: int = 400, ident: str = "doc_id", text: str = "text", group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """(ident, n_bytes, n_removed, spans, kept): one row per input row.

    A byte is removed where a string of ``length`` bytes covers it that also starts
    elsewhere, in another text or the same; strings never run over texts and are
    judged on the input. ``spans`` are the maximal removed runs (first byte, bytes)
    and ``kept`` the other bytes. Null, empty and short texts lose nothing; equal
    texts, so repeated rows too, lose everything from ``length`` bytes on. An empty
    table gives an empty table; other columns are not read.
    """
    if length < ANCHOR:
        raise ValueError("the length must hold an anchor")
    numbered = number_rows(docs.select(F.col(ident).alias("id"), text_of(text).alias("text")), "_row", "id")
    free_shuffles(docs.sparkSession)
    content = numbered.select("_row", F.sha2("text", 256).alias("content"))
    groups = content.groupBy("content").agg(F.min("_row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    twins = cut_lineage(content.join(groups, "content").select("_row", "first"))
    # One of equal texts stands for all; it is gone in full itself, but others meet it.
    spans = repeat_spans(numbered.select("_row", "text"), twins.filter("_row <> first").select("_row"), length, group_suffixes)
    lists = spans.groupBy("_row").agg(F.collect_list(F.struct("begin", "end")).alias("c")).select("_row", F.col("c.begin").alias("begins"), F.col("c.end").alias("ends"))
    rows = numbered.join(twins.select("_row", F.lit(True).alias("twin")), "_row", "left").join(lists, "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = [_cut_bytes((t or "").encode(), b, e, bool(w), length) for t, b, e, w in zip(*(part.column(n).to_pylist() for n in ("text", "begins", "ends", "twin")))]
                n, removed, cut, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(cut, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    kind = dict(numbered.dtypes)["id"]
    return rows.select("id", "text", "begins", "ends", "twin").mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary").withColumnRenamed("id", ident)


def _cut_bytes(text: bytes, begins, ends, twin: bool, length: int) -> tuple[int, int, list[list[int]], bytes]:
    n = len(text)
    if twin and n >= length:
        return n, n, [[0, n]], b""
    if not begins:
        return n, 0, [], text
    spans: list[list[int]] = []
    for a, b in sorted(zip(begins, ends)):
        a, b = max(a, 0), min(b, n)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return n, sum(b - a for a, b in spans), [[a, b - a] for a, b in spans], b"".join(kept)
