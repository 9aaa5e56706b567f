"""Substring dedup over words by level-wise doubling.

A window of the wanted length repeats only if the shorter windows inside it do.
The search starts at short windows and extends those that repeat, and no others,
to twice their length, level by level up to the wanted length.

The first level needs no window at every place. Every window of the wanted
length has an anchor, the leftmost of its short windows with the least hash;
equal windows have equal anchors at equal places. Only anchors start (about one
place in eight), and at every level an anchor is extended to the right and to
the left, since any window around it holds one of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table, free_shuffles
from .rows import number_rows, text_of
from .words import as_long, leftmost_minima, mix, text_slices, window_starts, window_sums, word_hashes

FIRST_WORDS = 5
_FACTOR, _FACTOR2 = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
RIGHT, LEFT = 1, 2  # bits of the sides on which an anchor has repeated


def _levels(first: int, words: int) -> list[int]:
    """first, 2 first, 4 first ... while one of the two extensions fits every window."""
    out = [first]
    while 4 * out[-1] <= words + first:
        out.append(2 * out[-1])
    return out


def _anchors(hashes: np.ndarray, starts: np.ndarray, first: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every short window, places where a wanted window starts, anchor of each)."""
    short = mix(window_sums(hashes, first, _FACTOR))
    begins = np.flatnonzero(window_starts(starts, words, len(hashes)))
    if not len(begins):
        return short, begins, begins
    return short, begins, leftmost_minima(short, words - first + 1)[begins]


def _repeated(windows: DataFrame) -> DataFrame:
    """Rows whose hash stands on more than one row. Counts are formed before the
    shuffle, and the join can split a hash with many rows."""
    many = windows.groupBy("hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("hash")
    return windows.join(many, "hash", "left_semi")


def _first_level(docs: DataFrame, first: int, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            for a, b, data, offsets in text_slices(batch.column("text")):
                hashes, starts = word_hashes(data, offsets)
                short, _, anchor = _anchors(hashes, starts, first, words)
                place = np.unique(anchor)
                of = np.searchsorted(starts, place, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(as_long(short[place])), pa.array(rows[a + of]), pa.array((place - starts[of]).astype(np.int32))], ["hash", "_row", "place"])

    return docs.mapInArrow(run, "hash long, _row long, place int")


def _with_places(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Texts that have anchors left, with the places of these in the text. A list is
    as long as its own text at most."""
    lists = found.groupBy("_row").agg(F.collect_list(F.struct("place", "sides")).alias("found"))
    return docs.join(lists, "_row").select("_row", "text", F.col("found.place").alias("places"), F.col("found.sides").alias("sides"))


def _gathered(batch: pa.RecordBatch):
    """Per slice of a batch: word hashes, first words, anchors as word numbers, their sides, row of each."""
    rows = batch.column("_row").to_numpy()
    for a, b, data, offsets in text_slices(batch.column("text")):
        hashes, starts = word_hashes(data, offsets)
        lists, sides = batch.column("places").slice(a, b - a), batch.column("sides").slice(a, b - a)
        of = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
        place = lists.flatten().to_numpy().astype(np.int64) + starts[of]
        yield hashes, starts, place, sides.flatten().to_numpy(), of, rows[a:b]


def _next_level(docs: DataFrame, found: DataFrame, first: int, length: int) -> DataFrame:
    """The extensions of the anchors in ``found`` to ``length`` words on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, starts, place, sides, of, rows in _gathered(batch):
                sums = mix(window_sums(hashes, length, _FACTOR)) if len(hashes) >= length else hashes[:0]
                out = []
                for side, begin in ((RIGHT, place), (LEFT, place + first - length)):
                    ok = ((sides & side) > 0) & (begin >= starts[of]) & (begin + length <= starts[of + 1])
                    # Right and left windows of one length are kept apart: they are other questions.
                    out.append((mix(sums[begin[ok]] + np.uint64(side)), rows[of[ok]], (place - starts[of])[ok].astype(np.int32), np.full(ok.sum(), side, np.int32)))
                hash_, row, at, kind = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(hash_)), pa.array(row), pa.array(at), pa.array(kind)], ["hash", "_row", "place", "side"])

    return _with_places(docs, found).mapInArrow(run, "hash long, _row long, place int, side int")


def _surroundings(docs: DataFrame, found: DataFrame, first: int, words: int) -> DataFrame:
    """(hash, hash2, _row, place): the run of words that holds every wanted window
    around an anchor, where it lies inside the text."""
    before, length = words - first, 2 * words - first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, starts, place, sides, of, rows in _gathered(batch):
                begin = place - before
                ok = (sides == RIGHT | LEFT) & (begin >= starts[of]) & (begin + length <= starts[of + 1])
                one, two = (mix(window_sums(hashes, length, f))[begin[ok]] if ok.any() else hashes[:0] for f in (_FACTOR, _FACTOR2))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(one)), pa.array(as_long(two)), pa.array(rows[of[ok]]), pa.array((place - starts[of])[ok].astype(np.int32))], ["hash", "hash2", "_row", "place"])

    return _with_places(docs, found).mapInArrow(run, "hash long, hash2 long, _row long, place int")


def _not_first(windows: DataFrame, at: str) -> DataFrame:
    """Rows (_row, at) whose two hashes stand on an earlier row, or earlier in the row."""
    earliest = windows.groupBy("hash", "hash2").agg(F.count("*").alias("_n"), F.min(F.struct("_row", at)).alias("e")).filter("_n > 1").drop("_n")
    again = windows.join(earliest, ["hash", "hash2"]).filter((F.col("_row") != F.col("e._row")) | (F.col(at) != F.col(f"e.{at}")))
    return again.select("_row", at)


def _last_level(docs: DataFrame, found: DataFrame, first: int, length: int, words: int) -> DataFrame:
    """(hash, hash2, _row, start): windows of ``words`` words around an anchor that
    repeated to ``length`` words on a side that the window holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, starts, place, sides, of, rows in _gathered(batch):
                _, begins, anchor = _anchors(hashes, starts, first, words)
                side = np.zeros(len(hashes) + 1, np.int64)
                side[place] = sides
                side, before = side[anchor], anchor - begins
                fits = ((side & RIGHT) > 0) & (before + length <= words) | ((side & LEFT) > 0) & (before >= length - first)
                at = begins[fits]
                doc = np.searchsorted(starts, at, "right") - 1
                one, two = (mix(window_sums(hashes, words, f))[at] if len(at) else hashes[:0] for f in (_FACTOR, _FACTOR2))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(one)), pa.array(as_long(two)), pa.array(rows[doc]), pa.array((at - starts[doc]).astype(np.int32))], ["hash", "hash2", "_row", "start"])

    return _with_places(docs, found).mapInArrow(run, "hash long, hash2 long, _row long, start int")


def copied_rows(docs: DataFrame) -> DataFrame:
    """(_row): rows whose whole text stands in an earlier row."""
    content = docs.select("_row", F.sha2("text", 256).alias("content"))
    first = content.groupBy("content").agg(F.min("_row").alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    return content.join(first, "content").filter("_row > first").select("_row")


def repeated_windows(docs: DataFrame, copies: DataFrame, words: int, first: int = FIRST_WORDS) -> DataFrame:
    """(_row, runs): windows of ``words`` words whose words also start earlier, as
    runs (start, n) of n windows at consecutive places.

    ``docs`` is a written table (_row, text) whose row numbers rise along the
    order of the documents. Rows in ``copies`` are left out: each of their windows
    repeats, and none is the first of its kind. Windows are compared by 128 bits.
    """
    spark = docs.sparkSession
    windows = cut_lineage(_first_level(docs, first, words).join(copies, "_row", "left_anti"))
    free_shuffles(spark)
    found = cut_lineage(_repeated(windows).select("_row", "place", F.lit(RIGHT | LEFT).alias("sides")))
    drop_table(windows)
    levels = _levels(first, words)
    for length in levels[1:]:
        windows, before = cut_lineage(_next_level(docs, found, first, length)), found
        free_shuffles(spark)
        found = cut_lineage(_repeated(windows).groupBy("_row", "place").agg(F.sum("side").cast("int").alias("sides")))
        drop_table(windows, before)
    # Where all that surrounds an anchor stands earlier, so does every window
    # around it. Such places are settled as one; the first of them stays, so no
    # window loses its earliest place.
    windows = cut_lineage(_surroundings(docs, found, first, words))
    free_shuffles(spark)
    whole = cut_lineage(_not_first(windows, "place"))
    drop_table(windows)
    windows = cut_lineage(_last_level(docs, found.join(whole, ["_row", "place"], "left_anti"), first, levels[-1], words))
    drop_table(found)
    runs = _not_first(windows, "start").select("_row", "start", F.lit(1).alias("n"))
    runs = runs.unionAll(whole.select("_row", F.col("place") - (words - first), F.lit(words - first + 1)))
    starts = cut_lineage(runs.groupBy("_row").agg(F.collect_list(F.struct("start", "n")).alias("runs")))  # as long as the text at most
    drop_table(windows, whole)
    return starts


def remove_repeats(docs: DataFrame, words: int = 20, ident: str = "doc_id", text: str = "text", first: int = FIRST_WORDS) -> DataFrame:
    """(ident, n_words, n_removed, spans, kept_text): one row per input row.

    Words are runs other than space and tab to carriage return, unchanged. A word
    is removed where a window of ``words`` words covers it whose sequence starts
    earlier: in a row of smaller id, or earlier in the same row. Windows are
    judged on the input. ``spans`` are the removed runs (first word, words) and
    ``kept_text`` the other words joined by one space. Null ids come first; of
    rows with one id the hash of the text decides the order, and repeated rows
    keep one. Null, empty and short texts lose nothing; an empty table gives an
    empty table; other columns are not read.
    """
    if words < first:
        raise ValueError("the window must hold the first level")
    numbered = number_rows(docs.select(F.col(ident).alias("id"), text_of(text).alias("text")), "_row", "id")
    free_shuffles(docs.sparkSession)
    copies = cut_lineage(copied_rows(numbered))
    again = repeated_windows(numbered.select("_row", "text"), copies, words, first)
    marks = again.select("_row", F.col("runs.start").alias("starts"), F.col("runs.n").alias("counts"), F.lit(False).alias("copy"))
    marks = marks.unionAll(copies.select("_row", F.lit(None).cast("array<int>"), F.lit(None).cast("array<int>"), F.lit(True)))
    rows = numbered.join(marks, "_row", "left").select("id", "text", "starts", "counts", F.coalesce("copy", F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = [_cut(t.encode(), s, k, c, words) for t, s, k, c in zip(*(part.column(n).to_pylist() for n in ("text", "starts", "counts", "copy")))]
                n, removed, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "spans", "kept_text"])

    kind = dict(numbered.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_removed long, spans array<array<long>>, kept_text string").withColumnRenamed("id", ident)


def _cut(text: bytes, starts: list[int] | None, counts: list[int] | None, copy: bool, words: int) -> tuple[int, int, list[list[int]], str]:
    found = text.split()  # bytes split at exactly the six ASCII space characters
    n = len(found)
    if copy and n >= words:
        return n, n, [[0, n]], ""
    if not starts:
        return n, 0, [], b" ".join(found).decode()
    edge = np.zeros(n + 1, np.int64)
    at = np.array(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + np.array(counts) - 1 + words, -1)
    gone = np.cumsum(edge)[:-1] > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    spans = [[a, b - a] for a, b in zip(turns[::2].tolist(), turns[1::2].tolist())]
    kept = [w for w, g in zip(found, gone.tolist()) if not g]
    return n, n - len(kept), spans, b" ".join(kept).decode()
