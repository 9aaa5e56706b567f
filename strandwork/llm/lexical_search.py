"""Ranked lexical search: many queries over all documents, with shared parts added once.

A document's score for an item is the sum of its terms' weights over the item's
terms, and items share terms. For a block of items

1. terms that the same items hold are one atom, a sum that is never taken apart;
2. items are rows of atoms, the most shared ones first. Neighbours that stand in two
   or more items become a node, level by level, until no two nodes are shared as
   neighbours any more. The nodes form a directed graph: inner nodes add two
   nodes, items add the few that are left;
3. for a slice of documents, atoms are filled from term counts, and every node is
   computed once for all of its items.

Documents are read once to count their terms among those asked for, and the
counts are read once to score. Each task keeps the best k of every item, and these
meet in two steps, so that no task sees what grows with the documents but for k rows
a task and item.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ordered_scan, top_k
from ..session import cut_lineage
from .words import text_slices, word_hashes

# Fixed values of the ranking.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of a block of items, of all blocks that one pass over the documents serves.
BLOCK_TERMS, PASS_TERMS = 50_000, 1_000_000
#: Cells of the node table of a slice of documents.
CELLS = 1 << 22
#: Buckets in which the best rows of tasks meet before the last choice.
BUCKETS = 64

_MAPPED = np.arange(256, dtype=np.uint8)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _MAPPED[_lo : _hi + 1] = 0x20
_MAPPED[65:91] = np.arange(97, 123)


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, first term of every text and the end)."""
    return word_hashes(_MAPPED[data], offsets)


@dataclass
class Plan:
    """Nodes of one block: first the atoms, then sums of two earlier nodes."""

    atoms: list[list[int]]
    left: list[int]
    right: list[int]
    items: list[list[int]]

    def levels(self) -> list[np.ndarray]:
        """Inner nodes by the longest way down to atoms."""
        n = len(self.atoms)
        depth = [0] * (n + len(self.left))
        rows = defaultdict(list)
        for i, (a, b) in enumerate(zip(self.left, self.right)):
            depth[n + i] = 1 + max(depth[a], depth[b])
            rows[depth[n + i]].append(i)
        return [np.array(rows[d]) for d in sorted(rows)]

    def additions(self) -> int:
        """Sums of two numbers for one document that holds every term."""
        return sum(len(a) - 1 for a in self.atoms) + len(self.left) + sum(max(0, len(i) - 1) for i in self.items)


def share(items: list[list[int]]) -> Plan:
    """Mine the term sets that ``items`` (distinct term numbers each) have in common."""
    holders = defaultdict(list)
    for i, terms in enumerate(items):
        for t in terms:
            holders[t].append(i)
    sets = defaultdict(list)
    for t, who in holders.items():
        sets[tuple(who)].append(t)
    atoms = sorted(sets, key=lambda who: (-len(who), who))  # the most shared first
    rows: list[list[int]] = [[] for _ in items]
    for a, who in enumerate(atoms):
        for i in who:
            rows[i].append(a)
    left, right = [], []
    while True:
        often = Counter(p for row in rows for p in zip(row, row[1:]))
        if not any(n > 1 for n in often.values()):
            break
        chosen = []  # per item the places to join: the most shared first, none overlapping
        for row in rows:
            taken: set[int] = set()
            for k in sorted(range(len(row) - 1), key=lambda k: (-often[row[k], row[k + 1]], row[k], row[k + 1])):
                if often[row[k], row[k + 1]] > 1 and not {k - 1, k + 1} & taken:
                    taken.add(k)
            chosen.append(taken)
        used = Counter((row[k], row[k + 1]) for row, taken in zip(rows, chosen) for k in taken)
        named = {}
        for pair in sorted(p for p, n in used.items() if n > 1):
            named[pair] = len(atoms) + len(left)
            left.append(pair[0])
            right.append(pair[1])
        if not named:
            break
        for i, (row, taken) in enumerate(zip(rows, chosen)):
            out, k = [], 0
            while k < len(row):
                pair = tuple(row[k : k + 2])
                joined = k in taken and pair in named
                out.append(named[pair] if joined else row[k])
                k += 2 if joined else 1
            rows[i] = out
    return Plan([sets[a] for a in atoms], left, right, rows)


def item_blocks(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_row, item, terms, block): distinct terms of every item, in blocks of bounded
    size. Items stand in the order of their term of least hash, so that those that share
    terms are likely neighbours."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"[^{SEPARATORS}]+"), F.lit(0)))
    rows = items.select(F.col(item).alias("item"), terms.alias("terms")).filter(F.size("terms") > 0)
    rows = rows.withColumn("least", F.array_min(F.transform("terms", lambda t: F.xxhash64(t))))
    kept = cut_lineage(rows.withColumn("item_row", F.monotonically_increasing_id()))
    scanned = ordered_scan(kept, ["least", "item_row"], {"upto": F.size("terms").cast("long")})
    return scanned.select("item_row", "item", "terms", F.floor((F.col("upto") - 1) / BLOCK_TERMS).alias("block"))


_PLAN = "block long, item_rows array<long>, terms array<string>, atom_of array<int>, left array<int>, right array<int>, nodes array<int>, upto array<int>"


def _plan_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("item_row")
    terms = sorted({t for own in rows["terms"] for t in own})
    number = {t: i for i, t in enumerate(terms)}
    plan = share([sorted(number[t] for t in own) for own in rows["terms"]])
    atom_of = np.zeros(len(terms), int)
    for a, own in enumerate(plan.atoms):
        atom_of[own] = a
    return pd.DataFrame({
        "block": [key[0]], "item_rows": [rows["item_row"].tolist()], "terms": [terms], "atom_of": [atom_of.tolist()],
        "left": [plan.left], "right": [plan.right], "nodes": [[n for i in plan.items for n in i]], "upto": [np.cumsum([len(i) for i in plan.items]).tolist()],
    })


def block_plans(blocks: DataFrame) -> DataFrame:
    """One row per block: its nodes as arrays."""
    return blocks.select("block", "item_row", "terms").groupBy("block").applyInPandas(_plan_block, _PLAN)


def count_terms(docs: DataFrame, terms: list[str], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, found, tf): terms with repeats, and the places in ``terms`` of those that
    the document holds, with how often."""
    column = pa.array(terms, pa.string())
    own = np.concatenate([term_hashes(data, offsets)[0] for _, _, data, offsets in text_slices(column)] or [np.zeros(0, np.uint64)])
    order = np.argsort(own)
    sent = docs.sparkSession.sparkContext.broadcast((np.append(own[order], np.uint64((1 << 64) - 1)), np.append(order, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, place = sent.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                hashes, first = term_hashes(data, offsets)
                at = np.searchsorted(keys, hashes)
                hit = np.flatnonzero(keys[at] == hashes)
                doc = np.searchsorted(first, hit, "right") - 1
                cell, tf = np.unique(doc * len(keys) + place[at[hit]], return_counts=True)
                offs = pa.array(np.searchsorted(cell // len(keys), np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a), pa.array(np.diff(first)),
                    pa.ListArray.from_arrays(offs, pa.array(cell % len(keys), pa.int32())), pa.ListArray.from_arrays(offs, pa.array(tf, pa.int32())),
                ], ["id", "n", "found", "tf"])

    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, found array<int>, tf array<int>")


class Best:
    """The best k (score, id) of every item, null ids first among equals."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # scores below it cannot enter
        self.rows = [np.zeros(0, np.int64)] * 4  # item, score, 1 where there is an id, id

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of (item, document)."""
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.rows = [np.concatenate(x) for x in zip(self.rows, (item, scores[item, doc], known[doc], ids[doc]))]
        if len(self.rows[0]) > 4 * self.k * len(self.least):
            self.prune()

    def prune(self) -> None:
        item, score, known, ids = self.rows
        order = np.lexsort((ids, known, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = order[rank == self.k - 1]
        self.least[self.rows[0][last]] = score[last]
        self.rows = [x[order[rank < self.k]] for x in self.rows]


def _scored(counts: DataFrame, plans: list, weights: np.ndarray, place: dict[str, int], docs: int, terms: int, k: int) -> DataFrame:
    """(item_row, id, score): the best k of every task and item."""
    local = []
    for p in plans:
        atom = np.full(len(place), -1)
        atom[[place[t] for t in p.terms]] = p.atom_of
        plan = Plan([[]] * (max(p.atom_of) + 1), p.left, p.right, [])
        local.append((atom, len(plan.atoms), np.array(p.left, int), np.array(p.right, int), plan.levels(), np.array(p.nodes, int), np.append(0, np.array(p.upto[:-1], int)), np.array(p.item_rows)))
    sent = counts.sparkSession.sparkContext.broadcast((local, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, weight = sent.value
        best = [Best(len(b[-1]), k) for b in blocks]
        for batch in batches:
            ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([50 + 50 * n * docs // terms for n in batch.column("n").to_pylist()], np.int64)  # products of any size
            upto = np.append(0, np.cumsum(batch.column("found").value_lengths().to_numpy(zero_copy_only=False)))
            found, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("found", "tf"))
            doc = np.repeat(np.arange(len(ids)), np.diff(upto))
            value = weight[found] * (1_000_000_000 * tf // (1000 * tf + 20 * size[doc]))
            for (atom, n_atoms, left, right, levels, nodes, starts, rows), keep in zip(blocks, best):
                step = max(1, CELLS // (n_atoms + len(left) + len(nodes) + len(rows)))
                for a in range(0, len(ids), step):
                    b = min(a + step, len(ids))
                    cells = slice(upto[a], upto[b])
                    mine = np.flatnonzero(atom[found[cells]] >= 0) + upto[a]
                    sums = np.zeros((n_atoms + len(left), b - a), np.int64)
                    np.add.at(sums, (atom[found[mine]], doc[mine] - a), value[mine])
                    for level in levels:
                        sums[n_atoms + level] = sums[left[level]] + sums[right[level]]
                    keep.add(np.add.reduceat(sums[nodes], starts, axis=0), known[a:b], ids[a:b])
        for (*_, rows), keep in zip(blocks, best):
            keep.prune()
            item, score, known, ids = keep.rows
            yield pa.RecordBatch.from_arrays([pa.array(rows[item]), pa.array(ids, mask=known == 0), pa.array(score)], ["item_row", "id", "score"])

    return counts.mapInArrow(run, "item_row long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, ident, score): the ``k`` best documents of every item, score above 0.

    Terms are runs of letters and digits of ASCII and of all characters beyond it, A to
    Z in lower case; they are compared by 64-bit hashes. With N documents that hold a
    term, L terms in all, n in the document, tf in it of one term and df documents that
    hold that, a term weighs ``floor(1000 ln((2N + 2) / (2df + 1)))`` and adds its weight
    times ``10^9 tf div (1000 tf + 20 (50 + 50 n N div L))``, in whole numbers.

    Equal scores follow the id, null first; ids are read as long. Every row is searched
    and counted, repeated ones too, and every row of ``items`` is ranked apart. Null
    and empty texts hold no term; items without terms or matches have no row, and so
    have empty tables. Other columns are not read. Items of any number are
    served in passes of PASS_TERMS terms, one item at least.
    """
    blocks = cut_lineage(item_blocks(items, item, item_text))
    plans = cut_lineage(block_plans(blocks))
    per_pass = PASS_TERMS // BLOCK_TERMS
    passes = [r.p for r in plans.select(F.floor(F.col("block") / per_pass).alias("p")).distinct().orderBy("p").collect()]
    found, total = [], None
    for number in passes:
        own = plans.filter(F.floor(F.col("block") / per_pass) == number).collect()  # PASS_TERMS terms and one item
        names = sorted({t for p in own for t in p.terms})
        counts = cut_lineage(count_terms(docs, names, ident, text))
        total = total or counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            break
        df = np.zeros(len(names), np.int64)
        for r in counts.select(F.explode("found").alias("term")).groupBy("term").count().collect():  # one row per term asked for
            df[r.term] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        found.append(_scored(counts, own, weights, {t: i for i, t in enumerate(names)}, total.docs, total.terms, k))
    if not found:
        none = docs.sparkSession.createDataFrame([], "item_row long, id long, score long")
        found = [none]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionAll(more)
    order = [F.col("score").desc(), F.col("id").asc_nulls_first()]
    some = top_k(rows.withColumn("bucket", F.spark_partition_id() % BUCKETS), order, k, ["item_row", "bucket"])
    ranked = top_k(some.drop("rank", "bucket"), order, k, ["item_row"])
    named = ranked.join(blocks.select("item_row", F.col("item").alias(item)), "item_row")
    return named.select(item, F.col("rank").cast("int").alias("rank"), F.col("id").alias(ident), "score")
