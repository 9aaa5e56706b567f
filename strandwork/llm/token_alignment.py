"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Both tokenizers code the same bytes, so a text has two rising lists of token
ends. The shorter list drives: each of its ends gallops through the longer one,
in steps that double from the last place known to lie before it, and a binary
search ends inside the last step. Common ends cut both token lists into groups of
the same bytes; a token's ranks among the ends give the tokens it lies in.

All texts of an Arrow batch are searched side by side. Every second end starts
from the place of the end before it, which an earlier round has found, so the
work follows the number of ends and the distances between them.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .chunks import ChunkCoder
from .rows import free_name
from .token_files import LibraryCoder
from .words import text_slices

#: Kinds of linked id pairs that are broadcast at most, of about 20 bytes each.
BROADCAST_PAIRS = 2_000_000
#: Chunks that a worker remembers for either tokenizer.
REMEMBERED = 200_000
#: Tokens of A whose groups are written out side by side.
TOKENS_AT_ONCE = 1 << 19
_SPACE = 0x20


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible
    Latin-1 characters stand for themselves, the others in turn for U+0100 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


Coded = tuple[np.ndarray, np.ndarray]


class CheckedCoder:
    """Ids of texts, each led by a space, and the number of bytes of every id.

    A chunk whose tokens do not join to its own bytes is coded as -1 alone.
    """

    def __init__(self, code: Callable[[list[str]], Coded], tokens: list[bytes], **cuts):
        self.tokens = tokens
        self.lengths = np.array([*map(len, tokens), 0], np.int64)  # the last is that of -1
        self.code = code
        self.chunks = ChunkCoder(self._checked, remembered=REMEMBERED, **cuts)
        self.encode = self.chunks.encode

    def _checked(self, texts: list[str]) -> Coded:
        ids, sizes = self.code(texts)
        raw = [t.encode() for t in texts]
        ends = np.append(0, np.cumsum(self.lengths[ids]))[np.cumsum(sizes)]
        if (ends == np.cumsum([*map(len, raw)])).all() and b"".join(map(self.tokens.__getitem__, ids.tolist())) == b"".join(raw):
            return ids, sizes
        found = np.split(ids, np.cumsum(sizes)[:-1])
        found = [own if b"".join([self.tokens[i] for i in own.tolist()]) == t else np.array([-1], ids.dtype) for t, own in zip(raw, found)]
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))


@functools.lru_cache(maxsize=2)
def byte_level_coder(config: str) -> CheckedCoder:
    """A byte-level tokenizer of the tokenizers library, special tokens as plain text."""
    described = json.loads(config)
    letters = byte_of_letter()
    own = {i: bytes(letters[c] for c in entry) for entry, i in described["model"]["vocab"].items() if all(c in letters for c in entry)}
    return CheckedCoder(LibraryCoder(config, plain=True)._code, [own.get(i, b"") for i in range(max(own, default=-1) + 1)])


def space_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of texts and of runs of spaces."""
    cut = np.zeros(len(data), bool)
    cut[1:] = (data[1:] == _SPACE) & (data[:-1] != _SPACE)
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def text_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])


@functools.lru_cache(maxsize=2)
def piece_coder(model: bytes) -> CheckedCoder:
    """A piece tokenizer of the sentencepiece library that sets a space before a text.

    Merges join neighbours into pieces of the vocabulary. Where no piece holds a
    space behind another character, none runs over the start of spaces, and texts
    are coded in chunks that start there; else each text is coded whole.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = library.get_piece_size()
    pieces = [library.id_to_piece(i) for i in range(size)]
    tokens = [bytes([int(p[3:-1], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    alone = [pieces.index("▁")] if "▁" in pieces else [-1]

    def code(texts: list[str]) -> Coded:
        # The library puts the leading space back; of no text at all it makes no token.
        found = [ids if len(t) > 1 else alone for t, ids in zip(texts, library.encode([t[1:] for t in texts], num_threads=1))]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    crossing = any("▁" in p.lstrip("▁") for p in pieces)
    return CheckedCoder(code, tokens, cuts=text_starts if crossing else space_starts)


def gallop(drive: np.ndarray, into: np.ndarray) -> np.ndarray:
    """For each value of rising ``drive`` the first place of rising ``into`` that is not below it."""
    n, m = len(drive), len(into)
    place = np.zeros(n, np.int64)
    if not n:
        return place
    into = np.append(into, np.iinfo(np.int64).max)

    def search(values: np.ndarray, start: np.ndarray) -> np.ndarray:
        low, high = start - 1, start.copy()  # into[low] is below, into[high] is not once closed
        open_ = np.flatnonzero(into[high] < values)
        step = 1
        while len(open_):  # exponential: low moves up, the step doubles
            low[open_] = high[open_]
            high[open_] = np.minimum(low[open_] + step, m)
            open_ = open_[into[high[open_]] < values[open_]]
            step *= 2
        open_ = np.flatnonzero(high - low > 1)
        while len(open_):  # binary, between the last two steps
            mid = (low[open_] + high[open_]) // 2
            below = into[mid] < values[open_]
            low[open_] = np.where(below, mid, low[open_])
            high[open_] = np.where(below, high[open_], mid)
            open_ = open_[high[open_] - low[open_] > 1]
        return high

    place[:1] = search(drive[:1], np.zeros(1, np.int64))
    span = 1 << (n - 1).bit_length()
    while span > 1:
        at = np.arange(span // 2, n, span)
        place[at] = search(drive[at], place[at - span // 2])
        span //= 2
    return place


def common_ends(a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends both have; document i owns the ends up to ``upto[i]``.

    In every document the shorter list drives into the longer one.
    """
    n_a, n_b = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
    short_a = n_a <= n_b
    found = []
    for a_drives in (True, False):
        mine = short_a == a_drives
        at_a, at_b = np.flatnonzero(np.repeat(mine, n_a)), np.flatnonzero(np.repeat(mine, n_b))
        drive, into, at_drive, at_into = (a[at_a], b[at_b], at_a, at_b) if a_drives else (b[at_b], a[at_a], at_b, at_a)
        place = gallop(drive, into)
        hit = np.flatnonzero(place < len(into))
        hit = hit[into[place[hit]] == drive[hit]]
        pair = at_drive[hit], at_into[place[hit]]
        found.append(pair if a_drives else pair[::-1])
    one, two = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(one, kind="stable")
    return one[order], two[order]


def _lists(values: np.ndarray, upto: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), pa.array(values, pa.int32()))


def align_tokens(docs: DataFrame, byte_level_file: str, piece_file: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, ids_a, ids_b, upto_a, upto_b) of every whole text.

    A codes a space and the text by a byte-level tokenizer of the tokenizers
    library, B the text by a piece tokenizer that puts the space there itself; no
    special tokens. Group k holds the ids of A from ``upto_a[k - 1]`` up to before
    ``upto_a[k]`` and those of B likewise, and both are the same bytes. Null and
    empty texts, and texts that one of the two does not give back byte for byte,
    have empty lists. Rows are kept as they are, repeated ones and null ids too; an
    empty table gives an empty table; other columns are not read. The vocabulary
    files are of fixed size, read on the driver and sent once.
    """
    rows, kind, run = _aligner(docs, byte_level_file, piece_file, ident, text)
    return rows.mapInArrow(run, f"id {kind}, {_ALIGNED}").withColumnRenamed("id", ident)


_ALIGNED = ", ".join(f"{c} array<int>" for c in ("ids_a", "ids_b", "upto_a", "upto_b"))


def _aligner(docs: DataFrame, byte_level_file: str, piece_file: str, ident: str, text: str) -> tuple[DataFrame, str, Callable]:
    """(rows (id, text), type of the id, function over their batches)."""
    with open(byte_level_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level_coder(sent.value[0]), piece_coder(sent.value[1])
        for batch in batches:
            for at, end, data, offsets in text_slices(batch.column("text")):
                used = offsets[1:] > offsets[:-1]
                data = np.insert(data, offsets[:-1][used], _SPACE)
                offsets = offsets + np.append(0, np.cumsum(used))
                coded = []
                for coder in (one, two):
                    ids, upto = coder.encode(data, offsets)
                    coded.append((coder, ids, np.diff(upto, prepend=0)))
                rows = np.arange(end - at)
                wrong = np.concatenate([np.repeat(rows, n)[ids < 0] for _, ids, n in coded])
                fine = np.ones(len(rows), bool)
                fine[wrong] = False
                coded = [(coder.lengths, ids[np.repeat(fine, n)], np.cumsum(n * fine)) for coder, ids, n in coded]
                (_, ids_a, to_a), (_, ids_b, to_b) = coded
                ends_a, ends_b = (np.cumsum(lengths[ids]) for lengths, ids, _ in coded)
                i, j = common_ends(ends_a, ends_b, to_a, to_b)
                groups = np.searchsorted(i, to_a)  # a document's last end is a common one
                before_a, before_b = (np.repeat(np.append(0, to[:-1]), np.diff(groups, prepend=0)) for to in (to_a, to_b))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at, end - at), _lists(ids_a, to_a), _lists(ids_b, to_b),
                    _lists(i + 1 - before_a, groups), _lists(j + 1 - before_b, groups),
                ], ["id", "ids_a", "ids_b", "upto_a", "upto_b"])

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString(), run


@functools.lru_cache(maxsize=8)
def _numbers(size: int, end: bytes) -> np.ndarray:
    return np.array([b"%d%s" % (i, end) for i in range(size)], object)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, end of every row's list)."""
    lists = column.cast(pa.large_list(pa.int32()))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about TOKENS_AT_ONCE tokens, one row at least: a batch of rows has no size."""
    upto = np.append(0, np.cumsum(batch.column("ids_a").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + TOKENS_AT_ONCE, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


_DIGESTS = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (own for whole in batches for own in _runs(whole)):
        (a, to_a), (b, to_b), (up_a, groups), (up_b, _) = (_flat(batch.column(c)) for c in ("ids_a", "ids_b", "upto_a", "upto_b"))
        n_groups = np.diff(groups, prepend=0)
        upto_a, upto_b = (up + np.repeat(np.append(0, to[:-1]), n_groups) for up, to in ((up_a, to_a), (up_b, to_b)))
        size_a, size_b = (1 << max(10, int(x.max(initial=0)).bit_length()) for x in (a, b))
        # A token of A stands behind the tokens of B of earlier groups, one of B behind those of A of its own too.
        merged = np.empty(len(a) + len(b), object)
        place = np.arange(len(a)) + np.repeat(np.append(0, upto_b)[: len(upto_b)], np.diff(upto_a, prepend=0))
        merged[place] = _numbers(size_a, b",")[a]
        merged[place[upto_a - 1]] = _numbers(size_a, b"|")[a[upto_a - 1]]
        place = np.arange(len(b)) + np.repeat(upto_a, np.diff(upto_b, prepend=0))
        merged[place] = _numbers(size_b, b",")[b]
        merged[place[upto_b - 1]] = _numbers(size_b, b";")[b[upto_b - 1]]
        ends = (to_a + to_b).tolist()
        shas = [hashlib.sha256(b"".join(merged[x:y].tolist())[:-1]).hexdigest() if y > x else "" for x, y in zip([0, *ends], ends)]
        doc = np.repeat(np.arange(batch.num_rows), n_groups)
        key = (doc << 40) | (a[upto_a - 1] << 20) | b[upto_b - 1] if size_a <= 1 << 20 and size_b <= 1 << 20 and batch.num_rows < 1 << 23 else None
        if key is None:
            both = np.stack([doc, a[upto_a - 1], b[upto_b - 1]], 1)
            rows, times = np.unique(both, axis=0, return_counts=True)
            who, links = rows[:, 0], rows[:, 1] << 32 | rows[:, 2]
        else:
            key, times = np.unique(key, return_counts=True)
            who, links = key >> 40, (key >> 20 & 0xFFFFF) << 32 | key & 0xFFFFF
        upto = np.searchsorted(who, np.arange(batch.num_rows), "right")
        offsets = pa.array(np.append(0, upto), pa.int32())
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), *(pa.array(np.diff(x, prepend=0)) for x in (to_a, to_b, groups)), pa.array(shas, pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(links)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
        ], ["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])


def group_digests(aligned: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(ident, n_a, n_b, n_groups, groups_sha256, pairs, times) of ``align_tokens``.

    The digest is that of ``a1,a2|b1;a3|b2,b3``, all groups in order, and empty
    without tokens. ``pairs`` holds the distinct linked ids ``a << 32 | b`` of the
    document, those that end together, and ``times`` how often each is linked.
    """
    rows = aligned.select(F.col(ident).alias("id"), "ids_a", "ids_b", "upto_a", "upto_b")
    return rows.mapInArrow(_digest, f"id {rows.schema['id'].dataType.simpleString()}, {_DIGESTS}").withColumnRenamed("id", ident)


def alignment_digests(docs: DataFrame, byte_level_file: str, piece_file: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``group_digests`` of ``align_tokens``, with both in one Python worker."""
    rows, kind, run = _aligner(docs, byte_level_file, piece_file, ident, text)
    return rows.mapInArrow(lambda batches: _digest(run(batches)), f"id {kind}, {_DIGESTS}").withColumnRenamed("id", ident)


def pair_counts(digests: DataFrame) -> DataFrame:
    """(pair, links, best): how often ids are linked in all documents, and whether no
    other partner of the same B id is linked more often. One row per kind of pair,
    which vocabularies bound and documents do not."""
    cells = digests.select(F.inline(F.arrays_zip("pairs", "times")))
    counts = cut_lineage(cells.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def link_scores(digests: DataFrame) -> DataFrame:
    """``digests`` with n_links, n_best (links whose pair is a best one) and count_sum (the
    corpus-wide links of every link's pair, summed); other columns stay.

    The digests are written once. The counts of pairs are sent to all tasks up to
    BROADCAST_PAIRS kinds, else joined by shuffle; a document's cells lie together,
    so they are added up before the shuffle.
    """
    row = free_name(digests, "_row")
    kept = cut_lineage(digests.withColumn(row, F.monotonically_increasing_id()))
    counts = cut_lineage(pair_counts(kept))
    near = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    cells = kept.select(row, F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = cells.join(near, "pair").groupBy(row).agg(
        F.sum(F.col("times").cast("long")).alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0).cast("long")).alias("n_best"),
        F.sum(F.col("times") * F.col("links")).alias("count_sum"),
    )
    names = ["n_links", "n_best", "count_sum"]
    joined = kept.drop(*names).join(sums, row, "left").drop(row)
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in names})
