"""Byte-level BPE from a rank file: encoding by a segment tree, and decoding.

A piece of text is a row of byte positions. A segment tree over them holds, for
every live position, the rank of the pair it starts, so its root is the leftmost
pair of least rank. A merge writes three leaves (the merged position, the one
it swallowed, the one before) and climbs from each to the root. Many pieces of
like width are merged side by side, one merge each per round.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import ChunkCoder
from .words import text_slices

#: Leaves that are merged side by side.
LEAVES_AT_ONCE = 1 << 19
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Tokens, their ids and every pair of tokens that makes a third."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line)}
        self.ids = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], _NONE)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged token, -1 where the pair makes none."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of every piece in them, its number of ids); a piece that is a token stays whole."""
        whole = np.fromiter((self.ids.get(p, -1) for p in pieces), np.int64, len(pieces))
        sizes = (whole >= 0).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = [whole[whole >= 0].astype(np.int32)]
        held = len(flat[0])
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        todo = np.flatnonzero((whole < 0) & (lengths > 0))
        widths = np.left_shift(1, np.ceil(np.log2(np.maximum(lengths[todo], 1))).astype(np.int64))
        for width in np.unique(widths).tolist():
            members = todo[widths == width]
            step = max(1, LEAVES_AT_ONCE // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                ids, counts = self._merge([pieces[i] for i in part], width)
                starts[part], sizes[part] = held + np.cumsum(counts) - counts, counts
                flat.append(ids)
                held += len(ids)
        return np.concatenate(flat), starts, sizes

    def _merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        live = np.arange(width) < sizes[:, None]
        ids = np.full((rows, width), -1, np.int64)
        ids[live] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        if (ids[live] < 0).any():
            raise ValueError("the vocabulary lacks a single byte of the text")
        following = np.where(live, np.minimum(np.arange(1, width + 1), sizes[:, None]), 0)
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        bits = width.bit_length()
        tree = np.full((rows, 2 * width), _NONE, np.int64)
        first = self.pair_rank(ids[:, :-1], ids[:, 1:])
        tree[:, width : 2 * width - 1] = np.where((first >= 0) & live[:, 1:], first << bits | np.arange(width - 1), _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            root = tree[row, 1]
            at = root & ((1 << bits) - 1)
            ids[row, at] = root >> bits
            gone = following[row, at]
            after = following[row, gone]
            following[row, at] = after
            live[row, gone] = False
            more = after < sizes[row]
            before[row[more], after[more]] = at[more]
            tree[row, width + gone] = _NONE
            rank = np.full(len(row), -1, np.int64)
            rank[more] = self.pair_rank(ids[row[more], at[more]], ids[row[more], after[more]])
            tree[row, width + at] = np.where(rank >= 0, rank << bits | at, _NONE)
            left = before[row, at]
            has = left >= 0
            rank = self.pair_rank(ids[row[has], left[has]], ids[row[has], at[has]])
            tree[row[has], width + left[has]] = np.where(rank >= 0, rank << bits | left[has], _NONE)
            for leaf, of in ((gone, row), (at, row), (left[has], row[has])):
                node = (width + leaf) >> 1
                for _ in range(bits - 1):
                    tree[of, node] = np.minimum(tree[of, 2 * node], tree[of, 2 * node + 1])
                    node >>= 1
            row = row[tree[row, 1] < _NONE]
        return ids[live].astype(np.int32), live.sum(1)


@functools.lru_cache(maxsize=2)
def _vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


@functools.lru_cache(maxsize=2)
def _coder(raw: bytes, pattern: str) -> ChunkCoder:
    import regex

    vocabulary, cutter = _vocabulary(raw), regex.compile(pattern)

    def code(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, number = [], []
        for text in texts:
            before = len(pieces)
            pieces += [m.encode() for m in cutter.findall(text)]
            number.append(len(pieces) - before)
        ids, starts, sizes = vocabulary.encode_pieces(pieces)
        upto = np.cumsum(sizes)
        order = np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)
        return ids[order], np.diff(np.append(0, upto)[np.append(0, np.cumsum(number))])

    return ChunkCoder(code)


def _with_field(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(*[c for c in df.columns if c.lower() == name.lower()])
    return kept, T.StructType([*kept.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """``df`` with ``out`` array<int>: the token ids of every whole text.

    ``rank_file`` has one base64 token and its rank a line and is read on the
    driver (a vocabulary is of fixed size); ``pattern`` cuts a text into pieces
    that are merged separately. Null and empty texts have no ids. A column with
    the name of ``out`` is replaced, other columns pass; rows are independent,
    so repeated rows and an empty table need no rule.
    """
    with open(rank_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    source, target = df, out
    if out.lower() == text.lower():
        raise ValueError("the ids need a column of their own")
    kept, schema = _with_field(source, target, T.ArrayType(T.IntegerType()))
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value, pattern)
        for batch in batches:
            column = batch.column(text)
            for a, b, data, offsets in text_slices(column):
                ids, ends = coder.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
                part = batch.slice(a, b - a)
                columns = {n: part.column(n) for n in schema.names[:-1]}
                yield pa.RecordBatch.from_pydict({**columns, target: lists})

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` with ``out`` binary: the bytes that the ids stand for.

    A null list has no bytes and null ids inside a list stand for none; an id
    outside the vocabulary is an error.
    """
    with open(rank_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    if out.lower() == ids.lower():
        raise ValueError("the bytes need a column of their own")
    kept, schema = _with_field(df, out, T.BinaryType())
    if not keep_ids:
        schema = T.StructType([f for f in schema.fields if f.name != ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _vocabulary(raw.value).tokens.__getitem__
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [b"".join([token(i) for i in row if i is not None]) if row else b"" for row in part.column(ids).to_pylist()]
                columns = {n: part.column(n) for n in schema.names[:-1]}
                yield pa.RecordBatch.from_pydict({**columns, out: pa.array(found, pa.binary())})

    return kept.mapInArrow(run, schema)
