"""Token-id files: Simple-8b words with block offsets, written and read by Spark.

A file is a Parquet part of chunks in ascending order of the documents. A chunk
row holds

- ``part``, ``chunk``: its place; files are ordered by ``part``, rows by ``chunk``;
- ``docs``, ``sizes``: the ids of its documents and the token ids of each;
- ``words``: little-endian 64-bit words. The upper four bits are a selector that
  says how many token ids of how many bits follow, the lowest first;
- ``blocks``: the first word of every block of ``BLOCK`` token ids, so that blocks
  can be read apart;
- ``escapes``: ids of more than 60 bits, as 64-bit words. A word with the escape
  selector stands for one id and holds its place there.

Spark's writer commits whole files, so a task that runs again leaves no halves.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkCoder
from .rows import text_of
from .words import text_slices

BLOCK = 128
#: Texts that the tokenizers library codes in one call.
TEXTS_AT_ONCE = 4096
#: Chunks that a worker remembers of one tokenizer.
REMEMBERED = 900_000
# Fixed values of the coding: ids per word and bits per id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60])
ESCAPE = 15
_SELECTOR_OF = {int(c): s for s, c in enumerate(COUNTS[:14])}
FILE_SCHEMA = "part int, chunk long, docs array<long>, sizes array<long>, words binary, blocks array<long>, escapes binary, n_ids long"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of every block, escapes) of unsigned ids below 2^64.

    The longest run that fits a word is found for every place at once, ids beyond the
    block counting as none; then all blocks go from word to word side by side.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    big = ids >> np.uint64(32)
    bits = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    if big.any():
        bits = np.where(big > 0, np.frexp(big.astype(np.float64))[1] + 32, bits)
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    rows = np.zeros((len(at), BLOCK + 59), np.int8)
    rows[:, :BLOCK] = np.append(bits.astype(np.int8), np.zeros(len(at) * BLOCK - n, np.int8)).reshape(-1, BLOCK)
    widest, best = rows[:, :BLOCK].copy(), np.full((len(at), BLOCK), ESCAPE, np.int8)
    for run in range(1, 61):
        np.maximum(widest, rows[:, run - 1 : run - 1 + BLOCK], out=widest)
        selector = _SELECTOR_OF.get(run)
        if selector is not None:
            best[widest <= WIDTHS[selector]] = selector
    best = best.reshape(-1)
    upto = np.arange(len(best)) + COUNTS[best]
    steps = []
    while len(at):
        steps.append(at)
        at = upto[at]
        more = at < ends
        at, ends = at[more], ends[more]
    start = np.sort(np.concatenate(steps))
    selector = best[start].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    count, width = np.diff(np.append(start, n)), WIDTHS[selector]
    live = np.flatnonzero(selector != ESCAPE)
    for k in range(int(count.max())):
        live = live[count[live] > k]
        words[live] |= ids[start[live] + k] << (width[live] * k).astype(np.uint64)
    wide = np.flatnonzero(selector == ESCAPE)
    words[wide] |= np.arange(len(wide)).astype(np.uint64)
    return words, np.searchsorted(start, np.arange(0, n, BLOCK)), ids[start[wide]]


def unpack(words: np.ndarray, blocks: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids that ``pack`` was given; ``blocks`` may begin anywhere in a longer file."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    block = np.searchsorted(blocks, np.arange(len(words)), "right") - 1
    count = COUNTS[selector]
    upto = np.cumsum(count)
    before = upto - count - (upto - count)[blocks[block]]  # ids of the block before this word
    size = np.minimum(BLOCK, n - block * BLOCK)
    count = np.minimum(count, size - before)
    start = block * BLOCK + before
    out = np.zeros(n, np.uint64)
    for k in range(int(count.max()) if len(count) else 0):
        has = count > k
        width = WIDTHS[selector[has]]
        value = (words[has] >> (width * k).astype(np.uint64)) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))
        out[start[has] + k] = value
    wide = selector == ESCAPE
    if wide.any():
        out[start[wide]] = escapes[(words[wide] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


class LibraryCoder:
    """A byte-level tokenizer of the tokenizers library behind remembered chunks.

    Names of special tokens in a text become their one id, as the library does by
    default, or with ``plain`` are ordinary text. A chunk may cut such a name, so
    texts that hold one are coded whole.
    """

    def __init__(self, config: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task is one thread
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(config)
        self.library.encode_special_tokens = plain
        self.names = [] if plain else [t["content"].encode() for t in json.loads(config)["added_tokens"]]
        self.chunks = ChunkCoder(self._code, remembered=REMEMBERED)

    def _code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The library's own record of a text is far larger than its ids.
        found = [e.ids for at in range(0, len(texts), TEXTS_AT_ONCE) for e in self.library.encode_batch_fast(texts[at : at + TEXTS_AT_ONCE], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids up to the end of each text)."""
        raw = data.tobytes() if self.names else b""
        whole = sorted({int(np.searchsorted(offsets, m.start(), "right")) - 1 for name in self.names if name in raw for m in re.finditer(re.escape(name), raw)})
        if not whole:
            return self.chunks.encode(data, offsets)
        lengths = np.diff(offsets)
        kept = np.ones(len(lengths), bool)
        kept[whole] = False
        rest, upto = self.chunks.encode(data[np.repeat(kept, lengths)], np.append(0, np.cumsum(lengths * kept)))
        ids, sizes = self._code([raw[offsets[i] : offsets[i + 1]].decode() for i in whole])
        parts = np.split(rest, upto[:-1])
        for i, own in zip(whole, np.split(ids, np.cumsum(sizes)[:-1])):
            parts[i] = own
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


@functools.lru_cache(maxsize=2)
def library_coder(config: str, plain: bool = False) -> LibraryCoder:
    return LibraryCoder(config, plain)


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, ident: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the files at ``path``.

    ``tokenizer_file`` is a byte-level tokenizer of the tokenizers library; its
    fixed-size description is read on the driver and sent once. Names of special
    tokens in a text become their ids, as in the library. Null texts are empty and
    give the end id alone. Null ids come first; rows of one id follow
    the hash of their text. An empty table gives no chunk.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())
    order = [F.col("id").asc_nulls_first(), F.xxhash64("t")]
    rows = docs.select(F.col(ident).cast("long").alias("id"), text_of(text).alias("t"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, chunk = library_coder(config.value), 0
        for batch in batches:
            part, column, ids = batch.column("part"), batch.column("t"), batch.column("id")
            for a, b, data, offsets in text_slices(column):
                found, upto = coder.encode(data, offsets)
                flat = np.insert(found, upto, end_id)
                sizes = np.diff(upto, prepend=0) + 1
                words, blocks, escapes = pack(flat)
                yield pa.RecordBatch.from_pydict({
                    "part": part.slice(a, 1).cast(pa.int32()), "chunk": pa.array([chunk], pa.int64()),
                    "docs": pa.array([ids.slice(a, b - a).to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()), "blocks": pa.array([blocks], pa.list_(pa.int64())),
                    "escapes": pa.array([escapes.astype("<u8").tobytes()], pa.binary()), "n_ids": pa.array([len(flat)], pa.int64()),
                })
                chunk += 1

    rows.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files.

    ``start`` counts the ids of all documents before it. Totals are summed inside
    each file and then over the files, one row per file.
    """
    chunks = read_chunks(spark, path)
    fields = "part int, chunk long, at long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["blocks"], np.int64), np.frombuffer(row["escapes"], "<u8"), row["n_ids"])
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                starts = ends - row["sizes"]
                four = memoryview(ids.astype("<u4").tobytes())
                columns = {
                    "part": pa.array([row["part"]] * len(ends), pa.int32()), "chunk": pa.array([row["chunk"]] * len(ends), pa.int64()), "at": pa.array(starts),
                    "doc_id": pa.array(row["docs"], pa.int64()), "n_tokens": pa.array(row["sizes"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(four[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    rows = chunks.mapInArrow(run, fields)
    sizes = chunks.select("part", "chunk", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per file: small whatever the number of documents.
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n_ids")
    firsts = sizes.withColumn("first", inside).join(parts, "part").select("part", "chunk", (F.col("first") + F.col("before")).alias("first"))
    out = rows.join(firsts, ["part", "chunk"])
    return out.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
