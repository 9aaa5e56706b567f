"""Corpus pipeline: from raw documents to token ids.

Each stage is ``f(spark, docs, sf_dir)`` over all that the stage before kept; its
result is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from strandwork.llm.byte_bpe import decode, encode
from strandwork.llm.decontaminate import drop_contaminated
from strandwork.llm.exact_dedup import drop_exact_copies
from strandwork.llm.jaccard_join import Rule, drop_near_duplicates
from strandwork.llm.queries import TOXIC_FROM
from strandwork.llm.registry import table
from strandwork.llm.rows import free_name, text_of
from strandwork.llm.toxicity import fit_toxicity, score_toxicity
from strandwork.session import scratch_folder

#: No stage's method can be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def toxicity(spark, docs, sf_dir):
    """Texts scored toxic go; the lexicon is learned from the labels of these documents."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return score_toxicity(docs, model, out=score).filter(F.col(score) < TOXIC_FROM).drop(score)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the row with the largest id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark, docs, sf_dir):
    """Of documents that links of five-word shingles, similarity 0.8 and more, join,
    the one with the least id stays."""
    return drop_near_duplicates(docs, Rule(words=5, num=8, den=10))


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item, to four fifths of its words or more, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark, docs, sf_dir):
    """Token ids of every text, and whether they decode to it."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    back = decode(coded, ranks)
    same = F.col("decoded") == text_of().cast("binary")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]


def run(spark, sf_dir):
    """The rows of the last stage; what a stage keeps lies in the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
