"""Gating, resumable runs, plans and plan shapes."""

import hashlib
import io
import pathlib
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandwork.operators import joins, models
from strandwork.plans import fasta_report, screening
from strandwork.streaming import increment


def digest(folder):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in sorted(pathlib.Path(folder).rglob("*.parquet"))}


def test_resumable_run(spark, tmp_path):
    schema = "chunk_id string, v long"
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    stages = {"sum": lambda df: df.groupBy("chunk_id").agg(F.sum("v").alias("s"))}
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], schema).coalesce(1).write.parquet(src)
    increment.run_increment(spark, src, schema, out, cp, stages)
    before = digest(tmp_path / "out" / "data")
    spark.createDataFrame([("c", 7)], schema).coalesce(1).write.mode("append").parquet(src)
    increment.run_increment(spark, src, schema, out, cp, stages)
    after = digest(tmp_path / "out" / "data")
    assert all(after[k] == v for k, v in before.items()) and len(after) > len(before)
    got = {r["chunk_id"]: r["s"] for r in increment.stage_output(spark, out, "sum", "s long, chunk_id string").collect()}
    assert got == {"a": 3, "b": 5, "c": 7}
    rows = spark.createDataFrame([("a", 10), ("b", 1)], schema)
    increment.run_increment(spark, src, schema, out, str(tmp_path / "cp2"), stages)  # the same files: untouched
    assert digest(tmp_path / "out" / "data") == after
    increment.run_stage(rows, out, "sum", stages["sum"], force=True, only="a")
    got = {r["chunk_id"]: r["s"] for r in increment.stage_output(spark, out, "sum", "s long, chunk_id string").collect()}
    assert got == {"a": 10, "b": 5, "c": 7}


def test_late_rows_and_empty_results(spark, tmp_path):
    schema = "chunk_id string, v long"
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    stages = {"sum": lambda df: df.filter("v > 0").groupBy("chunk_id").agg(F.sum("v").alias("s"))}
    spark.createDataFrame([("a", 1), ("b", 5)], schema).coalesce(1).write.parquet(src)
    increment.run_increment(spark, src, schema, out, cp, stages)
    spark.createDataFrame([("a", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    increment.run_increment(spark, src, schema, out, cp, stages)
    read = lambda: {r["chunk_id"]: r["s"] for r in increment.stage_output(spark, out, "sum", "s long, chunk_id string").collect()}
    assert read() == {"a": 3, "b": 5}
    with pytest.raises(ValueError):  # a new file of a finished chunk, without the others
        increment.run_stage(spark.createDataFrame([("a", 4, "x")], schema + ", source string"), out, "sum", stages["sum"])
    increment.run_stage(spark.createDataFrame([("a", -1)], schema), out, "sum", stages["sum"], force=True)
    assert read() == {"b": 5}


def test_a_failing_forced_run_keeps_the_former_output(spark, tmp_path):
    schema, out = "chunk_id string, v long", str(tmp_path / "out")
    total = lambda df: df.groupBy("chunk_id").agg(F.sum("v").alias("s"))
    read = lambda: {r["chunk_id"]: r["s"] for r in increment.stage_output(spark, out, "sum", "s long, chunk_id string").collect()}
    rows = spark.createDataFrame([("a", 1), ("b/ c", 5)], schema)
    increment.run_stage(rows, out, "sum", total)
    fails = lambda df: total(df).withColumn("s", F.when(F.col("chunk_id") == "b/ c", F.raise_error(F.lit("stop"))).otherwise(F.col("s")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        increment.run_stage(rows, out, "sum", fails, force=True)
    assert read() == {"a": 1, "b/ c": 5}
    assert increment.finished_chunks(spark, out, "sum").count() == 0
    increment.run_stage(spark.createDataFrame([("a", 10), ("b/ c", 7)], schema), out, "sum", total)  # a plain run takes them up
    assert read() == {"a": 10, "b/ c": 7} and increment.finished_chunks(spark, out, "sum").count() == 2
    increment.remove_old_runs(spark, out, "sum")
    assert read() == {"a": 10, "b/ c": 7} and len(list((tmp_path / "out" / "data" / "stage=sum").glob("run=*"))) == 1


def test_gate_statuses(spark):
    rows = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "row_id long, valid boolean")

    def screen(odd):
        return lambda df: df.withColumn("passed", (F.col("row_id") % 2 == odd).cast("int"))

    out = screening.candidate_gate(rows, screen(1), lambda df: df.select("row_id", F.lit(1.0).alias("vec")), mode="embed")
    got = {r["row_id"]: r["embed_status"] for r in out.collect()}
    assert got == {1: "completed", 2: "not_applicable", 3: "completed", 4: "invalid_input"}
    none = screening.candidate_gate(rows, screen(5), lambda df: df.select("row_id", F.lit(1.0).alias("vec")), mode="embed")
    assert none.filter("embed_status = 'completed'").count() == 0 and none.count() == 4
    with pytest.raises(ValueError):
        screening.check_mode("annotate", True, False)


def test_head_training_keeps_the_best_epoch(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (3, 6))
    rows = [(i, (centres[i % 3] + rng.normal(0, 0.2, 6)).tolist(), "abc"[i % 3]) for i in range(150)] + [(900, [1.0] * 6, None), (901, [1.0] * 6, "rare")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string").repartition(5)
    head, classes, curve = models.head_training(df, "id", "label", epochs=12)
    got = curve.orderBy("epoch").collect()
    assert classes[:3] == ["a", "b", "c"] and len(got) == 12 and sum(r.chosen for r in got) == 1
    best = max(r.valid_accuracy for r in got)
    assert best >= 0.9 and next(r for r in got if r.valid_accuracy == best).chosen and got[-1].train_loss < got[0].train_loss
    x, y = rng.normal(0, 1, (7, 6)), np.arange(7) % 3
    flat = np.concatenate([w.ravel() for w in head.weights])
    loss, gradient = head.gradient(x, y)
    for i in (0, 5, len(flat) - 1):  # the gradient against a difference
        other = flat.copy()
        other[i] += 1e-6
        head.weights = head.unpack(other)
        assert (head.gradient(x, y)[0] - loss) / 1e-6 == pytest.approx(gradient[i], abs=1e-3)
    assert models.head_training(df.limit(0), "id", "label")[2].count() == 0


def test_report_chain(spark):
    records = spark.createDataFrame([(1, "alpha x", "AAAA"), (2, "beta", "CCCCA"), (3, "beta", "CAC")], "record_index long, header string, sequence string")
    manifest, _ = fasta_report.prepare(records)

    def encode(batches):
        for b in batches:
            for _, r in b.iterrows():
                yield pd.DataFrame({"Seq_ID": r["Seq_ID"], "token_idx_in_sequence": range(len(r["seq"])), "vec": [[1.0, 0.1] if c == "A" else [0.1, 1.0] for c in r["seq"]]})

    refs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "ref_id long, vec array<double>")
    labels = spark.createDataFrame([(0, 3), (1, 8)], "ref_id long, label int")
    out = fasta_report.annotate(
        manifest, lambda m: m.select("Seq_ID", "seq").mapInPandas(encode, "Seq_ID string, token_idx_in_sequence int, vec array<double>"),
        refs, labels, refs, labels, k=1,
    )
    assert out["tokens"].count() == 12
    got = {r["Seq_ID"]: (r["Pred_Label"], r["top_label"], r["mapped_tokens"]) for r in out["report"].collect()}
    assert got == {"alpha": (3, 3, 4), "beta": (8, 8, 5), "beta__dup002": (8, 8, 3)}


def plan_of(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_nested_loops(spark):
    t = spark.range(100).select("id", (F.col("id") * 3).alias("t"))
    iv = spark.range(10).select(F.col("id").alias("s"), (F.col("id") * 30).alias("a"), (F.col("id") * 30 + 30).alias("b"))
    pts = spark.range(20).select("id", F.lit(1).alias("chain"), F.col("id").alias("label_seq"), *[F.col("id").cast("double").alias(c) for c in "xyz"])
    for df in (joins.interval_join(t, "t", iv, "a", "b", 16), joins.contact_pairs(pts, 2.0), joins.pair_join(pts, "id")):
        text = plan_of(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert joins.interval_join(t, "t", iv, "a", "b", 16).count() == 100
