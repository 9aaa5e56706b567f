"""Sequence input rules on literal cases."""

import gzip

import pytest
from strandwork.functions.text import strict_sequence, structured_id
from strandwork.operators import checks, clean
from strandwork.plans import fasta_report
from strandwork.sources import readers, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_rules(spark, tmp_path):
    p = write(tmp_path / "a.fasta", "; note\n\n>alpha first record\nACD-\n# skip\nEF?\n>duplicate second record\nMNPQ\n>duplicate third record\nAAAA\n")
    got = [tuple(r) for r in readers.fasta_scan(spark, p).orderBy("record_index").collect()]
    assert got == [(1, "alpha first record", "ACD-EF?"), (2, "duplicate second record", "MNPQ"), (3, "duplicate third record", "AAAA")]


def test_fasta_gzip_and_many_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.fasta.gz", "wt") as f:
        f.write(">x\nAC\nDE\n")
    write(tmp_path / "b.fasta", ">y z\nGG\n")
    got = [tuple(r) for r in readers.fasta_scan(spark, str(tmp_path)).orderBy("record_index").collect()]
    assert got == [(1, "x", "ACDE"), (2, "y z", "GG")]


def test_fasta_errors(spark, tmp_path):
    with pytest.raises(Exception, match="before header"):
        readers.fasta_scan(spark, write(tmp_path / "bad.fasta", "ACDE\n>x\nAC\n")).collect()
    with pytest.raises(Exception, match="no FASTA records"):
        readers.fasta_scan(spark, write(tmp_path / "empty.fasta", "\n; only a note\n"))


def test_report_preparation(spark, tmp_path):
    p = write(tmp_path / "a.fasta", ">alpha first\nACD-EF?\n>duplicate second\nMNPQ\n>duplicate third\nAAAA\n>empty\n \n")
    manifest, dropped = fasta_report.prepare(readers.fasta_scan(spark, p), max_n=2)
    rows = manifest.orderBy("record_index").collect()
    assert [r["Seq_ID"] for r in rows] == ["alpha", "duplicate", "duplicate__dup002"]
    assert [r["seq"] for r in rows] == ["ACDXEFX", "MNPQ", "AAAA"]
    assert [(r["chunk_id"], r["sequence_index_in_chunk"]) for r in rows] == [("chunk_00001", 1), ("chunk_00001", 2), ("chunk_00002", 1)]
    assert sum(r["aa_len"] for r in rows) == 15
    assert [r["drop_reason"] for r in dropped.collect()] == ["empty_sequence_after_cleaning"]


def test_strict_check(spark):
    df = spark.createDataFrame([(" acd eF*",), ("",), ("AC-D",), ("AC*D",), ("*",)], "s string")
    got = [tuple(r) for r in df.select(strict_sequence("s").alias("r")).select("r.*").collect()]
    assert got == [
        ("ACDEF", None, True), ("", "empty_sequence", False), ("AC-D", "invalid_characters:-", False),
        ("AC*D", "invalid_characters:*", False), ("", "empty_sequence", True),
    ]


def test_id_collision_trap(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A__dup002"), (4, "seq_000000001")], "record_index long, Seq_ID string")
    ids = [r["Seq_ID"] for r in clean.dedupe_ids(df).orderBy("record_index").collect()]
    assert ids == ["A", "A__dup002", "A__dup002", "seq_000000001"]  # kept as in the contract, reported by a check
    assert checks.unique_key(clean.dedupe_ids(df), "Seq_ID").count() == 1
    internal = [r["internal_id"] for r in clean.internal_ids(df, ["record_index"]).orderBy("record_index").collect()]
    assert internal == [f"seq_{i:09d}" for i in range(1, 5)]


def test_csv_columns(spark, tmp_path):
    p = write(tmp_path / "a.csv", "Name,SEQUENCE\nn1,ac d\n,MK\nn3,\n")
    assert [tuple(r) for r in readers.csv_sequence_scan(spark, p).collect()] == [("n1", "ACD"), ("row_1", "MK")]
    with pytest.raises(ValueError, match="missing required column"):
        readers.csv_sequence_scan(spark, p, seq_col="protein", id_col="nope")


def test_fasta_round_trip_wraps(spark, tmp_path):
    df = spark.createDataFrame([("a", "A" * 160), ("b", "C" * 81)], "id string, seq string")
    writers.fasta_sink(df, str(tmp_path / "out"), "id", "seq", order="id")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert max(len(x) for x in lines) == 80 and len(lines) == 6
    back = readers.fasta_scan(spark, str(tmp_path / "out")).orderBy("record_index").collect()
    assert [(r["header"], r["sequence"]) for r in back] == [("a", "A" * 160), ("b", "C" * 81)]


def test_structured_id(spark):
    df = spark.createDataFrame([("1abc_2_Chain",), ("1abc_12_Chains",), ("zz_1_Chain",)], "i string")
    assert [tuple(r["s"]) for r in df.select(structured_id("i").alias("s")).collect()] == [("1abc", 2), ("1abc", 12), (None, None)]


def test_checks_enforce(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="duplicate_key"):
        checks.enforce(checks.unique_key(df, "k"))
    sim = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.4), (1, 1, 1.0)], "i int, j int, sim double")
    assert checks.symmetric_matrix(sim).count() == 2
    parts = spark.createDataFrame([(1, 60.0, 40.0), (2, 60.0, 30.0)], "k int, a double, b double")
    assert [r["key"] for r in checks.parts_sum(parts, "k", ["a", "b"]).collect()] == ["2"]
