"""The texts of exact dedup are moved by one join."""

from strandwork.llm import exact_dedup


def test_texts_are_joined_once(spark, monkeypatch):
    seen = []
    kept = exact_dedup.cut_lineage
    monkeypatch.setattr(exact_dedup, "cut_lineage", lambda df: seen.append(df) or kept(df))
    docs = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "ab"), (4, None), (5, ""), (6, "a" * 70 + "b"), (7, "a" * 70 + "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["copies"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (1, 3, True), 4: (2, 5, False), 5: (2, 5, True), 6: (1, 6, True), 7: (1, 7, True)}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
