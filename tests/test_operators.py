"""Votes, sampling, statistics, graphs and models against brute force."""

import hashlib
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.catalog import aggregates, graphs
from strandwork.functions.stats import chi2_sf_even
from strandwork.operators import aggregate, clean, encoding, graph, joins, models, neighbours, nulls, sampling, statistics
from strandwork.operators.aggregate import pair_cosine


def vec_frame(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, vec array<double>")


def test_votes_differ_in_noise_and_ties(spark):
    n = spark.createDataFrame(
        [(1, 1, 10, 0.9, -1), (1, 2, 11, 0.8, 5), (1, 3, 12, 0.8, 2), (1, 4, 13, 0.5, -1), (2, 1, 14, 0.3, -1)],
        "query_id long, rank int, ref_id long, sim double, label int",
    )
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    seq = {r["query_id"]: (r["pred_label"], r["confidence"]) for r in neighbours.vote_sequence(n, q).collect()}
    tok = {r["query_id"]: (r["pred_label"], r["confidence"]) for r in neighbours.vote_token(n, q).collect()}
    assert seq[1] == (5, pytest.approx(0.5)) and tok[1] == (2, pytest.approx(0.5))  # first met against lowest label
    assert seq[2] == (-1, 0.0) == tok[3]


def test_blocked_topk_matches_full_product(spark):
    x = np.random.default_rng(1).normal(size=(90, 6))
    got = neighbours.exact_cosine_topk(vec_frame(spark, x, "query_id"), vec_frame(spark, x, "ref_id"), 5, block_rows=20)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(i, r + 1): int(j) for i in range(90) for r, j in enumerate(np.argsort(-s[i], kind="stable")[:5])}
    assert {(r["query_id"], r["rank"]): r["ref_id"] for r in got.collect()} == want


def test_cell_search_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 6))[rng.integers(0, 8, 200)] + 0.05 * rng.normal(size=(200, 6))
    q, r = vec_frame(spark, x, "query_id"), vec_frame(spark, x, "ref_id")
    found = neighbours.ivf_search(q, r, 5, nlist=8, nprobe=4)
    assert neighbours.recall_at_k(found, neighbours.exact_cosine_topk(q, r, 5)).first()[0] > 0.95


def test_encoder_forms_agree(spark):
    x = np.random.default_rng(3).normal(size=(20, 5))
    w, b = np.random.default_rng(4).normal(size=(5, 9)), np.linspace(-0.2, 0.2, 9)
    df = vec_frame(spark, x, "row_id")
    a = encoding.topk_sparse_encode(df, w, b, np.zeros(5), np.ones(5), 3)
    cells = df.select("row_id", F.posexplode("vec").alias("dim", "x"))
    weights = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(5) for j in range(9)], "dim int, feature int, w double")
    bias = spark.createDataFrame([(j, float(b[j])) for j in range(9)], "feature int, b double")
    c = encoding.topk_sparse_encode_joined(cells, weights, bias, 3)

    def rows(t):
        return sorted((r["row_id"], r["feature"], round(r["value"], 9)) for r in t.collect())

    assert rows(a) == rows(c)


def test_grouped_folds_is_greedy(spark):
    rng = np.random.default_rng(5)
    sizes = {f"c{i:02d}": int(s) for i, s in enumerate(rng.integers(1, 6, 40))}
    sizes["big"] = 60
    df = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)], "cluster string")
    got = {r["cluster"]: r["fold"] for r in sampling.grouped_folds(df, "cluster", 4).select("cluster", "fold").distinct().collect()}
    loads, want = [0] * 4, {}
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        f = min(range(4), key=lambda i: (loads[i], i))
        want[c], loads[f] = f + 1, loads[f] + sizes[c]
    assert got == want
    with pytest.raises(ValueError):
        sampling.grouped_folds(df, "cluster", 100)


def test_kfold_needs_enough_rows(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(22)], "id long, y string")
    with pytest.raises(Exception, match="fewer rows"):
        sampling.stratified_kfold(df, "id", "y", 5).collect()


def test_block_quotas_sum():
    assert sum(q for _, q in sampling.block_quotas(1003, 250, 100)) == 250


def test_permutation_against_enumeration(spark, monkeypatch):
    a, b = [1.0, 2.0, 4.0, 7.0], [3.0, 8.0, 9.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "cat string, v double")
    pool, obs = a + b, abs(np.mean(a) - np.mean(b))
    hits = [abs(np.mean([pool[i] for i in s]) - np.mean([pool[i] for i in range(8) if i not in s])) >= obs - 1e-12 for s in itertools.combinations(range(8), 4)]
    first = None
    for piece in (2048, 3):  # one piece of ranks, then several: the same shuffles
        monkeypatch.setattr(statistics, "PIECE_RANKS", piece)
        got = statistics.permutation_test(df, "cat", "v", [("a", "b"), ("a", "none")], 4000).collect()
        assert len(got) == 1 and (first := first or got) == got
        got = got[0]
        assert got["p_value"] == pytest.approx(np.mean(hits), abs=0.03)
        assert got["observed_mean_diff"] == pytest.approx(np.mean(a) - np.mean(b))


def test_shuffles_are_bijections_and_even():
    for n in (1, 2, 7, 100):
        keys = statistics.shuffle_keys([f"s{i}" for i in range(400)], n)
        places = statistics.shuffled_ranks(np.arange(n), n, keys)
        assert (np.sort(places, axis=1) == np.arange(n)).all()
    seen = np.bincount(places[:, 0], minlength=100)  # rank 0 goes everywhere: chi-square of 99 degrees
    assert ((seen - 4) ** 2 / 4).sum() < 150
    assert abs(np.corrcoef(places[:, 3], places[:, 4])[0, 1]) < 0.2


def test_fisher_and_chi_square_tails(spark):
    df = spark.createDataFrame([(1, 0.01), (1, 0.2), (1, None), (2, None)], "g int, p double")
    got = {r["g"]: r["p_combined"] for r in statistics.fisher_combine(df, "p", ["g"]).collect()}
    h = -math.log(0.01) - math.log(0.2)
    assert got[1] == pytest.approx(math.exp(-h) * (1 + h)) and math.isnan(got[2])
    x = spark.createDataFrame([(0.5,), (3.841458820694124,), (30.0,)], "x double").select("x", statistics.chi2_sf_one(F.col("x")).alias("p"))
    for r in x.collect():
        assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["x"] / 2)), rel=1e-6)


def test_rarefaction_forms_agree(spark):
    df = spark.createDataFrame([(i, f"c{int(math.sqrt(i))}") for i in range(120)], "id long, cluster string")
    sizes = df.groupBy("cluster").agg(F.count("*").alias("members"))
    exact = {r["sample_size"]: r["expected_clusters"] for r in statistics.rarefaction_expected(sizes, [10, 40, 120]).collect()}
    drawn = {r["sample_size"]: r for r in statistics.rarefaction_repeats(sizes, [10, 40, 120], 200).collect()}
    assert exact[120] == pytest.approx(11)
    for n in (10, 40, 120):
        assert drawn[n]["mean_clusters"] == pytest.approx(exact[n], abs=0.4) and drawn[n]["lo"] <= drawn[n]["mean_clusters"] <= drawn[n]["hi"]


def test_rarefaction_queries_reach_all_rows(spark, tmp_path):
    assert statistics.sample_grid(0) == [] and statistics.sample_grid(1) == [1] and statistics.sample_grid(10) == [1, 2, 3, 5, 8, 10]
    assert statistics.sample_grid(6_000_007)[-3:] == [3_000_000, 5_000_000, 6_000_007]
    docs = spark.range(270).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.lit("en").alias("lang"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["sample_size"]: r for r in aggregates.rarefaction_repeats_q(spark, str(tmp_path)).collect()}
    assert max(got) == 270 and got[270]["lo"] == got[270]["hi"] == 7
    sizes = docs.groupBy("source").agg(F.count("*").alias("members"))
    assert statistics.rarefaction_expected(sizes.limit(0), []).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables")
def test_rarefaction_ends_at_all_clusters(spark):
    last = aggregates.rarefaction_q(spark, "/root/testdata/sf0.001").orderBy(F.desc("sample_size")).first()
    assert last["sample_size"] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() and last["fraction"] == 1


def test_planted_communities(spark):
    rng = np.random.default_rng(6)
    edges = [(i, j, 1.0) for i in range(60) for j in range(i + 1, 60) if rng.random() < (0.5 if i // 20 == j // 20 else 0.02)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    parts = graph.community_detection(e)
    planted = spark.range(60).select(F.col("id").alias("vertex"), F.floor(F.col("id") / 20).alias("community"))
    got, want = (graph.modularity(e, p).first()["modularity"] for p in (parts, planted))
    assert got >= want - 0.02 and parts.count() == 60


def test_communities_settle_and_are_connected(spark):
    """A chain of cliques, a star and two loose pairs: no vertex can gain by moving."""
    edges = {}
    for c in range(8):
        for i in range(5):
            for j in range(i + 1, 5):
                edges[c * 5 + i, c * 5 + j] = 1.0
        if c:
            edges[c * 5 - 1, c * 5] = 0.5
    edges |= {(100, 100 + i): 1.0 for i in range(1, 9)} | {(200, 201): 1.0, (300, 301): 2.0}
    e = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src long, dst long, weight double")
    of = {r.vertex: r.community for r in graph.community_detection(e).collect()}
    assert all(len({of[c * 5 + i] for i in range(5)}) == 1 for c in range(8))
    assert len({of[100 + i] for i in range(9)}) == 1 and of[200] == of[201] and of[300] == of[301]
    near, k = {}, {}
    for (a, b), w in edges.items():
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = w
            k[x] = k.get(x, 0) + w
    m2, tot = sum(k.values()), {}
    for v, c in of.items():
        tot[c] = tot.get(c, 0) + k[v]
        reached, todo = {v}, [v]  # its community hangs together
        while todo:
            new = {u for u in near[todo.pop()] if of[u] == c} - reached
            reached |= new
            todo += new
        assert reached == {u for u in of if of[u] == c}
    for v, c in of.items():
        to = {d: sum(w for u, w in near[v].items() if of[u] == d) for d in {of[u] for u in near[v]} | {c}}
        for d, w in to.items():
            gain = 0 if d == c else 2 * (w - to[c] - k[v] * (tot[d] - tot[c] + k[v]) / m2) / m2
            assert gain <= graph.SETTLED


@pytest.mark.parametrize("arcs", [1 << 16, 400])  # 400: several blocks, and communities that fill more than one
def test_communities_settle_in_few_tables(spark, monkeypatch, arcs):
    """Every round of single moves used to write three tables."""
    rng = np.random.default_rng(6)
    edges = [(i, j, 1.0) for i in range(90) for j in range(i + 1, 90) if rng.random() < (0.6 if i // 30 == j // 30 else 0.02)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double").cache()
    written = []
    monkeypatch.setattr(graph, "BLOCK_ARCS", arcs, raising=False)
    monkeypatch.setattr(graph, "cut_lineage", lambda df, cut=graph.cut_lineage: written.append(1) or cut(df))
    of = {r.vertex: r.community for r in graph.community_detection(e).collect()}
    assert sorted(of) == list(range(90)) and len(set(of.values())) == 3
    assert all(len({of[c * 30 + i] for i in range(30)}) == 1 for c in range(3))
    assert len(written) < (25 if arcs > 400 else 1000)


def test_a_level_of_many_arcs_is_one_block(spark, monkeypatch):
    """190,000 arcs used to be three blocks, which met in dozens of rounds of jobs."""
    edges = spark.range(10_000).selectExpr("id AS src", "explode(sequence(id - id % 20, id)) AS dst", "1D AS weight").filter("dst < src")

    def sweep(self, state):
        raise AssertionError("several blocks")

    monkeypatch.setattr(graph._Level, "sweep", sweep)
    found = graph.community_detection(edges)
    assert found.count() == 10_000 and found.filter("community <> vertex - vertex % 20").isEmpty()


def test_communities_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert graph.community_detection(none).count() == 0
    zero = spark.createDataFrame([(1, 2, 0.0)], "src long, dst long, weight double")
    assert {tuple(r) for r in graph.community_detection(zero).collect()} == {(1, 1), (2, 2)}


def test_core_numbers_against_peeling(spark):
    rng = np.random.default_rng(7)
    edges = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (160, 2)) if a != b}
    adj = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in range(40)}
    core, left, k = {}, {n: set(v) for n, v in adj.items() if v}, 0
    while left:
        n = min(left, key=lambda v: len(left[v]))
        k = max(k, len(left[n]))
        core[n] = k
        for m in left.pop(n):
            left[m].discard(n)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")
    assert {r["node"]: r["core"] for r in graph.core_numbers(df).collect()} == core


def test_chi_square_tail_in_bounded_work(spark):
    def exact(h, k):
        total, log_term = 0.0, -h
        for i in range(k):
            total += math.exp(log_term)
            log_term += math.log(h) - math.log(i + 1)
        return total

    cases = [(float(h), k) for k in (2, 63, 64, 65, 200, 5000) for h in (k * 0.7, k - 1.0, k * 1.0, k + 3 * k**0.5, k * 1.3)]
    df = spark.createDataFrame([(i, 2 * h, k) for i, (h, k) in enumerate(cases)], "i int, x double, k long")
    got = {r.i: r.p for r in df.select("i", chi2_sf_even(F.col("x"), F.col("k")).alias("p")).collect()}
    assert all(got[i] == pytest.approx(min(exact(h, k), 1.0), rel=1e-6, abs=1e-300) for i, (h, k) in enumerate(cases))
    large = spark.createDataFrame([(6e9, 3_000_000_000)], "x double, k long").select(chi2_sf_even(F.col("x"), F.col("k"))).first()[0]
    assert large == pytest.approx(0.5, abs=1e-4)


def test_identity_clusters(spark):
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 120)) for _ in range(4)]
    rows = [(i, base[i % 4][: 120 - i]) for i in range(12)] + [(100 + i, base[0]) for i in range(10)]
    got = {r[0]: r[1] for r in graph.identity_clusters(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()}
    assert {got[i] for i in (0, 4, 8, *range(100, 110))} == {0} and [got[i] for i in (1, 5, 9)] == [1, 1, 1]


def test_a_longer_third_sequence_does_not_part_two(spark):
    rng = np.random.default_rng(10)
    one = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 50))
    rows = [(1, one), (2, one[:45]), (3, one + "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 14)))]
    got = {r[0]: r[1] for r in graph.identity_clusters(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_members_fit_their_own_representative(spark):
    rng = np.random.default_rng(12)
    w = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 100))
    rows = [(1, w), (2, w[:90]), (3, w[:80]), (4, w[:64]), (5, None), (6, ""), (7, "AC")]
    got = {r[0]: r[1] for r in graph.identity_clusters(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: None, 6: 6, 7: 7}


def serial_clusters(rows, share, coverage, k):
    first = {}
    for i, s in rows:
        first[s] = min(i, first.get(s, i))
    kmers = {s: {s[j : j + k] for j in range(len(s) - k + 1)} if len(s) > k else {s} for s in first}
    reps, out = [], {}
    for s in sorted(first, key=lambda s: (-len(s), first[s])):
        out[s] = next((first[r] for r in reps if len(s) >= len(r) * coverage and len(kmers[s] & kmers[r]) >= len(kmers[s]) * share), None)
        if out[s] is None:
            reps.append(s)
            out[s] = first[s]
    return {i: out[s] for i, s in rows}


@pytest.mark.parametrize("productive", [10, 1])  # 1: open candidates are compared after the first round
def test_clusters_equal_the_serial_choice(spark, monkeypatch, productive):
    monkeypatch.setattr(graph, "PRODUCTIVE", productive)
    rng = np.random.default_rng(11)
    base = ["".join(rng.choice(list("ACDE"), 60)) for _ in range(5)]
    rows = []
    for i in range(100):
        s = list(base[i % 5][rng.integers(0, 10) : 60 - rng.integers(0, 20)])
        for _ in range(rng.integers(0, 8)):
            s[rng.integers(len(s))] = "F"
        rows.append((i, "".join(s)))
    for share, coverage, k in ((0.5, 0.8, 6), (0.8, 0.9, 3)):
        got = {r[0]: r[1] for r in graph.identity_clusters(spark.createDataFrame(rows, "id long, s string"), "id", "s", share, coverage, k).collect()}
        want = serial_clusters(rows, share, coverage, k)
        assert got == want and 5 < len(set(want.values())) < 90


def test_pairs_do_not_carry_their_kmers(spark, monkeypatch):
    """Candidates took the k-mers of both with them through a shuffle; several ranges and parts count the same."""
    monkeypatch.setattr(graph, "CELLS_AT_ONCE", 400, raising=False)
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 50, raising=False)
    rng = np.random.default_rng(13)
    base = "".join(rng.choice(list("ACDE"), 80))
    rows = [(i, base[: 80 - int(rng.integers(0, 16))] + "".join(rng.choice(list("FGHI"), 40))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s string").withColumns({"u": F.col("id"), "len": F.length("s"), "km": graph.kmer_hashes(F.col("s"), 5)})
    cells = graph._Cells(df.select("u", "len", "km"), 0.3, 0.8)
    links = cells.links(cells.rows, cells.rows)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan
    kmers = {i: {s[j : j + 5] for j in range(len(s) - 4)} for i, s in rows}
    want = {(a, b) for a, s in rows for b, t in rows if (len(t), -b) > (len(s), -a) and len(s) >= 0.8 * len(t) and len(kmers[a] & kmers[b]) >= 0.3 * len(kmers[a])}
    assert {(r.u, r.v) for r in links.collect()} == want and len(want) > 100


def test_clusters_write_no_kmers(spark, monkeypatch):
    """A row of every shared k-mer used to be written; blocks of a few sequences find the same."""
    monkeypatch.setattr(graph, "BLOCK_SEQUENCES", 7, raising=False)
    monkeypatch.setattr(graph, "CELLS_AT_ONCE", 500)
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 20)
    rng = np.random.default_rng(14)
    base = ["".join(rng.choice(list("ACDE"), 300)) for _ in range(12)]
    rows = [(i, base[i % 12][: 300 - int(rng.integers(0, 70))]) for i in range(48)]
    written = []

    def cut(df, cut=graph.cut_lineage):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut_lineage", cut)
    got = {r[0]: r[1] for r in graph.identity_clusters(spark.createDataFrame(rows, "id long, s string"), "id", "s", 0.3, 0.8, 9).collect()}
    assert got == serial_clusters(rows, 0.3, 0.8, 9) and len(set(got.values())) < 30
    assert sum(written) < 30 * len(rows)


def test_null_sets_respect_core(spark):
    pos = [("s", i, (i % 17) / 17, 20 <= i < 25 or 60 <= i < 63) for i in range(1, 121)]
    df = spark.createDataFrame(pos, "item string, pos long, radial double, core boolean")
    sets = nulls.matched_null_sets(df, "item", 60).toPandas()
    assert sets["iter"].nunique() == 60 and (sets.groupby("iter").size() == 8).all()
    assert not set(sets["position"]) & {p for _, p, _, c in pos if c}
    assert sets.groupby("iter")["position"].nunique().eq(8).all()


def test_null_sets_by_brute_force(spark):
    rng = np.random.default_rng(3)
    core = set(range(20, 25)) | set(range(60, 63)) | set(range(80, 83))
    # Of item b hardly a window is near: its segments compete for the nearest ones.
    radial = {k: {i: float(rng.normal(0 if k == "a" else 5 * (i not in core), spread)) for i in range(1, 101)} for k, spread in (("a", 0.2), ("b", 0.01))}
    df = spark.createDataFrame([(k, i, x, i in core) for k, r in radial.items() for i, x in r.items()], "item string, pos long, radial double, core boolean")
    got = nulls.matched_null_sets(df, "item", 100).toPandas().groupby(["item", "iter"])["position"].apply(set).to_dict()
    digest = lambda *x: hashlib.md5("|".join(map(str, (*x, 42))).encode()).hexdigest()
    for k, r in radial.items():
        for attempt in range(100):
            used = set()
            for start, size in sorted([(20, 5), (60, 3), (80, 3)], key=lambda s: (-s[1], digest(k, attempt, s[0]))):
                centre, offers = np.median([r[start + j] for j in range(size)]), []
                for at in range(1, 102 - size):
                    if not set(range(at, at + size)) & (core | used):
                        error = abs(np.median([r[at + j] for j in range(size)]) - centre)
                        level = next((n for n, t in enumerate(nulls.TOLERANCES) if error <= t), len(nulls.TOLERANCES))
                        offers.append((level, error if level == len(nulls.TOLERANCES) else 0, digest(k, attempt, start, at), at))
                used |= set(range(min(offers)[3], min(offers)[3] + size))
            assert got[k, attempt] == used


def test_null_query_draws_the_reference_count():
    assert graphs.NULL_SETS >= 300 and f"range(0, {graphs.NULL_SETS})" in graphs.NULL_SQL


def test_pair_cosine_over_blocks(spark):
    rng = np.random.default_rng(9)
    m = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4)
    m[:, 0] = 1.0  # a feature every item has
    cells = spark.createDataFrame([(i, int(j), float(m[i, j])) for i in range(30) for j in np.flatnonzero(m[i])], "i long, f int, v double")
    got = {(r["i"], r["j"]): r["sim"] for r in pair_cosine(cells.withColumnRenamed("i", "it"), "it", "f", "v", block_items=8, block_features=4).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert len(got) == 900 and all(got[i, j] == pytest.approx((u @ u.T)[i, j]) for i in range(30) for j in range(30))


def test_pair_join_blocks(spark):
    df = spark.range(50).select("id", F.when(F.col("id") < 40, 0).otherwise(1).alias("g"))
    got = sorted((r["g"], r["id1"], r["id2"]) for r in joins.pair_join(df, "id", ["g"], block_rows=7).collect())
    want = sorted((int(a >= 40), a, b) for a, b in itertools.combinations(range(50), 2) if (a >= 40) == (b >= 40))
    assert got == want


def test_vector_statistics(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [3.0, -2.0]), (1, [0.0, 0.0]), (1, None), (2, [nan, inf]), (2, [nan, 5.0])]
    df = spark.createDataFrame(rows, "g int, vec array<double>")
    got = clean.vector_profile(df).first()
    x = [1, 2, 3, -2, 0, 0, 5]
    assert (got.n_rows, got.n_zero_rows, got.n_nan, got.n_inf, got.min, got.max, got.passed) == (6, 1, 2, 1, -2, 5, False)
    assert (got["mean"], got["std"]) == pytest.approx((np.mean(x), np.std(x)))
    none = clean.vector_profile(df.limit(0)).first()
    assert none.n_rows == 0 and none["mean"] is None and none["std"] is None
    fine = df.filter("g < 2")
    pooled = {r.g: r.vec for r in aggregate.dense_mean_pool(fine, "g", "vec").collect()}
    assert pooled == {0: [2.0, 0.0], 1: [0.0, 0.0]}
    z = aggregate.standardize_apply(fine.filter("g = 0"), aggregate.standardize_fit(fine.filter("g = 0"))).collect()
    assert sorted(r.vec for r in z) == [[-1.0, 1.0], [1.0, -1.0]]
    folds = {r.g: r["mean"] + r["std"] for r in models.fold_scalers(fine.filter("vec is not null"), "g").collect()}
    assert folds[1] == pytest.approx([2.0, 0.0, 1.0, 2.0]) and folds[0] == pytest.approx([0.0, 0.0, 1.0, 1.0])
