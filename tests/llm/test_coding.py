"""Token coding, chat formatting, sharding, toxicity, decontamination and the pipeline."""

import base64
import collections
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from strandwork.llm import chunks, token_files, words
from strandwork.llm.byte_bpe import Vocabulary, decode, encode
from strandwork.llm.chat_format import canonical_turns, canonical_turns_json, format_chat, read_chat, read_loss_texts
from strandwork.llm.decontaminate import benchmark_overlaps, drop_contaminated
from strandwork.llm.sharding import assign_shards
from strandwork.llm.toxicity import INSULT, OTHER, REPORT, TARGET, THREAT, ToxicityModel, fit_toxicity, grammar, held_out, score_toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string"
HARD = ["", None, "don't we'll", "a" * 3000, "  x \n\n y\t", "été 漢字 123", "ab cd", "x y", "!?..'s", "the " * 500 + "\n"]


def reference_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noisy(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab A1,.'\n\t  é×s't-  ") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_the_library_and_decodes(spark):
    texts = HARD + noisy(1, 300)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, IDS string")
    out = decode(encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert "IDS" not in out.columns  # a column of the output's name is replaced
    want = reference_encoding()
    for r in out.collect():
        assert r.ids == want.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert encode(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).count() == 0
    back = decode(spark.createDataFrame([(None,), ([],), ([64, None],)], "ids array<int>"), RANKS)
    assert [bytes(r.decoded) for r in back.collect()][:2] == [b"", b""]


def test_segment_tree_merges_leftmost_first():
    raw = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([b"a", b"b", b"aa", b"ab", b"aab"]))
    ids, starts, sizes = Vocabulary(raw).encode_pieces([b"aaab", b"", b"aab", b"aaa"])
    assert [ids[a : a + n].tolist() for a, n in zip(starts, sizes)] == [[2, 3], [], [4], [2, 0]]


def test_chunks_cut_where_pieces_end():
    import pyarrow as pa
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = noisy(2, 500)
    for a, b, data, offsets in words.text_slices(pa.array(texts), 300):
        starts = set(chunks.chunk_starts(data, offsets).tolist())
        ends = set()
        for i in range(a, b):
            at = offsets[i - a]
            for m in pattern.finditer(texts[i]):
                ends.add(int(at) + len(texts[i][: m.start()].encode()))
        assert starts <= ends


@pytest.mark.parametrize("bits", [1, 5, 16, 31, 60, 64])
def test_simple8b_round_trip(bits):
    rng = random.Random(bits)
    for n in (0, 1, token_files.BLOCK, 3 * token_files.BLOCK + 7):
        ids = np.array([rng.getrandbits(rng.randint(1, bits)) for _ in range(n)], np.uint64)
        coded, blocks, escapes = token_files.pack(ids)
        assert (token_files.unpack(coded, blocks, escapes, n) == ids).all()
        assert len(blocks) == -(-n // token_files.BLOCK)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = HARD + ["a  <|endoftext|>b <|endoftext|>", "<|endoftext|>", "<|endoftext"] + noisy(3, 100)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, PART string").repartition(5)
    token_files.write_ids(df, str(tmp_path / "ids"), path, end_id=2)
    got = token_files.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    start = 0
    for r, i in zip(got, [None, *range(len(texts))], strict=True):
        ids = tokenizer.encode("null id" if i is None else texts[i] or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        start += len(ids)
    token_files.write_ids(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), path, end_id=2)
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok \\h \\\\l ### user: <"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "a: b", None), (2, None, None, ""), (2, 0, "assistant", "x\n"), (None, 5, "assistant", "é"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in read_loss_texts(read_chat(format_chat(canonical_turns(df)))).collect()}
    turns = {i: [(t.role, t.text) for t in r.turns_read] for i, r in out.items()}
    assert turns == {1: [("user", hard), ("assistant", hard), ("a: b", "")], 2: [("", ""), ("assistant", "x\n")], None: [("assistant", "é")], 3: [("assistant", "same")] * 2}
    assert {i: r.loss_texts for i, r in out.items()} == {1: [hard], 2: ["x\n"], None: ["é"], 3: ["same"] * 2}
    assert canonical_turns(df.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    wide = spark.createDataFrame([("q", "a", "more", "left alone")], "instruction string, output string, input string, EXTRA string")
    assert [tuple(t) for t in canonical_turns(wide).first().turns] == [("user", "q\n\nmore"), ("assistant", "a")]
    nested = spark.createDataFrame([([("user", "hi"), (None, None)],), (None,)], "messages array<struct<role:string,content:string>>")
    assert [[tuple(t) for t in r.turns] for r in canonical_turns(nested).collect()] == [[("user", "hi"), ("", "")], []]
    with pytest.raises(ValueError):
        canonical_turns(spark.range(1))
    records = ['{"prompt": "p", "response": "r", "id": 3}', '{"conversations": [{"from": "user", "value": "v"}]}', '{"question": "q", "answer": null}', '{"other": 1}', None]
    got = canonical_turns_json(spark.createDataFrame([(r,) for r in records], "j string"), "j").collect()
    assert [None if r.turns is None else [tuple(t) for t in r.turns] for r in got] == [[("user", "p"), ("assistant", "r")], [("user", "v")], [("user", "q"), ("assistant", "")], None, None]


def shards_hold(rows, shards):
    sizes = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_sharding(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 9}" if i % 3 == 1 else f"own {i}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = assign_shards(df, 4).collect()
    shards_hold(got, 4)
    text = {i: t for i, t, _ in rows}
    where = collections.defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert len(where["hot"]) == 2  # 100 rows in shards of 75
    assert all(len(s) == 1 for t, s in where.items() if t != "hot")
    odd = assign_shards(spark.createDataFrame([(None, None), (1, ""), (1, "")], SCHEMA), 2).collect()
    shards_hold(odd, 2)
    assert [r.size for r in odd] == [1, 1, 1] and {r.text_crc32 for r in odd} == {0}
    assert assign_shards(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_toxic_grammar():
    model = ToxicityModel((("idiot", 1.0), ("lowe*", 1.0)), -3.0, 4.0)
    total = lambda t: sum(model.clause_weights(t))
    assert total("A fine day, nothing else.") == 0 and total("An Idiot.") == 1.0 and total("Loweint ist") == 1.0
    assert total("you idiot") > total("idiot") > total("not an idiot") > 0
    assert total("he said idiot") < total("idiot") and total("he said so. idiot") == total("idiot")
    assert total("I will kill you") == 0.1 and total("you, I kill") == 0.1 and total("you I will kill") == 1.0
    assert total("idiotic") == 0 and total("x" * 100_000 + " idiot") == 1.0
    arcs = grammar().arcs
    assert all(set(a) == set(range(6)) for a in arcs) and arcs[0][INSULT][2] == 1.0 and arcs[0][THREAT][2] == 0.1
    assert len({arcs[0][s][0] for s in (OTHER, REPORT, TARGET)}) == 3


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    rng = random.Random(6)
    plain = [f"v{rng.choice('abcdefgh') * 3}{rng.choice('klmn') * 2}" for _ in range(60)]
    docs, labels = [], []
    for i in range(800):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(30)]
        for _ in range(3 * toxic):
            w.insert(rng.randrange(30), rng.choice(["zork", "grumpf"]))
        docs.append((i, " ".join(w), 9))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, SCORE int"), spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(df, lab)
    assert {"zork", "grumpf"} <= {e for e, _ in model.insults} and len(model.insults) < 30
    out = score_toxicity(df, model).withColumn("out", held_out()).collect()
    assert sum(r.out for r in out) > 100
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) and 0 <= r.score <= 1 for r in out if r.out)
    empty = score_toxicity(spark.createDataFrame([(None, None), (1, "")], SCHEMA), model).collect()
    assert len(empty) == 2 and all(r.score < 0.3 for r in empty)
    none = fit_toxicity(df, lab.limit(0))
    assert none.insults == () and score_toxicity(df, none).filter("score >= 0.3").count() == 0


def leaks(docs, items, share=0.8):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in docs:
        w = tok(t)
        for k, b in ((k, tok(b)) for k, b in items):
            for s in range(-len(b), len(w)):
                m = sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(b))
                if len(b) >= 8 and m >= share * len(b):
                    out[i, k] = max(m, out.get((i, k), 0))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    from strandwork.llm import decontaminate

    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    rng = random.Random(7)
    items = [(k, " ".join(f"q{rng.randint(0, 200)}" for _ in range(20))) for k in range(10)] + [(98, "too short"), (99, None), (3, None)]
    docs = [(i, " ".join(f"q{rng.randint(0, 200)}" for _ in range(30))) for i in range(30)]
    for i in range(30, 60):
        w = (items[i % 10][1] or "").split()
        for _ in range(i % 5):
            w[rng.randrange(20)] = "other"
        docs.append((i, "Some, words " + " - ".join(w).upper() + " end"))
    docs += [(90, None), (91, "")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, WORDS int")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, items)
    got = {(r.doc_id, r.item_id): r.matched for r in benchmark_overlaps(df, it).collect()}
    assert got == want and len(want) >= 25
    kept = drop_contaminated(df, it)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert benchmark_overlaps(df, it.limit(0)).count() == 0 and benchmark_overlaps(df.limit(0), it).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_of_excerpts_and_moved_words(spark, monkeypatch, broadcast):
    from strandwork.llm import decontaminate

    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    item = {n: [f"w{n}x{k}" for k in range(n)] for n in (59, 40, 16)}
    gap = [f"z{k}" for k in range(9)]
    cases = [
        (59, item[59][7:52], 45),  # an excerpt
        (59, item[59][20:33], 13),
        (59, item[59][20:32], None),
        (59, item[59][5:11] + ["z"] + item[59][12:20], 14),  # 14 of 15, of which the first 6 are fewer than the miss costs
        (59, item[59][:9] + ["z", "z"] + item[59][11:14], 12),
        (40, item[40][:20] + ["z"] + item[40][20:], 40),  # a word put in
        (40, item[40][:20] + item[40][21:], 39),  # a word left out
        (16, item[16][:6] + ["z"] + item[16][6:], 16),  # the shorter part has no seed
        (16, item[16][:8] + gap[:8] + item[16][8:], 16),
        (16, item[16][:8] + gap + item[16][8:], None),
        (16, item[16][8:] + item[16][:8], None),  # not in order
    ]
    docs = spark.createDataFrame([(i, " ".join(["head", *w, "tail"])) for i, (_, w, _) in enumerate(cases)], "doc_id long, text string")
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in item.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in benchmark_overlaps(docs, items).collect()}
    assert got == {(i, n): m for i, (n, _, m) in enumerate(cases) if m}
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {i for i, (_, _, m) in enumerate(cases) if not m}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables")
def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and all(before[i] == t for i, t in after.items()), name
        if name == "exact_dedup":
            assert set(after) == set({t: i for i, t in sorted(before.items())}.values())
    assert len(corpus_pipeline.STAGES) == 5
    ids = corpus_pipeline.run(spark, sf)
    want, texts = reference_encoding(), {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {i: want.encode_ordinary(t) for i, t in texts.items()}
    assert ids.filter("not round_trip").count() == 0


def test_chunks_are_remembered_beyond_300000():
    coded = []

    def code(texts):
        coded.append(len(texts))
        return np.array([int(t.strip()[1:]) for t in texts], np.int32), np.ones(len(texts), np.int64)

    coder = chunks.ChunkCoder(code, remembered=token_files.REMEMBERED)
    for at in (0, 200_000, 0):  # met, met anew and met before
        raw = "".join(f" w{i}" for i in range(at, at + 200_000)).encode()
        ids, upto = coder.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert (ids == np.arange(at, at + 200_000)).all() and upto.tolist() == [200_000]
    assert coded == [200_000, 200_000]
