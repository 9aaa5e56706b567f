"""One query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import scratch_folder
from .byte_bpe import decode, encode
from .chat_format import canonical_turns, format_chat, read_chat, read_loss_texts
from .decontaminate import benchmark_overlaps
from .exact_dedup import exact_groups
from .jaccard_join import Rule, near_duplicates
from .lexical_search import search
from .registry import ORACLES, QUERIES, query, table
from .rows import text_of
from .sharding import assign_shards
from .source_mixing import cycled_weights, mix_documents, sized_rows, taken_words
from .substring_dedup import remove_repeats
from .suffix_dedup import remove_byte_repeats
from .token_alignment import alignment_digests, link_scores
from .token_files import read_ids, write_ids
from .toxicity import fit_toxicity, held_out, score_toxicity

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # The digest is asked for every row; it rides along as a part of the id and
    # is no part of the decision.
    rows = docs.select(F.struct("doc_id", F.sha2(text_of(), 256).alias("sha")).alias("id"), "text")
    groups = exact_groups(rows, "id")
    return groups.select(
        F.col("id.doc_id").alias("doc_id"), F.col("keep_id.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"), "kept", F.col("id.sha").alias("text_sha256"),
    )


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(docs, ranks, public_tokenizers.PATTERN, keep_text=False)
    digest = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    back = decode(digest, ranks, keep_ids=False)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_token_files")
def op9_token_files(spark, sf_dir):
    path = scratch_folder(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, path, with_ids=False)


TOXIC_FROM = 0.3


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sizes AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', '')) + length(text) - length(replace(text, '<', '')) AS text_chars,
         length(role) AS role_chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM sizes GROUP BY conv_id
"""


@query("op7_chat_format", CHAT_SQL)
def op7_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    chats = read_loss_texts(read_chat(format_chat(canonical_turns(rows.unionByName(extra)))))
    lines = F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return chats.select(
        "conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_decontaminate")
def op10_decontaminate(spark, sf_dir):
    pairs = benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "matched", "item_size", "shift")


@query("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents"), words=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_sharding")
def op4_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"), shards=16)


@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), Rule(words=4, num=85, den=100))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    cut = remove_byte_repeats(table(spark, sf_dir, "documents"), length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    digests = alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return link_scores(digests).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


MIX_SQL = r"""
WITH rows AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(doc_id || '|0') AS h FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight,
         CAST(3 * sum(size) AS DOUBLE) AS cap FROM rows GROUP BY source),
levels AS (
  SELECT (sum(source_size) OVER () - (sum(cap) OVER w - cap)) / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS level
  FROM sources WINDOW w AS (ORDER BY cap / weight, source NULLS FIRST ROWS UNBOUNDED PRECEDING)),
targets AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM levels) * weight) AS target FROM sources),
laid AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM rows),
wanted AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS w FROM targets)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (w // source_size) * size + greatest(0, least(size, w % source_size - before)) END AS BIGINT) AS taken
FROM laid JOIN wanted ON laid.source IS NOT DISTINCT FROM wanted.source
"""


@query("op11_source_mixing", MIX_SQL)
def op11_source_mixing(spark, sf_dir):
    rows = sized_rows(table(spark, sf_dir, "documents"))
    # Weights 1, 2, 3: light sources fade out, heavy ones fade in.
    mix, targets = mix_documents(rows, cycled_weights(rows, (1, 2, 3), rise=(1.5, 1.0, 0.5)), most=3)
    return taken_words(rows, mix, targets).withColumnRenamed("id", "doc_id")
