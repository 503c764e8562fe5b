"""The queries of the ten operators, one each, with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, jaccard, lm, quality, sharding, substring, toxicity
from .common import remainder, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; KEYSTRATA_TOKENIZERS may name another folder."""
    folder = os.environ.get("KEYSTRATA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lm.score(docs, lm.training_part(docs, divisor=7, held=2))
    return found.withColumn("held_out", remainder("doc_id", 7) == 2)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.read_spec(vocabulary()))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.rate(docs, table(spark, sf_dir, "labels"), divisor=5, held=0)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("row_key")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), divisor=4, held=2))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), "predicted", F.size("segments").alias("n_segments"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.expand(rows))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.locate(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), tokens AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS token
  FROM split, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reached r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op9_substring_dedup": r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), places AS (
  SELECT row, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i : i + 34], ' ') END AS win
  FROM split, unnest(range(1, len(ws) + 1)) AS t(i)
), repeated AS (
  SELECT win FROM places WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1
), marked AS (
  SELECT p.row, p.i, p.word, max(CASE WHEN r.win IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.row ORDER BY p.i ROWS 34 PRECEDING) AS gone
  FROM places p LEFT JOIN repeated r ON r.win = p.win
), found AS (
  SELECT row, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY row
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN found USING (row)""",
    "op10_decontamination": r"""
WITH items AS (
  SELECT coalesce(item_id, -1) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + 12], ' ') AS win
  FROM items, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0
), split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), places AS (
  SELECT row, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM split, (SELECT DISTINCT n FROM wins), unnest(range(1, len(ws) - n + 2)) AS t(i)
), hits AS (
  SELECT row, i, n, item_id FROM places JOIN wins USING (n, win)
), words AS (
  SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT row, i, n FROM hits), unnest(range(i, i + n)) AS t(j) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM split LEFT JOIN words USING (row) LEFT JOIN named USING (row)""",
    "op8_nearest_neighbours": """
WITH rows AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20""",
    "op7_chat_formatting": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS last,
    sum(16 + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g'))
        + length(body) + length(regexp_replace(body, '[^\\<>]', '', 'g'))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(body)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR n = last) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
}
