"""The registered queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from hemline.llm.bpe import round_trip
from hemline.llm.edit_fingerprints import edited_neighbours
from hemline.llm.frames import sha256_hex, table
from hemline.llm.language import identify_documents
from hemline.llm.line_dedup import dedup_lines
from hemline.llm.merkle import verified_manifest
from hemline.llm.mixing import mix_rows
from hemline.llm.personal_data import report
from hemline.llm.quality import quality_scores
from hemline.llm.registry import query
from hemline.llm.simhash import near_duplicates
from hemline.llm.token_counts import count_tokens
from hemline.llm.token_files import token_files
from hemline.llm.top_k import top_k
from hemline.llm.whitening import whiten


@query("op1_token_counts")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_mix_to_weights")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mix_rows(table(spark, sf, "documents"))


@query("op3_personal_data")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return report(table(spark, sf, "documents"))


_TOP_K = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.n <> c.n
)
SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""


@query("op4_exact_top_k", _TOP_K)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(table(spark, sf, "embeddings"))


@query("op5_language_id")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Language, posterior and whether it is accepted, for every document."""
    found = identify_documents(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return found.withColumn("posterior", F.round("posterior", 6))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query("op8_token_files")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return token_files(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_order_minhash")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return edited_neighbours(table(spark, sf, "documents"))


@query("op10_line_dedup")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document, lines deleted as later copies, and the digest of what is left."""
    found = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", sha256_hex(F.col("text")).alias("text_sha256"))


@query("op12_quality_classifier")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Up to eight whitened components of every vector. A deviation that no long holds is null."""
    return whiten(table(spark, sf, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


_MERKLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
      lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END).array_to_string('') AS head
  FROM documents
), h AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':'
      || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS shown
  FROM d
), l AS (
  SELECT *, row_number() OVER () AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM h
), nodes(tree, lvl, pos, n, hash) AS (
  SELECT tree, 0, pos, n, leaf FROM l UNION ALL
  SELECT tree, lvl + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY tree, lvl, pos // 16
), subroots AS (
  SELECT tree, hash, count(*) OVER () AS trees FROM nodes WHERE n = 1
), tops(tree, lvl, pos, n, hash) AS (
  SELECT -1, 0, tree, trees, hash FROM subroots UNION ALL
  SELECT -1, lvl + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(hash, '' ORDER BY pos)) FROM tops WHERE n > 1
  GROUP BY lvl, pos // 16
), runs AS (
  SELECT tree, lvl, pos // 16 AS run, list(hash ORDER BY pos) AS hs FROM (FROM nodes UNION ALL FROM tops) WHERE n > 1 GROUP BY ALL
), walk(id, tree, lvl, pos, n, hash, proof) AS (
  SELECT id, tree, 0, pos, n, coalesce(shown, leaf), '' FROM l UNION ALL
  SELECT w.id, CASE WHEN w.n > 1 THEN w.tree ELSE -1 END, CASE WHEN w.n > 1 THEN w.lvl + 1 ELSE 0 END,
    CASE WHEN w.n > 1 THEN w.pos // 16 ELSE w.tree END, CASE WHEN w.n > 1 THEN (w.n + 15) // 16 ELSE (SELECT count(*) FROM subroots) END,
    CASE WHEN w.n > 1 THEN sha256(array_to_string(hs[:w.pos % 16] || [w.hash] || hs[w.pos % 16 + 2:], '')) ELSE w.hash END,
    CASE WHEN w.n > 1 THEN w.proof || array_to_string(hs[:w.pos % 16] || hs[w.pos % 16 + 2:], '') ELSE w.proof END
  FROM walk w LEFT JOIN runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = w.pos // 16 AND w.n > 1 WHERE w.tree >= 0 OR w.n > 1
)
SELECT l.doc_id, l.leaf, s.hash AS subroot, t.hash AS root, sha256(w.proof) AS proof_sha256, w.hash AS folded_root, w.hash = t.hash AS verified
FROM l JOIN subroots s USING (tree) JOIN walk w ON w.id = l.id AND w.tree = -1 AND w.n = 1 JOIN tops t ON t.n = 1
"""


@query("op11_merkle_manifest", _MERKLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return verified_manifest(table(spark, sf, "documents"))
