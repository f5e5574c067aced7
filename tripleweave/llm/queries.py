"""The registered queries of the corpus operators, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.llm import arc, ball_kmeans, byte_bpe, fill_middle, kdtree, kmeans_tree, langid, multi_index, packing, sentence_spans, sharding, simhash, simple8b

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.classify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return packing.pack_pieces(pieces)


def op5_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return kdtree.exact_top_k(rows, rows.filter("vec_id % 50 = 0"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents"), BYTE_RANKS)


def op7_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.ids_round_trip(_table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("clean_text").alias("text"), "removed")


def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return kmeans_tree.approximate_top_k(rows, rows.filter("vec_id % 50 = 0"))


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.coded(_table(spark, sf_dir, "embeddings"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op13_fenwick_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_simhash_balls": op2_simhash_balls,
    "op3_centroid_langid": op3_centroid_langid,
    "op4_swap_packing": op4_swap_packing,
    "op5_kd_top_k": op5_kd_top_k,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simple8b_ids": op7_simple8b_ids,
    "op8_minimax_shards": op8_minimax_shards,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_kmeans_tree": op10_kmeans_tree,
    "op11_ball_codes": op11_ball_codes,
    "op12_multi_index": op12_multi_index,
    "op13_fenwick_middle": op13_fenwick_middle,
    "pipeline": pipeline,
}

_KD = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p
)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5
"""

# base32 by groups of five bits of the digest's hexadecimal form
_ARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), 'string_agg', '') AS bits
  FROM p
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + list_sum(list_transform(range(0, 5), lambda k: CAST(bits[5 * i + k + 1] AS INT) * (16 >> k)))::INT, 1)), 'string_agg', '') AS payload_digest
  FROM b
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM m
"""

# one assignment and one move of the codebooks, four times over; a part's key is its distance times 256 plus the entry
_ASSIGN = """a{n} AS MATERIALIZED (
  SELECT x.vec_id, x.p, min((x.sq + c.sq - 2 * list_inner_product(x.e, c.e))::HUGEINT * 256 + c.k) AS best
  FROM x JOIN c{n} c USING (p) GROUP BY x.vec_id, x.p
)"""
_MOVE = """m{n} AS MATERIALIZED (
  SELECT p, k, list(floor(total / held) ORDER BY i) AS e
  FROM (
    SELECT x.p, (best % 256)::INT AS k, i, sum(x.e[i]) AS total, count(*) AS held
    FROM a{n} JOIN x USING (vec_id, p), range(1, 17) t(i) GROUP BY ALL
  ) GROUP BY p, k
), c{m} AS MATERIALIZED (
  SELECT p, k, e, list_inner_product(e, e) AS sq
  FROM (SELECT c.p, c.k, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN m{n} m ON m.p = c.p AND m.k = c.k)
)"""
_BALL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, p::INT AS p, e[p * 16 + 1 : p * 16 + 16] AS e, list_inner_product(e[p * 16 + 1 : p * 16 + 16], e[p * 16 + 1 : p * 16 + 16]) AS sq
  FROM v, range(0, 4) t(p)
), c0 AS MATERIALIZED (
  SELECT p, k::INT AS k, e, sq FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v) USING (vec_id) WHERE k < 256
), """ + ", ".join(_ASSIGN.format(n=n) + ", " + _MOVE.format(n=n, m=n + 1) for n in range(4)) + ", " + _ASSIGN.format(n=4) + """, r AS (
  SELECT vec_id, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error
  FROM a4 GROUP BY vec_id
), b AS (
  SELECT sha256(string_agg(array_to_string(list_transform(e, lambda z: z::BIGINT::VARCHAR), ','), ',' ORDER BY p, k)) AS digest FROM c4
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM r JOIN v USING (vec_id), b
"""

_MULTI = """
WITH RECURSIVE g AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  coalesce(vec_id = least(vec_id, coalesce(least, vec_id)), false) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS hex,
    regexp_extract_all(coalesce(text, ''), '[ \\t-\\r]*[^ \\t-\\r]+|[ \\t-\\r]+') AS u
  FROM documents
), h AS (
  SELECT *, len(u)::BIGINT AS n, list_transform(range(0, 4), lambda k: ('0x' || substr(hex, 8 * k + 1, 8))::BIGINT) AS h FROM d
), f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN doc_id IS NULL OR t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), s AS (
  SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM s
"""

ORACLES = {"op11_ball_codes": _BALL, "op12_multi_index": _MULTI, "op13_fenwick_middle": _MIDDLE, "op1_arc_to_warc": _ARC, "op5_kd_top_k": _KD}
