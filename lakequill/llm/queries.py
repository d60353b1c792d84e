"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakequill.llm import fingerprint, flat_graph, mixing, ngram_join, pii, quality, sentencepieces, sharding, suffix_dedup, warc

#: Where the vocabulary of the SentencePiece queries lies unless a caller names another file.
MODEL_PATH = os.environ.get("LAKEQUILL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def pii_key(spark: SparkSession) -> str:
    """The key of the pseudonyms: spark.lakequill.pii.key or LAKEQUILL_PII_KEY; on the synthetic tables, a public one."""
    return spark.conf.get("spark.lakequill.pii.key", None) or os.environ.get("LAKEQUILL_PII_KEY") or "public key for synthetic tables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode_documents(docs, sentencepieces.read_model(model_path), back="round_trip").select("doc_id", "n_pieces", "piece_ids", "round_trip")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonym_rows(table(spark, sf_dir, "documents"), pii_key(spark))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


_QUERIES = (op1_warc, op2_mixing, op3_sentencepiece, op4_sharding, op5_quality, op6_ngram_jaccard, op7_pii, op8_suffix_dedup, op9_embedding_dedup, op10_fingerprint)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


_WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS head FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN head IS NOT NULL AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS NOT NULL AND head <> page_id THEN head END AS refers_to,
       CASE WHEN head IS NULL OR head = page_id THEN true END AS verified
FROM p LEFT JOIN f USING (d)
"""

OP2 = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size FROM documents),
     summed AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
     placed AS (SELECT source, s, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS w FROM summed),
     ordered AS (SELECT *, row_number() OVER (ORDER BY (3 * s)::DOUBLE / w, source NULLS LAST) AS k FROM placed),
     running AS (SELECT *, (SELECT sum(s) FROM placed)::HUGEINT - coalesce(sum(3 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS rest,
                           (SELECT sum(w) FROM placed)::HUGEINT - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS share FROM ordered),
     turn AS (SELECT k, rest, share FROM running WHERE w * rest <= 3 * s * share ORDER BY k LIMIT 1),
     plan AS (SELECT o.source, o.s, CASE WHEN o.k < t.k THEN (3 * o.s)::DOUBLE ELSE (o.w * t.rest)::DOUBLE / t.share::DOUBLE END AS target FROM ordered o, turn t),
     rated AS (SELECT doc_id, sized.source, size, s AS source_size, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate, substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS draw
               FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source),
     drawn AS (SELECT source, draw, sum(size)::DOUBLE AS words FROM rated GROUP BY source, draw),
     lined AS (SELECT source, draw, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn),
     told AS (SELECT r.*, floor(rate) + CASE WHEN rate > floor(rate) AND before + words / 2 <= target - floor(rate) * source_size THEN 1 ELSE 0 END AS copies
              FROM rated r JOIN lined l ON r.source IS NOT DISTINCT FROM l.source AND r.draw = l.draw)
SELECT doc_id, size, source_size, target, copies::BIGINT * size AS taken, copies::BIGINT AS copies FROM told
"""

OP4 = """
WITH RECURSIVE crc AS (SELECT range AS b, list_reduce([range::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256)),
     crcs AS (SELECT list(t ORDER BY b) AS t FROM crc),
     d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(coalesce(text, '')) AS h, doc_id::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END AS key FROM documents),
     summed AS (SELECT doc_id, size, key, xor(list_reduce([4294967295::BIGINT] || [('0x' || b)::BIGINT FOR b IN regexp_extract_all(h, '..')],
                                                        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crcs),
     jump AS (SELECT doc_id, coalesce(key, 0) AS s, -1::BIGINT AS b, 0::BIGINT AS j FROM d
              UNION ALL
              SELECT doc_id, g, j, floor((j + 1) * (2147483648::DOUBLE / ((g // 8589934592) + 1)::DOUBLE))::BIGINT
              FROM (SELECT doc_id, j, (s * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS g FROM jump WHERE j < 41)),
     dealt AS (SELECT doc_id, max(j) FILTER (j < 40) AS shard, max(j) FILTER (j < 41) AS grown_shard FROM jump GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard
FROM summed JOIN dealt USING (doc_id)
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
     block AS (SELECT doc_id, j, substr(h, 200 * j + 1, 398) AS h FROM (SELECT doc_id, h, unnest(range((n + 99) // 100)) AS j FROM d WHERE n >= 100)),
     w AS (SELECT doc_id, 100 * j + i AS k, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, j, h, unnest(range(100)) AS i FROM block) WHERE 2 * i + 200 <= len(h)),
     late AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS place FROM w) WHERE place > 1),
     edge AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS new FROM late),
     part AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS i FROM edge),
     span AS (SELECT doc_id, i, min(k) AS a, max(k) + 100 AS b FROM part GROUP BY doc_id, i),
     gap AS (SELECT doc_id, i, b - a AS size, substr(h, 2 * before + 1, 2 * (a - before)) AS piece, CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END AS tail
             FROM (SELECT s.*, h, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before, lead(b) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS last FROM span s JOIN d USING (doc_id))),
     cut AS (SELECT doc_id, sum(size)::BIGINT AS gone, count(*) AS spans, string_agg(piece || tail, '' ORDER BY i) AS kept FROM gap GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, {_WORD}) AS w FROM documents WHERE text IS NOT NULL),
     g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS gram FROM w WHERE len(w) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
     pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     link AS (SELECT a, b, shared = x.n AND shared = y.n AS same FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * shared >= 4 * (x.n + y.n)),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
     comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
     own AS (SELECT a, count(*) AS links, min(CASE WHEN same THEN b END) AS twin FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, c AS component_id, coalesce(links, 0)::BIGINT AS n_links
FROM documents JOIN comp ON comp.a = doc_id LEFT JOIN own ON own.a = doc_id
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
     u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS m FROM v WHERE len(e) > 0 AND list_inner_product(e, e) > 0),
     link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.m * b.m) >= 0.95),
     reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
     comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
     own AS (SELECT a, count(*) AS links FROM link GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept, 1.0::DOUBLE AS audited_recall
FROM v JOIN comp ON comp.a = vec_id LEFT JOIN own ON own.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against brute force in tests/llm."""
    return {"op1_warc": OP1, "op2_mixing": OP2, "op4_sharding": OP4, "op8_suffix_dedup": OP8, "op6_ngram_jaccard": OP6, "op9_embedding_dedup": OP9}
