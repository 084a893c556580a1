"""The registered queries op1 to op13: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compaction, divergence, mixing, packing, piece_codec, pii, quality, set_join, token_store, toxicity, vector_join, warc, whitening
from .common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, seq_len=2048)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_store.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_token_files(spark, path)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.near_duplicate_classes(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op5_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = compaction.ShardStore(spark, fresh_path(spark, "shards"))
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    return compaction.content_digest(store.read())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.stored_ledger(_table(spark, sf_dir, "documents"))
    base_failed = F.col("failures").bitwiseAND(F.lit(quality.BASE_MASK).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), quality.passes(quality.CURRENT_POLICY).alias("kept"), "failures", quality.alone(quality.CURRENT_POLICY).alias("rejected_by_alone"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.convert(warc.arc_files(_table(spark, sf_dir, "pages")), path, least_bytes=100)
    return warc.read_warcs(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = piece_codec.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    ids = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return piece_codec.decode(ids, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(whitening.whiten(_table(spark, sf_dir, "embeddings"), most=32))


_ALL = (
    op1_packing, op2_token_files, op3_ngram_jaccard_join, op4_pii, op5_size_tiered_compaction, op6_quality_rules, op7_mixing, op8_toxicity,
    op9_arc_to_warc, op10_embedding_near_dedup, op11_source_divergence, op12_sentencepiece, op13_embedding_whitening,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: DuckDB SQL of those queries whose rows SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op11_source_divergence": """
        WITH d AS (
          SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
        ), w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
        k AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
        ls AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY ALL),
        g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
        gs AS (SELECT lang, source, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
        f AS MATERIALIZED (
          SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(gs.n, 0) + 2 * ls.v) AS p,
                 1 + 1000000000::HUGEINT * (k.n + 2) // (ls.n + 2 * ls.v) AS q
          FROM g JOIN k USING (lang) JOIN ls USING (lang) LEFT JOIN gs USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), met AS (
          SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
        ), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM f WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) u)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INT) AS rank FROM ranked WHERE part = 'pair' OR r <= 10""",
    "op5_size_tiered_compaction": "SELECT doc_id, source, lang, length(text) AS text_chars, md5(text) AS text_md5 FROM documents",
    "op9_arc_to_warc": """
        WITH p AS (
          SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
}
