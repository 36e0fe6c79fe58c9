"""Queries of the training-data operators over the whole tables, and their SQL where there is one.

Each takes (spark, sf_dir) and derives the columns of its contract from what its operator gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, dart_minhash, ecoc_langid, gam, html_blocks, learned_partitions, line_dedup, pfair_mix, spm_trie, staging, token_store


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file is; it has the same place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.fit(docs, _read(spark, sf_dir, "labels"))
    return gam.score(docs, model, keep_text=False)


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(_read(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = staging.new_path(spark, "token-store")
    token_store.write_store(_read(spark, sf_dir, "documents"), store, tokenizer_path("word_bpe_49k.json"))
    return token_store.read_digests(spark, store)


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return ecoc_langid.predict(docs.select("doc_id", "text"), ecoc_langid.fit(docs), keep_text=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digest(line_dedup.dedup_lines(docs, min_docs=10, min_chars=1))


def op8_spm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return spm_trie.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pfair_mix.mix_sources(docs).drop("text")


def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_pages(_read(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_cover_tree, op2_quality_gam, op3_dart_minhash, op4_token_store, op5_learned_partitions, op6_ecoc_langid,
            op7_line_dedup, op8_spm_trie, op9_pfair_mix, op10_line_blocks, pipeline,
        )
    }


_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP7 = """
WITH lines AS (
  SELECT doc_id, rn, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT doc_id, rn, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos
    FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
), frequent AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rn) >= 10
), marked AS (
  SELECT l.*, f.key IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rn, doc_id
"""


def oracle_sql() -> dict[str, str]:
    out = {"op1_cover_tree": _OP1, "op7_line_dedup": _OP7}
    import corpus_pipeline

    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
