"""From raw documents to token ids: quality, line dedup, near-dedup, mixing, SentencePiece.

Each stage works on all rows its predecessor kept, and is written as Parquet in the shared folder and read
again, so that a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import dart_minhash, gam, line_dedup, pfair_mix, spm_trie, staging
from evidra.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 1."""
    model = gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gam.score(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten documents or more have; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return dart_minhash.deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix."""
    return pfair_mix.in_order(pfair_mix.mix_sources(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text, and whether they decode to it."""
    return spm_trie.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixing), ("sentencepiece", encoding)]

#: Classifiers, signatures and the tokenizer can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = staging.new_path(spark, f"pipeline-{name}")
        with staging.scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            staging.delete(spark, before)
        before = path
    return docs
