"""Version diffs: a full outer join of two versions' chunks on chunk_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import diff_id, normalize_text, text_sha256


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def compare(prior: DataFrame, current: DataFrame, prior_id: str, current_id: str, normalized: Column | None = None, check: bool = True) -> DataFrame:
    """One row for each chunk_id of two versions, by what became of it: added, removed, modified or unchanged.

    Inputs have id, chunk_id and text. Texts are compared by the digest of their normalised form (``normalized``, an
    expression over ``text``; NFKC and white space by default). The order is that of chunk_id.
    """
    if prior_id == current_id:
        raise ValueError("the versions to compare must differ")
    if check:
        for side, chunks in (("prior", prior), ("current", current)):
            if twice := duplicate_chunks(chunks).limit(1).collect():
                raise ValueError(f"duplicate chunk_id {twice[0]['chunk_id']} in the {side} version")
    form = normalize_text(F.col("text")) if normalized is None else normalized
    a = prior.select("chunk_id", F.col("id").alias("prior_raw_chunk_id"), text_sha256(form).alias("prior_sha"))
    b = current.select("chunk_id", F.col("id").alias("current_raw_chunk_id"), text_sha256(form).alias("current_sha"))
    change = (
        F.when(F.col("prior_raw_chunk_id").isNull(), "added")
        .when(F.col("current_raw_chunk_id").isNull(), "removed")
        .when(F.col("prior_sha") == F.col("current_sha"), "unchanged")
        .otherwise("modified")
    )
    detail = F.to_json(
        F.struct("chunk_id", F.col("current_sha").alias("current_normalized_sha256"), F.col("prior_sha").alias("prior_normalized_sha256")),
        {"ignoreNullFields": "false"},
    )
    return a.join(b, "chunk_id", "full_outer").select(
        diff_id(F.lit(prior_id), F.lit(current_id), F.col("chunk_id")).alias("id"),
        F.lit(prior_id).alias("prior_version_id"),
        F.lit(current_id).alias("current_version_id"),
        change.alias("change_type"),
        "prior_raw_chunk_id",
        "current_raw_chunk_id",
        "chunk_id",
        detail.alias("detail_json"),
    )


def summary(diffs: DataFrame) -> DataFrame:
    """Rows of each change type of each pair of versions."""
    return diffs.groupBy("prior_version_id", "current_version_id", "change_type").agg(F.count(F.lit(1)).alias("n"))
