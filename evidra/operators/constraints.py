"""Constraints as queries that return what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema

SHA256 = "^[0-9a-f]{64}$"


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def failing(df: DataFrame, check: Column) -> DataFrame:
    return df.where(~F.coalesce(check, F.lit(False)))


def active_twice(versions: DataFrame) -> DataFrame:
    """Guidelines with more than one active version."""
    return versions.where("status = 'active'").groupBy("guideline_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checks(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All constraints over the tables that are given, by name."""
    out: dict[str, DataFrame] = {}
    if "guideline" in t:
        out["guideline key"] = duplicates(t["guideline"], "id")
        out["guideline authority"] = failing(t["guideline"], F.col("authority_level").isin(schema.AUTHORITY_LEVELS))
    if "document_version" in t:
        v = t["document_version"]
        out["version key"] = duplicates(v, "id")
        out["version label"] = duplicates(v, "guideline_id", "version_label")
        out["version status"] = failing(v, F.col("status").isin(schema.VERSION_STATES))
        out["version manifest"] = failing(v, F.col("snapshot_manifest_sha256").isNull() | F.col("snapshot_manifest_sha256").rlike(SHA256))
        out["one active version"] = active_twice(v)
        if "guideline" in t:
            out["version guideline"] = orphans(v, "guideline_id", t["guideline"])
    if "source_file" in t:
        s = t["source_file"]
        out["source key"] = duplicates(s, "id")
        out["source path"] = duplicates(s, "managed_path")
        out["source fields"] = failing(s, F.col("source_kind").isin(schema.SOURCE_KINDS) & F.col("sha256").rlike(SHA256) & (F.col("byte_size") >= 0))
        if "document_version" in t:
            out["source version"] = orphans(s, "document_version_id", t["document_version"])
    if "raw_chunk" in t:
        c = t["raw_chunk"]
        out["chunk key"] = duplicates(c, "id")
        out["chunk ordinal"] = duplicates(c, "source_file_id", "source_ordinal")
        out["chunk id"] = duplicates(c, "source_file_id", "chunk_id")
        out["chunk fields"] = failing(c, (F.col("source_ordinal") >= 1) & F.col("content_sha256").rlike(SHA256))
        if "source_file" in t:
            out["chunk source"] = orphans(c, "source_file_id", t["source_file"])
    if "node" in t:
        n = t["node"]
        out["node key"] = duplicates(n, "node_id")
        out["node fragment"] = duplicates(n, "document_version_id", "raw_chunk_id", "fragment_ordinal")
        out["node fields"] = failing(n, (F.col("fragment_ordinal") >= 0) & (F.col("source_ordinal") >= 1) & (F.col("char_start") >= 0) & (F.col("char_end") >= F.col("char_start")))
        if "raw_chunk" in t:
            out["node chunk"] = orphans(n, "raw_chunk_id", t["raw_chunk"])
    return out


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """(rule, n) of the constraints that are broken."""
    parts = [d.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n")) for name, d in checks(t).items()]
    return reduce(DataFrame.unionByName, parts).where("n > 0")
