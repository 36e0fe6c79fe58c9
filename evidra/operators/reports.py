"""Batch jobs and reports: spacing normalisation, release inventory, retrieval acceptance."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.nodes import indexable
from ..functions.text import SPACING_RULES, normalize_spacing, suspicious_spacing
from ..sources.jsonl import read_lines
from .retrieval import SearchRequest, search


@F.pandas_udf(StringType())
def _with_text(lines: pd.Series, texts: pd.Series) -> pd.Series:
    """JSON lines with another text and all other members as they are, their types too; null where there is no other text."""
    return pd.Series([None if t is None else json.dumps(json.loads(v) | {"text": t}, ensure_ascii=False) for v, t in zip(lines, texts, strict=True)], dtype=object)


def write_lines(lines: DataFrame, target: str, order: str = "source_ordinal") -> None:
    """Write ``value`` in the order of a column: parts in order, built aside and renamed into place when they are complete."""
    spark = lines.sparkSession
    staging = f"{target.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    lines.orderBy(order).select("value").write.text(staging)
    jvm = spark.sparkContext._jvm
    path, final = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final) or not fs.rename(path, final):
        fs.delete(path, True)
        raise FileExistsError(f"{target} is there already")


def digest_of_parts(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the digests of a folder's part files, in their order; a part is hashed by the task that reads it."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", F.sha2("content", 256).alias("d"))
    return hashlib.sha256("".join(r["d"] for r in parts.orderBy("path").collect()).encode()).hexdigest()


def spacing_job(spark: SparkSession, source: str, target: str) -> dict[str, object]:
    """Normalise the spacing of a JSONL file's texts into another file's folder, and report what was done.

    A blank line, a line that is no JSON object and a text that is no string are errors, named by line.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("input and output must differ")
    lines = read_lines(spark, source).withColumn("v", F.try_parse_json("line"))
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.text", "variant")), F.lit("VOID"))
    error = (
        F.when(F.trim("line") == "", "empty record")
        .when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "invalid JSON object")
        .when(kind != "STRING", "text must be a string")
    )
    if wrong := lines.withColumn("error", error).where("error is not null").orderBy("source_ordinal").limit(1).collect():
        raise ValueError(f"line {wrong[0]['source_ordinal']}: {wrong[0]['error']}")
    before = F.try_variant_get("v", "$.text", "string")
    after, counts = normalize_spacing(before)
    done = lines.select(
        "source_ordinal", "line", before.alias("before"), after.alias("after"), F.struct(*(c.alias(n) for n, c in counts.items())).alias("counts"),
        F.size(suspicious_spacing(after)).alias("residual"),
    )
    # Only the value of the text changes; lines without a change stay as they were written.
    renewed = _with_text("line", F.when(F.col("before") != F.col("after"), F.col("after")))
    write_lines(done.select("source_ordinal", F.coalesce(renewed, F.col("line")).alias("value")), target)
    changed = F.col("before") != F.col("after")
    row = done.agg(
        F.count(F.lit(1)).alias("record_count"), F.count_if(changed).alias("affected_count"), F.count_if(~changed).alias("unchanged_count"), F.sum("residual").alias("residual_count"),
        *(F.sum(f"counts.{n}").alias(n) for n, _, _ in SPACING_RULES),
    ).first().asDict()
    rules = {n: row.pop(n) or 0 for n, _, _ in SPACING_RULES}
    read = spark.read.format("binaryFile").load([source]).select(F.sha2("content", 256)).first()[0]
    return row | {"replacement_count": sum(rules.values()), "rule_counts": rules, "input_sha256": read, "output_sha256": digest_of_parts(spark, target)}


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, sha256) of all files below a folder, for a release manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def indexable_counts(nodes: DataFrame) -> DataFrame:
    """(version_id, total, indexable, excluded)."""
    flag = indexable(*(F.col(c) for c in ("text", "block_type", "section_path", "retrieval_role", "page_start")))
    return nodes.groupBy("version_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("indexable"), F.count_if(~flag).alias("excluded"))


def acceptance(nodes: DataFrame, resolved: Sequence[tuple[str, str]], queries: Sequence[str], encoder: object, glossary: dict, top_k: int = 3) -> DataFrame:
    """The hits of a fixed set of queries, with BM25, as one table with the query in front."""
    parts = []
    for q in queries:
        found = search(nodes, resolved, SearchRequest(q, top_k=top_k, use_bm25=True), encoder, glossary).evidence
        parts.append(found.select(F.lit(q).alias("query"), "position", "node_id", "guideline_id", "score"))
    return reduce(DataFrame.unionByName, parts)
