"""Contract-checked JSONL sources, and reports on them.

Lines are numbered from 1 as they stand in the file, so a file is read whole and split inside Spark; files are the unit
of parallelism. Checks look at the raw record, because a typed read cannot tell an absent key from a null one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nodes import OPTIONAL_FIELDS, REQUIRED_FIELDS


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, source_ordinal, line) of every physical line; a final line end makes no line."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.regexp_replace("value", r"(\r\n|\n|\r)\z", "")
    return whole.where("value <> ''").select(
        "path", F.posexplode(F.split(body, r"\r\n|\n|\r", -1)).alias("pos", "line")
    ).select("path", (F.col("pos") + 1).cast("long").alias("source_ordinal"), "line")


def _kind(field: str) -> F.Column:
    return F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant"))


def validate_lines(lines: DataFrame, required: list[str] = REQUIRED_FIELDS) -> DataFrame:
    """``lines`` with the record as variant ``v``, its ``present`` keys, and ``error``: what is wrong with it, null if nothing.

    The order of checks: empty, not JSON, not an object, a field missing, chunk_id or text of a wrong type, chunk_id
    seen before in the file. A record with a duplicate key counts as not JSON.
    """
    parsed = lines.withColumn("v", F.try_parse_json("line")).withColumn("present", F.json_object_keys(F.to_json("v")))
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("present"))
    chunk_id = F.try_variant_get("v", "$.chunk_id", "string")
    own = (
        F.when(F.trim("line") == "", F.lit("empty JSONL record"))
        .when(F.col("v").isNull(), F.lit("invalid JSON"))
        .when(~F.schema_of_variant("v").startswith("OBJECT"), F.lit("record must be an object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing required field "), F.array_join(missing, ", ")))
        .when((F.coalesce(_kind("chunk_id"), F.lit("VOID")) != "STRING") | (F.coalesce(chunk_id, F.lit("")) == ""), F.lit("chunk_id must be a non-empty string"))
        .when(F.coalesce(_kind("text"), F.lit("VOID")) != "STRING", F.lit("text must be a string"))
    )
    checked = parsed.withColumn("chunk_id", chunk_id).withColumn("own_error", own)
    seen = F.row_number().over(Window.partitionBy("path", "chunk_id").orderBy("source_ordinal")) > 1
    return checked.withColumn(
        "error", F.when(F.col("own_error").isNotNull(), F.col("own_error")).when(seen, F.concat(F.lit("duplicate chunk_id "), F.col("chunk_id")))
    ).drop("own_error")


def first_errors(validated: DataFrame) -> DataFrame:
    """(path, source_ordinal, error): the first wrong line of each file."""
    wrong = validated.where("error is not null")
    return wrong.groupBy("path").agg(F.min_by(F.struct("source_ordinal", "error"), "source_ordinal").alias("e")).select("path", "e.source_ordinal", "e.error")


def read_chunks(spark: SparkSession, paths: str | list[str], source_file_id: str | None = None, strict: bool = True) -> DataFrame:
    """Raw chunks of contract files: id, source_file_id, source_ordinal, chunk_id, text, content_sha256, v, present.

    ``strict`` raises at the first wrong line, as ``line N: ...``; otherwise wrong lines are left out.
    """
    validated = validate_lines(read_lines(spark, paths))
    if strict:
        wrong = first_errors(validated).orderBy("path").limit(1).collect()
        if wrong:
            raise ValueError(f"line {wrong[0]['source_ordinal']}: {wrong[0]['error']}")
    source = F.lit(source_file_id) if source_file_id else F.element_at(F.split("path", "/"), -1)
    text = F.try_variant_get("v", "$.text", "string")
    return validated.where("error is null").select(
        F.concat_ws(":", source, "chunk_id").alias("id"),
        source.alias("source_file_id"),
        "source_ordinal",
        "chunk_id",
        text.alias("text"),
        F.sha2(text, 256).alias("content_sha256"),
        "v",
        "present",
    )


def locator_json(present: F.Column, record: F.Column) -> F.Column:
    """The record's contract fields but id and text, as canonical JSON; unknown keys are dropped."""
    known = [f for f in REQUIRED_FIELDS + OPTIONAL_FIELDS if f not in ("chunk_id", "text")]
    parts = []
    for f in sorted(known):
        value = F.coalesce(F.to_json(F.try_variant_get(record, f"$.{f}", "variant")), F.lit("null"))
        parts.append(F.when(F.array_contains(present, f), F.concat(F.lit(f'"{f}":'), value)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def line_report(records: DataFrame, required: list[str] = REQUIRED_FIELDS) -> DataFrame:
    """(path, record_count, missing_fields, ids_unique) of validated lines: the fields that some record of a file lacks."""
    missing = F.explode_outer(F.array_except(F.array(*map(F.lit, required)), F.col("present")))
    counts = records.groupBy("path").agg(F.count(F.lit(1)).alias("record_count"), (F.count_distinct("chunk_id") == F.count("chunk_id")).alias("ids_unique"))
    gaps = records.select("path", missing.alias("field")).groupBy("path").agg(F.array_sort(F.collect_set("field")).alias("missing_fields"))
    return counts.join(gaps, "path").select("path", "record_count", "missing_fields", "ids_unique")


def contract_report(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict[str, object]]:
    """For each file: digest, size, records, missing fields, whether ids are unique; and the totals over all files."""
    files = spark.read.format("binaryFile").load(paths).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size")
    )
    records = validate_lines(read_lines(spark, paths)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    per_file = files.join(line_report(records), "path", "left").select(
        "path", "sha256", "byte_size", F.coalesce("record_count", F.lit(0)).alias("record_count"),
        F.coalesce("missing_fields", F.array().cast("array<string>")).alias("missing_fields"), F.coalesce("ids_unique", F.lit(True)).alias("ids_unique"),
    )
    total = records.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count("chunk_id").alias("with_id")).first()
    return per_file.orderBy("path"), {"total_records": total["n"], "ids_globally_unique": total["ids"] == total["with_id"]}
