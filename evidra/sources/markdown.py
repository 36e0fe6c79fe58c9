"""Page-delimited Markdown and OCR payload sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import OCR_PAYLOAD

#: The mark's own line only: blank lines after it belong to the page. Lines end with \\n alone, as in Python.
PAGE_MARK = r"(?md)^## PDF page (\d+)[^\S\n]*$"


def split_pages(text: Column) -> Column:
    """array<struct<page, body>>: what follows each page mark; what stands before the first is page 0."""
    marks = F.regexp_extract_all(text, F.lit(PAGE_MARK), 1)
    bodies = F.split(text, PAGE_MARK, -1)
    return F.transform(bodies, lambda b, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(marks, i - 1).cast("int")).alias("page"), b.alias("body")))


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ord, page, body). A file without any page mark is an error."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    bare = whole.where(~F.col("value").rlike(PAGE_MARK)).select("path").limit(1).collect()
    if bare:
        raise ValueError(f"no page marks in {bare[0]['path']}")
    return whole.select("path", F.posexplode(split_pages(F.col("value"))).alias("ord", "p")).select("path", "ord", "p.page", "p.body")


def read_json_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, v): one JSON object for each file; anything else is an error."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    wrong = whole.where(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT")).select("path").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['path']} must hold a JSON object")
    return whole


def parse_payload(json: Column) -> Column:
    """Table detections of an OCR answer, whether or not it is wrapped in ``Response``."""
    inner = F.coalesce(F.get_json_object(json, "$.Response"), json)
    return F.from_json(inner, OCR_PAYLOAD)


def valid_detections(payload: Column) -> Column:
    """Detections of the types 1 and 2, which are the ones with a table grid."""
    return F.filter(F.coalesce(payload["TableDetections"], F.array()), lambda d: d["Type"].isin("1", "2"))


def strict_detections(json: Column) -> Column:
    """Detections whose type is the number 1 or 2, of an answer that is not wrapped; null without a list of detections.

    A type that is a text doesn't count here. ``operators.tables.detection_error`` tells what else is wrong with one.
    """
    listed = F.try_variant_get(F.try_parse_json(json), "$.TableDetections", "array<variant>")
    kinds = F.transform(listed, lambda d: F.schema_of_variant(F.try_variant_get(d, "$.Type", "variant")))
    whole = F.from_json(json, OCR_PAYLOAD)["TableDetections"]
    return F.when(listed.isNotNull(), let(kinds, lambda known: F.filter(whole, lambda d, i: (F.get(known, i) == "BIGINT") & d["Type"].isin("1", "2"))))
