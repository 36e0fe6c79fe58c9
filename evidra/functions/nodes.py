"""Nodes, whether they are searched, and their citations, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They decide results, and must stay as they are.
REQUIRED_FIELDS = ["chunk_id", "doc_id", "doc_title", "section_path", "page_code", "page_start", "page_end", "block_type", "text"]
OPTIONAL_FIELDS = [
    "part", "part_count", "parent_h1", "heading_level", "table_id", "table_index", "table_title", "table_row_index", "parent_table_chunk_id",
    "table_row_count", "table_column_count", "table_cell_count", "source_image", "ocr_confidence_min", "ocr_confidence_mean",
]
ALWAYS_BLOCKS = ["table", "table_row", "algorithm"]
NEVER_SECTIONS = ["图书在版", "指南工作委员会", "table of contents", "copyright", "front matter", "front-matter", "目录", "cip"]
NEVER_ROLES = ["cover", "toc", "credits", "copyright", "legal", "metadata"]
IDENTITY_MARKS = ["guideline", "指南", "nccn", "csco", "caca", "breast cancer", "乳腺癌"]
CONTENT_MARKS = ["治疗", "诊断", "筛查", "乳腺癌", "therapy", "treatment", "recurrent", "metastatic", "breast cancer"]
IMPRINT_MARKS = ["isbn", "出版社", "定价", "publisher"]
PAGE_WORDS, NO_PLACE = "PDF 页序号 ", "未提供定位信息"


def _has_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def indexable(
    text: Column, block_type: Column, section_path: Column, role: Column, page_start: Column, explicit: Column | None = None
) -> Column:
    """Whether a node takes part in search: the first rule that applies decides."""
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    size, low = F.char_length(body), F.lower(body)
    section, role = F.lower(F.coalesce(section_path, F.lit(""))), F.lower(F.coalesce(role, F.lit("")))
    page = F.expr("try_cast(null as bigint)") if page_start is None else page_start.try_cast("double").try_cast("bigint")
    rules = F.when(F.coalesce(body, F.lit("")) == "", False)
    if explicit is not None:
        said = F.lower(F.trim(explicit.cast("string")))
        rules = F.when(explicit.isNotNull(), ~said.isin("false", "0", "no")).when(F.coalesce(body, F.lit("")) == "", False)
    return (
        rules.when(body.rlike(r"(?U)\A[\d\s./:;,_-]+\z"), False)
        .when(F.lower(F.coalesce(block_type, F.lit(""))).isin(ALWAYS_BLOCKS), True)
        .when(_has_any(section, NEVER_SECTIONS), False)
        .when(role.isin(NEVER_ROLES), False)
        .when((role == "front_matter") & ~(_has_any(low, CONTENT_MARKS) & (size >= 350)), False)
        .when((page <= 1) & (size < 350) & _has_any(low, IDENTITY_MARKS), False)
        .when((page <= 5) & (size < 700) & _has_any(low, IMPRINT_MARKS), False)
        .otherwise(True)
    )


def locator(source_kind: Column, page_start: Column, page_end: Column, parent_h1: Column, section_path: Column) -> Column:
    """Where a chunk stands: PDF pages from 1, or headings, or that no place is known."""
    first = page_start + 1
    last = F.coalesce(page_end + 1, first)
    pages = F.when(last == first, F.concat(F.lit(PAGE_WORDS), first.cast("string"))).otherwise(
        F.concat(F.lit(PAGE_WORDS), first.cast("string"), F.lit("–"), last.cast("string"))
    )
    heads = F.concat_ws(" > ", F.nullif(parent_h1, F.lit("")), F.nullif(section_path, F.lit("")))
    return F.when((source_kind == "pdf") & page_start.isNotNull(), pages).otherwise(
        F.when(heads != "", heads).otherwise(F.lit(NO_PLACE))
    )


def citation(row: dict[str, Column]) -> Column:
    """The citation struct of a node's columns."""
    return F.struct(
        row["doc_title"].alias("source_title"),
        row["guideline_id"].alias("guideline_id"),
        row["version_id"].alias("version_id"),
        locator(row["source_kind"], row["page_start"], row["page_end"], row["parent_h1"], row["section_path"]).alias("locator"),
        row["authority_level"].alias("source_level"),
        row["source_ordinal"].alias("source_ordinal"),
        row["raw_chunk_id"].alias("raw_chunk_id"),
    )


def metadata_json(fields: dict[str, Column], present: Column | None = None) -> Column:
    """Canonical JSON (key-sorted, compact) of a node's metadata. With ``present``, an array of the keys that the record
    has, contract fields outside it are left out; those in it stay even where they are null."""
    contract = set(REQUIRED_FIELDS + OPTIONAL_FIELDS) - {"text"}
    parts = []
    for name in sorted(fields):
        value = F.to_json(F.struct(fields[name].alias("v")), {"ignoreNullFields": "false"})
        part = F.concat(F.lit(f'"{name}":'), F.regexp_extract(value, r"(?s)^\{\"v\":(.*)\}$", 1))
        parts.append(F.when(F.array_contains(present, name), part) if present is not None and name in contract else part)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def build_nodes(chunks: DataFrame) -> DataFrame:
    """One node for each chunk: (node_id, document_version_id, raw_chunk_id, fragment_ordinal, char_start, char_end, content_sha256, ...).

    ``chunks`` has guideline_id, version_id, raw_chunk_id, chunk_id, source_ordinal, text and any metadata columns.
    """
    return chunks.select(
        F.concat_ws(":", "guideline_id", "version_id", "chunk_id", F.lit("0")).alias("node_id"),
        F.lit(0).alias("fragment_ordinal"),
        F.lit(0).alias("char_start"),
        F.char_length("text").alias("char_end"),
        F.sha2("text", 256).alias("content_sha256"),
        "*",
    )
