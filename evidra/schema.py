"""Schemas, domains and keys of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _schema(**kinds: object) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


S, I, L, D, B, T = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType(), TimestampType()

# The states and kinds that stored rows may have.
AUTHORITY_LEVELS = ["primary_guideline", "primary_publication", "secondary_summary"]
VERSION_STATES = ["draft", "active", "superseded", "archived"]
SOURCE_KINDS = ["pdf", "html", "jsonl"]
CHANGE_TYPES = ["added", "removed", "modified", "unchanged"]

GUIDELINE = _schema(id=S, title=S, title_zh=S, publisher=S, language=S, authority_level=S, created_at=T)
VERSION = _schema(
    id=S, guideline_id=S, version_label=S, status=S, snapshot_path=S, snapshot_manifest_sha256=S, published_at=T, approved_at=T, created_at=T
)
SOURCE_FILE = _schema(
    id=S, document_version_id=S, source_kind=S, original_path=S, managed_path=S, sha256=S, byte_size=L, provenance_json=S, created_at=T
)
RAW_CHUNK = _schema(id=S, source_file_id=S, source_ordinal=L, chunk_id=S, text=S, content_sha256=S, locator_json=S)
NODE = _schema(
    node_id=S, document_version_id=S, raw_chunk_id=S, fragment_ordinal=I, source_ordinal=L, content_sha256=S, char_start=I, char_end=I, metadata_json=S
)
VERSION_DIFF = _schema(
    id=S, prior_version_id=S, current_version_id=S, change_type=S, prior_raw_chunk_id=S, current_raw_chunk_id=S, chunk_id=S, detail_json=S
)
AUDIT_EVENT = _schema(id=L, actor=S, action=S, entity_type=S, entity_id=S, payload_json=S, created_at=T)

#: Chunk columns read from a contract record, typed; nullable as the contract has them.
CHUNK = _schema(
    chunk_id=S, doc_id=S, doc_title=S, section_path=S, page_code=S, page_start=L, page_end=L, block_type=S, text=S,
    part=L, part_count=L, parent_h1=S, heading_level=L, table_id=S, table_index=L, table_title=S, table_row_index=L, parent_table_chunk_id=S,
    table_row_count=L, table_column_count=L, table_cell_count=L, source_image=S, ocr_confidence_min=D, ocr_confidence_mean=D,
)

CELL = _schema(RowTl=I, ColTl=I, RowBr=I, ColBr=I, Text=S, Confidence=D)
POINT = _schema(X=D, Y=D)
DETECTION = _schema(Type=S, TableCoordPoint=ArrayType(POINT), Cells=ArrayType(CELL))
OCR_PAYLOAD = _schema(TableDetections=ArrayType(DETECTION))
BOX = _schema(x0=D, y0=D, x1=D, y1=D)
CANDIDATE_PAGE = _schema(page_index=I, page_number=I, image_name=S, boxes=ArrayType(BOX), scaled_boxes=ArrayType(BOX))
