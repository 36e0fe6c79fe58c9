"""Page-delimited OCR Markdown to chunk records, as one plan over lines.

A page's body is cut at its table images into stretches, a stretch into blocks at blank lines, and a block into lines. Headings are counted through
a document, so that each line knows the last one before it; only the heading lines themselves meet in order, read in small batches, for the stack of open
headings that stands after each. Paragraphs are normalised and cut to pieces, and pieces of one run (a stretch between headings, of one kind) are packed by a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .tables import match_images

# Forms of the source.
HEADING_LINE = r"^(#{1,6})\s+(\S.*)$"
HEADING = r"(?m)^#{1,6}\s+(.+?)\s*$"
CENTRED = r'(?is)<div\b[^>]*style="[^"]*text-align:\s*center[^"]*"[^>]*>((?:(?!<img\b).)*?)</div>'
TABLE_IMAGE = r'(?is)<div\b[^>]*>\s*<img\b[^>]*\bsrc="([^"]*img_in_table_box_(\d+)_(\d+)_(\d+)_(\d+)\.jpg)[^>]*>\s*</div>'
BLANK_LINES, LINE_END = r"\n[ \t]*\n+", r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"
NOTE_STARTS = ("注：", "注:")
PAGE_TITLE = "PDF page "

RECORD = (
    "doc_id string, seq int, chunk_id string, page int, kind string, section_path string, parent_h1 string, heading_level int, text string, "
    "table_index int, table_title string, source_image string"
)
_PAGE = ["doc_id", "ord", "page"]
_STRETCH = [*_PAGE, "stretch"]


def table_images(pages: DataFrame) -> DataFrame:
    """(doc_id, page, image_id, src, left, top, right, bottom): image places of tables, by their order on the page."""
    groups = F.arrays_zip(*(F.regexp_extract_all("body", F.lit(TABLE_IMAGE), i).alias(n) for i, n in enumerate(("src", "left", "top", "right", "bottom"), 1)))
    return pages.select("doc_id", "page", F.posexplode(groups).alias("image_id", "g")).select(
        "doc_id", "page", "image_id", "g.src", *(F.col(f"g.{n}").cast("int").alias(n) for n in ("left", "top", "right", "bottom"))
    )


def place_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables (doc_id, page, table_id, top, bottom) with the image that each belongs to; a table without one, an image without
    table and a page of tables without image are errors."""
    images = table_images(pages)
    key = F.struct("doc_id", "page").alias("page")
    found = match_images(images.select(key, "image_id", "top", "bottom"), tables.select(key, "table_id", "top", "bottom")).select(
        "page.doc_id", "page.page", "table_id", "table_index", "image_id", "ratio", "matched"
    )
    if bad := found.where("not matched").limit(1).collect():
        raise ValueError(f"page {bad[0]['page']}: table {bad[0]['table_index']} does not overlap a table image")
    if bad := images.join(found, ["doc_id", "page", "image_id"], "left_anti").limit(1).collect():
        raise ValueError(f"page {bad[0]['page']}: a table image has no table")
    return found


def _lines(pages: DataFrame) -> DataFrame:
    """Every line with its place, its heading's level and title if it is one, and how many headings the document has had up to it."""
    cut = pages.where("page > 0").select(*_PAGE, F.posexplode(F.split("body", TABLE_IMAGE, -1)).alias("stretch", "s"))
    blocks = cut.select(*_STRETCH, F.posexplode(F.split("s", BLANK_LINES, -1)).alias("block", "b"))
    lines = blocks.select(*_STRETCH, "block", F.posexplode(F.split("b", LINE_END, -1)).alias("nr", "line"))
    bare = T.strip(F.col("line"))
    lines = lines.withColumn("level", F.nullif(F.char_length(F.regexp_extract(bare, HEADING_LINE, 1)), F.lit(0)))
    so_far = Window.partitionBy("doc_id").orderBy("ord", "stretch", "block", "nr")
    return lines.withColumn("title", T.clean_title(F.regexp_extract(bare, HEADING_LINE, 2))).withColumn("heads", F.count("level").over(so_far))


def _open_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, heads, section, first, depth, last): the headings that are open after each heading line."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = object(), []
        for batch in batches:
            states = []
            for doc, level, title in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "level", "title")), strict=True):
                if doc != now:
                    now, stack = doc, []
                if title and not title.startswith(PAGE_TITLE):  # a skipped level moves up: place in the stack is not level
                    stack = [*stack[: level - 1], title]
                states.append((" > ".join(stack), stack[0], len(stack), stack[-1]) if stack else (None,) * 4)
            of = (pa.array([x[k] for x in states], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("heads"), *of], ["doc_id", "heads", "section", "first", "depth", "last"])

    kind = lines.schema["doc_id"].dataType.simpleString()
    headings = lines.where("level is not null").select("doc_id", "heads", "level", "title").repartition("doc_id").sortWithinPartitions("doc_id", "heads")
    T.small_batches(lines.sparkSession)
    return headings.mapInArrow(fold, f"doc_id {kind}, heads long, section string, first string, depth int, last string")


def _chunks(lines: DataFrame) -> DataFrame:
    """Packed texts with their place: consecutive paragraphs of one kind that no heading parts, up to the size of a chunk."""
    paragraphs = lines.where("level is null").groupBy(*_STRETCH, "block", "heads").agg(F.array_sort(F.collect_list(F.struct("nr", "line"))).alias("ls"))
    plain = paragraphs.select(*_STRETCH, "block", "heads", T.normalize_block(F.array_join(F.col("ls.line"), "\n")).alias("plain"))
    kind = F.when(F.col("plain").startswith(NOTE_STARTS[0]) | F.col("plain").startswith(NOTE_STARTS[1]), "note").otherwise("paragraph")
    pieces = plain.select(*_STRETCH, "block", "heads", kind.alias("kind"), F.posexplode(T.split_long(F.col("plain"))).alias("nr", "piece"))
    order = Window.partitionBy(*_STRETCH).orderBy("heads", "block", "nr")
    now = F.struct("heads", "kind")
    begins = F.coalesce(now != F.lag(now).over(order), F.lit(True)).cast("int")
    runs = pieces.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order)).groupBy(*_STRETCH, "run", "heads", "kind")
    whole = runs.agg(F.array_sort(F.collect_list(F.struct("block", "nr", "piece"))).alias("ps"))
    fits = f"size(a) > 0 and char_length(element_at(a, -1)) + 2 + char_length(p) <= {T.MAX_CHUNK_CHARS}"
    packed = F.expr(
        "aggregate(ps.piece, cast(array() as array<string>), (a, p) -> "
        f"if({fits}, concat(slice(a, 1, size(a) - 1), array(concat(element_at(a, -1), '\\n\\n', p))), concat(a, array(p))))"
    )
    return whole.select(*_STRETCH, "run", "heads", "kind", F.posexplode(packed).alias("nr", "text"))


def _titles(pages: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, page, image_id, table_title): the last heading or centred line of the stretch before an image, where it has one."""
    wanted = placed.select("doc_id", "page", "image_id").distinct()
    before = pages.select("doc_id", "page", F.posexplode(F.split("body", TABLE_IMAGE, -1)).alias("image_id", "s")).join(wanted, ["doc_id", "page", "image_id"])
    marks = before.select("doc_id", "page", "image_id", F.posexplode(F.regexp_extract_all("s", F.lit(f"({HEADING}|{CENTRED})"), 1)).alias("at", "mark"))
    heading = F.col("mark").startswith("#")
    text = T.clean_title(F.when(heading, F.regexp_extract("mark", HEADING, 1)).otherwise(T.html_to_text(F.regexp_extract("mark", CENTRED, 1))))
    named = marks.withColumn("title", text).where((F.col("title") != "") & ~(heading & F.col("title").startswith(PAGE_TITLE)))
    return named.groupBy("doc_id", "page", "image_id").agg(F.max_by("title", "at").alias("table_title"))


def convert(pages: DataFrame, placed: DataFrame, prefix: str) -> DataFrame:
    """Records of documents in reading order: paragraphs, notes, and a row of kind table where each table stands.

    ``pages`` has (doc_id, ord, page, body), ``placed`` is what ``place_tables`` gives. Text before the first page mark makes no record. A heading
    inside a centred element counts as part of it.
    """
    lines = _lines(pages)
    chunks = _chunks(lines).select(
        *_STRETCH, F.lit(0).alias("side"), "run", "nr", "heads", "kind", "text", F.lit(None).cast("int").alias("table_index"), F.lit(None).cast("string").alias("table_title"),
        F.lit(None).cast("string").alias("source_image"),
    ).withColumn("mark", F.format_string("b%03d", F.row_number().over(Window.partitionBy(*_PAGE).orderBy("stretch", "run", "nr"))))
    ends = lines.groupBy(*_STRETCH).agg(F.max("heads").alias("heads"))
    images = table_images(pages).select("doc_id", "page", "image_id", F.col("src").alias("source_image"))
    spots = placed.select("doc_id", "page", "image_id", "table_index").join(images, ["doc_id", "page", "image_id"])
    spots = spots.join(_titles(pages, placed), ["doc_id", "page", "image_id"], "left").withColumnRenamed("image_id", "stretch")
    tables = spots.join(ends, ["doc_id", "page", "stretch"]).select(
        *_STRETCH, F.lit(1).alias("side"), F.lit(0).cast("long").alias("run"), F.col("table_index").alias("nr"), "heads", F.lit("table").alias("kind"), F.lit("").alias("text"),
        "table_index", "table_title", "source_image", F.format_string("t%02d", "table_index").alias("mark"),
    )
    page_name = F.concat(F.lit("PDF第"), F.col("page").cast("string"), F.lit("页"))
    place = F.concat(page_name, F.lit("表格"), F.col("table_index").cast("string"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "stretch", "side", "run", "nr"))
    return chunks.unionByName(tables).join(_open_headings(lines), ["doc_id", "heads"], "left").select(
        "doc_id", seq.alias("seq"), F.concat(F.lit(f"{prefix}_p"), F.format_string("%03d", "page"), F.lit("_"), F.col("mark")).alias("chunk_id"), "page", "kind",
        F.coalesce("section", page_name).alias("section_path"), F.col("first").alias("parent_h1"), F.col("depth").alias("heading_level"), "text", "table_index",
        F.when(F.col("kind") == "table", F.coalesce("table_title", "last", place)).alias("table_title"), "source_image",
    )


def invalid_records(records: DataFrame, required: list[str]) -> DataFrame:
    """(rule, chunk_id) of records without a required value, with an empty text or with an id that another has."""
    empty = records.where("kind <> 'table' and (text is null or trim(text) = '')").select(F.lit("text is empty").alias("rule"), "chunk_id")
    twice = records.groupBy("chunk_id").count().where("count > 1").select(F.lit("chunk_id repeated").alias("rule"), "chunk_id")
    out = empty.unionByName(twice)
    for c in required:
        out = out.unionByName(records.where(F.col(c).isNull()).select(F.lit(f"{c} is missing").alias("rule"), "chunk_id"))
    return out
