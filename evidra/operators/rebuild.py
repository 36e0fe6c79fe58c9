"""The table rebuild: tables recognised on whole pages, on crops where a page fails, and vector grids where a crop shows none.

All inputs are keyed by (doc_id, page_index). A page's tables come from its own answer only if every table lies in one box and every box has a
table; otherwise each box of the page takes its crop's answer, and the native grid of the file where that answer has no table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from ..sources.markdown import valid_detections
from . import tables

# What decides spans and matches of native grids, and the title of a table that has none.
EDGE, VECTOR_BOX, RECT_PLACES = 0.5, 0.95, 4
UNTITLED = "第%d个表格"
#: Records of one digest of texts.
DIGEST_ROWS = 10_000
KEY = ("doc_id", "page_index")


def vector_cells(rows: Column, texts: Column, columns: Column) -> Column:
    """OCR-style cells of a native grid, null if it has none.

    ``rows`` is array<struct<bottom, cells array<box>>> with a null box where a merged cell goes on, ``texts`` the matrix of texts. A box met again (to 4 places)
    is one cell. A cell goes down to the first row that ends half a point above its lower edge or lower, and right over the null boxes that follow.
    """

    def placed(bottoms: Column) -> Column:
        def of_row(row: Column, r: Column) -> Column:
            def cell(box: Column, c: Column) -> Column:
                down = F.array_position(F.transform(F.slice(bottoms, r + 1, F.size(bottoms)), lambda b: b >= box["y1"] - EDGE), True).cast("int")
                right = F.array_position(F.transform(F.slice(row["cells"], c + 2, columns), lambda b: b.isNotNull()), True).cast("int")
                return F.when(
                    box.isNotNull(),
                    F.struct(
                        F.array(*(F.round(box[e], RECT_PLACES) for e in ("x0", "y0", "x1", "y1"))).alias("key"),
                        r.alias("RowTl"), c.alias("ColTl"),
                        F.when(down > 0, r + down).otherwise(F.size(bottoms)).alias("RowBr"), F.when(right > 0, c + right).otherwise(columns).alias("ColBr"),
                        F.coalesce(F.get(F.get(texts, r), c), F.lit("")).alias("Text"), F.lit(None).cast("double").alias("Confidence"),
                    ),
                )

            return F.filter(F.transform(row["cells"], cell), lambda x: x.isNotNull())

        return F.flatten(F.transform(rows, of_row))

    def distinct(found: Column) -> Column:
        return let(F.transform(found, lambda x: x["key"]), lambda keys: F.filter(found, lambda x, i: F.array_position(keys, x["key"]) == i + 1))

    cells = let(F.transform(rows, lambda r: r["bottom"]), lambda bottoms: let(placed(bottoms), distinct))
    plain = F.transform(cells, lambda x: F.struct(*(x[f].alias(f) for f in ("RowTl", "ColTl", "RowBr", "ColBr", "Text", "Confidence"))))
    return F.when(F.size(plain) > 0, plain)


def vector_tables(boxes: DataFrame, grids: DataFrame) -> DataFrame:
    """(page, box_id, Cells): the native grid that lies best in each box; null cells where none does by 0.95.

    ``boxes`` has (page, box_id, box) in points, ``grids`` (page, grid_id, bbox, column_count, rows, texts). Of grids as good the first is taken.
    """
    scored = boxes.join(grids, "page", "left").withColumn("ratio", tables.overlap(F.col("bbox"), F.col("box")))
    first = F.row_number().over(Window.partitionBy("page", "box_id").orderBy(F.desc_nulls_last("ratio"), "grid_id"))
    best = scored.withColumn("_n", first).where("_n = 1")
    return best.select("page", "box_id", F.when(F.col("ratio") >= VECTOR_BOX, vector_cells(F.col("rows"), F.col("texts"), F.col("column_count"))).alias("Cells"))


def _boxes(pages: DataFrame) -> DataFrame:
    both = F.posexplode(F.arrays_zip("boxes", "scaled_boxes")).alias("box_id", "b")
    return pages.select(F.struct(*KEY).alias("page"), both).select("page", "box_id", F.col("b.boxes").alias("box"), F.col("b.scaled_boxes").alias("scaled"))


def choose_tables(pages: DataFrame, answers: DataFrame, crops: DataFrame, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables in the boxes of all pages (page, box_id, ord, Cells, origin), and what is missing (page, box_id, rule).

    ``pages`` has the key, ``boxes`` and ``scaled_boxes``; ``answers`` the key and ``payload``; ``crops`` the key, ``box_id`` (from 0) and ``payload``; ``grids`` the key and
    the columns of ``vector_tables``. The origin is page, crop or vector.
    """
    boxes = _boxes(pages)
    keyed = answers.select(F.struct(*KEY).alias("page"), valid_detections(F.col("payload")).alias("found"))
    detected = keyed.select("page", F.posexplode("found").alias("table_id", "t")).select(
        "page", "table_id", tables.rectangle(F.col("t.TableCoordPoint")).alias("rect"), F.col("t.Cells").alias("Cells")
    )
    detected = detected.join(boxes.select("page").distinct(), "page", "left_semi")
    targets = boxes.select("page", "box_id", F.col("scaled").alias("box"))
    matches = tables.match_boxes(targets, detected.drop("Cells"))
    failed = matches.where("status <> 'matched'").select("page").unionByName(tables.boxes_without_table(targets, matches).select("page")).distinct()
    fits = matches.join(failed, "page", "left_anti").select("page", "table_id", "box_id")
    whole = tables.reading_order(detected.join(fits, ["page", "table_id"])).select("page", "box_id", "ord", "Cells", F.lit("page").alias("origin"))

    shown = crops.select(F.struct(*KEY).alias("page"), "box_id", valid_detections(F.col("payload")).alias("found"))
    needed = boxes.join(failed, "page", "left_semi").join(shown, ["page", "box_id"], "left")
    cropped = needed.select("page", "box_id", F.posexplode("found").alias("ord", "t")).select("page", "box_id", (F.col("ord") + 1).alias("ord"), "t.Cells", F.lit("crop").alias("origin"))
    native = vector_tables(needed.where(F.size("found") == 0).select("page", "box_id", "box"), grids.withColumn("page", F.struct(*KEY)).drop(*KEY))
    vector = native.where("Cells is not null").select("page", "box_id", F.lit(1).alias("ord"), "Cells", F.lit("vector").alias("origin"))

    unanswered = boxes.join(keyed.select("page"), "page", "left_anti").select("page", "box_id", F.lit("page answer").alias("rule"))
    uncropped = needed.where("found is null").join(keyed.select("page"), "page", "left_semi").select("page", "box_id", F.lit("crop answer").alias("rule"))
    faults = unanswered.unionByName(uncropped).unionByName(native.where("Cells is null").select("page", "box_id", F.lit("vector table").alias("rule")))
    return whole.unionByName(cropped).unionByName(vector), faults


def _contexts(baseline: DataFrame) -> DataFrame:
    """Tables of the baseline, numbered from 0 within their page as its boxes are."""
    number = F.row_number().over(Window.partitionBy("doc_id", "page_start").orderBy("ord")) - 1
    known = baseline.where("block_type = 'table' and page_start is not null")
    page = F.struct("doc_id", F.col("page_start").cast("int").alias("page_index"))
    return known.select(page.alias("page"), number.alias("box_id"), "doc_title", "page_code", "section_path", "table_title")


def rebuild_tables(baseline: DataFrame, pages: DataFrame, answers: DataFrame, crops: DataFrame, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The baseline with its tables rebuilt, and faults (page, box_id, rule); the records count only if there are no faults.

    ``baseline`` has ord and the chunk fields. The tables of a page stand in the place of its first one; tables of pages that are not among ``pages`` go. A table
    whose context has no title is named by its number.
    """
    pages = pages.withColumn("page_index", F.col("page_index").cast("int"))
    chosen, faults = choose_tables(pages, answers.withColumn("page_index", F.col("page_index").cast("int")), crops.withColumn("page_index", F.col("page_index").cast("int")), grids.withColumn("page_index", F.col("page_index").cast("int")))
    contexts = _contexts(baseline)
    have = contexts.groupBy("page").agg(F.count(F.lit(1)).alias("have"))
    counted = pages.select(F.struct(*KEY).alias("page"), F.size("boxes").alias("want")).join(have, "page", "left").where("want <> coalesce(have, 0)")
    faults = faults.unionByName(counted.select("page", F.lit(None).cast("int").alias("box_id"), F.lit("box count").alias("rule")))
    images = pages.select(F.struct(*KEY).alias("page"), "image_name")
    index = F.row_number().over(Window.partitionBy("page").orderBy("box_id", "ord"))
    title = F.when(F.coalesce(F.col("table_title"), F.lit("")) != "", F.col("table_title")).otherwise(F.format_string(UNTITLED, "table_index"))
    named = (
        chosen.withColumn("table_index", index).join(contexts, ["page", "box_id"]).join(images, "page")
        .select("page.doc_id", "page.page_index", "doc_title", "page_code", "section_path", "table_index", title.alias("table_title"), F.col("image_name").alias("source_image"), "Cells")
    )
    return tables.rebuild(baseline, tables.table_records(named)), faults


def text_digest(records: DataFrame) -> str:
    """Digest of the texts of records that are no tables, in order; joined by runs, so that no task holds all of them."""
    plain = records.where(~F.col("block_type").isin("table", "table_row"))
    n = plain.select("doc_id", "text", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("n"))
    one = F.array_sort(F.collect_list(F.struct("n", F.sha2(F.col("text"), 256).alias("d"))))
    runs = n.groupBy("doc_id", F.floor((F.col("n") - 1) / DIGEST_ROWS).alias("run")).agg(F.sha2(F.array_join(F.transform(one, lambda x: x["d"]), ""), 256).alias("d"))
    return hashlib.sha256("".join(r["d"] for r in runs.orderBy("doc_id", "run").toLocalIterator()).encode()).hexdigest()


def report(baseline: DataFrame, rebuilt: DataFrame, chosen: DataFrame, pages: DataFrame) -> dict[str, object]:
    """Counts of a rebuild, and the digests that show that nothing but tables changed."""
    counts = chosen.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") == "vector").alias("v"), F.sum(F.size("Cells")).alias("c")).first()
    kinds = {r["block_type"]: r["n"] for r in tables.block_counts(rebuilt).collect()}
    before = {r["block_type"]: r["n"] for r in tables.block_counts(baseline).collect()}
    return {
        "candidate_page_count": pages.count(), "baseline_table_count": before.get("table", 0), "rebuilt_table_count": counts["n"], "rebuilt_row_count": kinds.get("table_row", 0),
        "vector_table_count": counts["v"], "raw_cell_count": counts["c"] or 0, "retained_other_count": sum(n for k, n in kinds.items() if k not in ("table", "table_row")),
        "baseline_text_sha256": text_digest(baseline), "rebuilt_text_sha256": text_digest(rebuilt),
    }
