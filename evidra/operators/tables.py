"""Recognised tables: grids with spans, row texts, records, HTML, and matching to boxes and images.

A table is one row with its array of cells, and the grid is built inside that row with array functions: tables are small and many, so
nothing is exploded or shuffled until records are wanted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import inline_text, let

# Words of row texts and thresholds that decide matches.
TITLE, HEADER, ROW = "表格：", "\n表头：", "\n第"
MATCH_BOX, MATCH_IMAGE, TIE = 0.70, 0.8, 1e-9


def rows_of(cells: Column) -> Column:
    return F.coalesce(F.array_max(cells["RowBr"]), F.lit(0))


def columns_of(cells: Column) -> Column:
    return F.coalesce(F.array_max(cells["ColBr"]), F.lit(0))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _plain(cells: Column, columns: Column) -> Column:
    """Whether the cells fill a grid row by row, each one place; their order then tells a place's cell."""

    def elsewhere(x: Column, i: Column) -> Column:
        at = x["RowTl"].cast("long") * columns + x["ColTl"]
        one = (at == i) & (x["ColTl"] >= 0) & (x["ColTl"] < columns) & (x["RowBr"] == x["RowTl"] + 1) & (x["ColBr"] == x["ColTl"] + 1)
        return ~F.coalesce(one, F.lit(False))

    return (F.size(cells) == rows_of(cells).cast("long") * columns) & (F.size(F.filter(cells, elsewhere)) == 0)


def occupancy(cells: Column) -> Column:
    """array<array<cell>>: the cell at each place of the grid, null where there is none; the first of several."""

    def places(of_row: Column, columns: Column) -> Column:
        covers = lambda c: F.filter(of_row, lambda x: (x["ColTl"] <= c) & (x["ColBr"] > c))
        return F.transform(_upto(columns), lambda c: F.get(covers(c), F.lit(0)))

    def grid(columns: Column) -> Column:
        rows = _upto(rows_of(cells))
        by_row = F.transform(rows, lambda r: let(F.filter(cells, lambda x: (x["RowTl"] <= r) & (x["RowBr"] > r)), lambda own: places(own, columns)))
        return F.when(_plain(cells, columns), F.transform(rows, lambda r: F.slice(cells, r * columns + 1, columns))).otherwise(by_row)

    return let(columns_of(cells), grid)


def _held(cells: Column) -> Column:
    """How many places of the grid have a cell."""

    def at(columns: Column) -> Column:
        def places(x: Column) -> Column:
            across = F.sequence(x["ColTl"], x["ColBr"] - 1)
            return F.flatten(F.transform(F.sequence(x["RowTl"], x["RowBr"] - 1), lambda r: F.transform(across, lambda c: r.cast("long") * columns + c)))

        return F.when(_plain(cells, columns), F.size(cells)).otherwise(F.size(F.array_distinct(F.flatten(F.transform(cells, places)))))

    return let(columns_of(cells), at)


def grid_error(cells: Column) -> Column:
    """What is wrong with a table's cells; null if they make a grid."""
    bad = F.exists(cells, lambda x: x["RowTl"].isNull() | x["ColTl"].isNull() | x["RowBr"].isNull() | x["ColBr"].isNull())
    low = F.exists(cells, lambda x: (x["RowTl"] < 0) | (x["ColTl"] < 0))
    flat = F.exists(cells, lambda x: (x["RowBr"] <= x["RowTl"]) | (x["ColBr"] <= x["ColTl"]))
    area = F.aggregate(cells, F.lit(0), lambda s, x: s + (x["RowBr"] - x["RowTl"]) * (x["ColBr"] - x["ColTl"]))
    return (
        F.when(cells.isNull() | (F.size(cells) == 0), "table has no cells")
        .when(bad, "cell coordinates must be integers")
        .when(low, "cell coordinates must not be negative")
        .when(flat, "cell spans must be positive")
        .when(F.exists(cells, lambda x: x["Text"].isNull()), "cell text must be a string")
        .when(area != _held(cells), "table cells overlap")
    )


def grid_cells(tables: DataFrame, cells: str = "Cells") -> DataFrame:
    """One row for each covered grid place: the columns of ``tables``, then r, c and the cell's fields."""
    others = [x for x in tables.columns if x != cells]
    one = tables.select(*others, F.explode(cells).alias("x"))
    wide = one.select(*others, "x", F.explode(F.sequence(F.col("x.RowTl"), F.col("x.RowBr") - 1)).alias("r"))
    return wide.select(*others, "r", F.explode(F.sequence(F.col("x.ColTl"), F.col("x.ColBr") - 1)).alias("c"), "x.*")


def _label(first: Column, last: Column) -> Column:
    """Name of a column, or of several."""
    return F.when(first == last, F.concat(F.lit("第"), first.cast("string"), F.lit("列"))).otherwise(
        F.concat(F.lit("第"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("列"))
    )


def _bases(top: Column, paged: bool) -> Column:
    """Texts of the first row's places; a place without text has its column's name."""

    def base(x: Column, i: Column) -> Column:
        text = F.when(x.isNull(), "").otherwise(inline_text(x["Text"], not paged))
        if paged:
            return F.when(x.isNull() | (x["Text"] == ""), _label(i + 1, i + 1)).otherwise(text)
        return F.coalesce(F.nullif(text, F.lit("")), _label(i + 1, i + 1))

    return F.transform(top, base)


def _labels(top: Column, bases: Column, paged: bool) -> Column:
    def label(x: Column, i: Column) -> Column:
        own = F.get(bases, i)
        named = F.concat(own, F.lit("（"), _label(i + 1, i + 1), F.lit("）"))
        if paged:
            return F.when(F.size(F.filter(bases, lambda b: b == own)) > 1, named).otherwise(own)
        spans = x.isNotNull() & (x["ColBr"] - x["ColTl"] > 1)
        return F.when(spans | (F.array_position(bases, own) <= i), named).otherwise(own)

    return F.transform(top, label)


def column_labels(cells: Column, paged: bool = False) -> Column:
    """array<string>: labels of the columns by the first row. A repeated label gets its column's name: each of them in the
    ``paged`` form, else all but the first, and columns of a spanning cell always."""
    return let(F.get(occupancy(cells), F.lit(0)), lambda top: let(_bases(top, paged), lambda bases: _labels(top, bases, paged)))


def row_texts(cells: Column, title: Column, paged: bool = False) -> Column:
    """array<string>: a text for each row, the first naming the columns and the rest with a label before each value."""

    def texts(grid: Column, top: Column, labels: Column) -> Column:
        starts = F.transform(top, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        first = lambda s: s["x"]["ColTl"] == s["i"]
        shown = F.filter(starts, (lambda s: s["x"].isNull() | first(s)) if paged else (lambda s: s["x"].isNotNull() & first(s)))
        heads = F.transform(
            shown,
            lambda s: F.when(s["x"].isNull(), F.concat(_label(s["i"] + 1, s["i"] + 1), F.lit("="))).otherwise(
                F.concat(_label(s["x"]["ColTl"] + 1, s["x"]["ColBr"]), F.lit("="), inline_text(s["x"]["Text"], not paged))
            ),
        )
        head = F.concat(F.lit(TITLE), title, F.lit(HEADER), F.array_join(heads, "；"))

        def line(places: Column, r: Column) -> Column:
            values = F.transform(
                places, lambda x, i: F.concat(F.get(labels, i), F.lit("="), F.when(x.isNull(), "").otherwise(inline_text(x["Text"], not paged)))
            )
            return F.when(r == 0, head).otherwise(F.concat(F.lit(TITLE), title, F.lit(ROW), (r + 1).cast("string"), F.lit("行："), F.array_join(values, "；")))

        return F.transform(grid, line)

    return let(
        occupancy(cells),
        lambda grid: let(
            F.get(grid, F.lit(0)), lambda top: let(_bases(top, paged), lambda bases: let(_labels(top, bases, paged), lambda labels: texts(grid, top, labels)))
        ),
    )


def render_html(cells: Column) -> Column:
    """The table as HTML, spans kept: th in the first row, newlines as br, empty cells as a blank."""

    def escaped(t: Column) -> Column:
        return F.replace(F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("<br>"))

    def span(name: str, n: Column) -> Column:
        return F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")

    def cell(x: Column, r: Column, c: Column) -> Column:
        tag = F.when(r == 0, "th").otherwise("td")
        body = F.coalesce(F.nullif(escaped(x["Text"]), F.lit("")), F.lit("&nbsp;"))
        whole = F.concat(F.lit("<"), tag, span("rowspan", x["RowBr"] - x["RowTl"]), span("colspan", x["ColBr"] - x["ColTl"]), F.lit(">"), body, F.lit("</"), tag, F.lit(">"))
        return F.when(x.isNull(), "<td>&nbsp;</td>").when((x["RowTl"] == r) & (x["ColTl"] == c), whole).otherwise("")

    def line(places: Column, r: Column) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(places, lambda x, c: cell(x, r, c)), ""), F.lit("</tr>"))

    return F.concat(F.lit('<table class="ocr-table">'), F.array_join(F.transform(occupancy(cells), line), ""), F.lit("</table>"))


def table_records(tables: DataFrame, paged: bool = False, prefix: str | None = None) -> DataFrame:
    """Chunk records of tables: one for the table and one for each row.

    ``tables`` has doc_id, doc_title, page_index (from 0), page_code, section_path, table_index (from 1), table_title, source_image and Cells.
    The ``paged`` form joins the parent's rows by a blank line, rounds the mean confidence to 2 places and names the page in page_code.
    """
    page = F.col("page_index") + 1
    name = F.format_string("%s_p%03d_t%02d", F.lit(prefix) if prefix else F.col("doc_id"), page, F.col("table_index"))
    confidences = F.filter(F.transform("Cells", lambda x: x["Confidence"]), lambda v: v.isNotNull())
    mean = F.aggregate(confidences, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(confidences), F.lit(0))
    base = tables.select(
        "doc_id", "doc_title", "section_path",
        (F.format_string("PDF-%03d", page) if paged else F.col("page_code")).alias("page_code"),
        F.col("page_index").alias("page_start"), F.col("page_index").alias("page_end"), name.alias("table_id"), "table_index", "table_title",
        rows_of(F.col("Cells")).alias("table_row_count"), columns_of(F.col("Cells")).alias("table_column_count"), F.size("Cells").alias("table_cell_count"),
        "source_image", F.array_min(confidences).alias("ocr_confidence_min"), (F.round(mean, 2) if paged else mean).alias("ocr_confidence_mean"),
        row_texts(F.col("Cells"), F.col("table_title"), paged).alias("_rows"),
    )
    # Numbers are exploded, not texts: whoever doesn't read the texts doesn't make them. Before a plain explode Spark would filter by the array, made anew.
    each = base.withColumn("_r", F.explode_outer(F.sequence(F.lit(0), F.greatest("table_row_count", F.lit(0)))))
    row = F.nullif(F.col("_r"), F.lit(0))
    text = F.when(row.isNull(), F.array_join("_rows", "\n\n" if paged else "\n")).otherwise(F.get("_rows", row - 1))
    return each.select(
        F.when(row.isNull(), F.col("table_id")).otherwise(F.format_string("%s_r%02d", F.col("table_id"), row)).alias("chunk_id"),
        *(c for c in base.columns if c != "_rows"),
        F.when(row.isNull(), "table").otherwise("table_row").alias("block_type"),
        text.alias("text"),
        row.alias("table_row_index"),
        F.when(row.isNotNull(), F.col("table_id")).alias("parent_table_chunk_id"),
    )


def rectangle(points: Column) -> Column:
    """The box around points; null where it has no area."""
    xs, ys = F.transform(points, lambda p: p["X"]), F.transform(points, lambda p: p["Y"])
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when((F.size(points) >= 2) & (F.array_max(xs) > F.array_min(xs)) & (F.array_max(ys) > F.array_min(ys)), box)


def detection_error(detection: Column) -> Column:
    """What is wrong with a detection: its grid, or corners that make no box; null if it is a table."""
    return F.coalesce(grid_error(detection["Cells"]), F.when(rectangle(detection["TableCoordPoint"]).isNull(), "table has no bounds"))


def overlap(a: Column, b: Column) -> Column:
    """Common area as a share of the smaller box; null if one is."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    share = w * h / F.least((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    return F.when(a.isNotNull() & b.isNotNull(), share)


def match_boxes(boxes: DataFrame, tables: DataFrame, least: float = MATCH_BOX) -> DataFrame:
    """Tables with the box of their page that they lie in: (page, table_id, box_id, ratio, status).

    ``boxes`` has (page, box_id, box), ``tables`` (page, table_id, rect). The status is matched, unmatched (no box overlaps
    enough) or ambiguous (several are as good). Pages are joined by equality. Boxes and tables at one place count once in the
    join, with the number of boxes there, and only pairs that overlap enough go on from it.
    """
    places = boxes.groupBy("page", "box").agg(F.count(F.lit(1)).alias("n"), F.min("box_id").alias("box_id"))
    pairs = tables.select("page", "rect").distinct().join(places, "page").withColumn("ratio", overlap(F.col("box"), F.col("rect"))).where(F.col("ratio") >= least - 2 * TIE)
    of_place, of_table = Window.partitionBy("page", "rect"), Window.partitionBy("page", "table_id")
    near = pairs.withColumn("best", F.max("ratio").over(of_place)).where(F.col("best") - F.col("ratio") <= TIE)
    found = near.groupBy("page", "rect").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.min_by("box_id", F.struct(-F.col("ratio"), "box_id")).alias("box_id"))
    whole = tables.select("page", "table_id", "rect").join(found, ["page", "rect"], "left").withColumn("top", F.max("best").over(of_table))
    good = F.coalesce(F.col("best") >= least, F.lit(False))
    each = whole.groupBy("page", "table_id").agg(
        F.max("best").alias("best"), F.sum(F.when(F.col("top") - F.col("best") <= TIE, F.col("n"))).alias("n"), F.min_by("box_id", F.struct(-F.col("best"), "box_id")).alias("box_id")
    )
    status = F.when(~good, "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return each.select(
        "page", "table_id", F.when(good & (F.col("n") == 1), F.col("box_id")).alias("box_id"), F.when(good, F.col("best")).alias("ratio"), status.alias("status")
    )


def boxes_without_table(boxes: DataFrame, matches: DataFrame) -> DataFrame:
    return boxes.join(matches.where("status = 'matched'").select("page", "box_id"), ["page", "box_id"], "left_anti")


def reading_order(tables: DataFrame) -> DataFrame:
    """``tables`` with its place among those of its page and box, from the top and then from the left; at one place the smaller id comes first."""
    order = Window.partitionBy("page", "box_id").orderBy(F.col("rect.y0"), F.col("rect.x0"), "table_id")
    return tables.withColumn("ord", F.row_number().over(order))


def match_images(images: DataFrame, tables: DataFrame, least: float = MATCH_IMAGE) -> DataFrame:
    """Tables with the image of their page that covers most of their height: (page, table_index, image_id, ratio, matched).

    ``images`` has (page, image_id, top, bottom), ``tables`` (page, table_id, top, bottom). The ratio divides by the smaller height, so a
    table larger than its image still matches. Of images as good the upper one is taken; tables are numbered from the top. Images and
    tables at one height count once in the join.
    """
    number = F.row_number().over(Window.partitionBy("page").orderBy("top", "table_id"))
    t = tables.select("page", "table_id", number.alias("table_index"), F.col("top").alias("t0"), F.col("bottom").alias("t1"))
    places = images.groupBy("page", "top", "bottom").agg(F.min("image_id").alias("image_id"))
    height = F.greatest(F.lit(0), F.least("t1", "bottom") - F.greatest("t0", "top"))
    ratio = height / F.least(F.col("t1") - F.col("t0"), F.col("bottom") - F.col("top"))
    scored = t.select("page", "t0", "t1").distinct().join(places, "page").withColumn("ratio", ratio)
    rank = F.struct(F.col("ratio").isNull(), -F.col("ratio"), "top", "image_id")
    found = scored.groupBy("page", "t0", "t1").agg(F.min_by(F.struct("image_id", "ratio", "top"), rank).alias("i")).select("page", "t0", "t1", "i.*")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("page", "t0", "t1")]
    whole = t.alias("t").join(found.alias("f"), same, "left").select("t.page", "table_id", "table_index", "image_id", "ratio", "top")
    each = whole.groupBy("page", "table_id").agg(F.min_by(F.struct("table_index", "image_id", "ratio"), rank).alias("i"))
    return each.select("page", "table_id", "i.*", F.coalesce(F.col("i.ratio") >= least, F.lit(False)).alias("matched"))


def assign_contexts(scores: DataFrame) -> DataFrame:
    """Boxes given to contexts without replacement: contexts in order, each taking the free box with the highest score, then the smaller
    area, then the higher index. ``scores`` has (page, context, box, score, area, x, y); the result is in reading order."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        free, out = set(pdf["box"]), []
        for context, g in pdf.sort_values("context").groupby("context", sort=False):
            g = g[g["box"].isin(free)]
            if g.empty:
                raise ValueError(f"page {pdf['page'].iloc[0]} has fewer boxes than contexts")
            best = g.sort_values(["score", "area", "box"], ascending=[False, True, False]).iloc[0]
            free.discard(best["box"])
            out.append(best)
        found = pd.DataFrame(out).sort_values(["y", "x"])
        return found.assign(ord=range(1, len(found) + 1))[["page", "context", "box", "score", "ord"]]

    return scores.groupBy("page").applyInPandas(take, "page int, context int, box int, score double, ord int")


def first_choice(*candidates: DataFrame) -> DataFrame:
    """Rows of (page, box_id, ...) from the first of several sources that has the box: whole page, then crop, then vector grid."""
    whole = None
    for priority, df in enumerate(candidates):
        tagged = df.withColumn("_p", F.lit(priority))
        whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
    best = F.min("_p").over(Window.partitionBy("page", "box_id"))
    return whole.withColumn("_b", best).where("_p = _b").drop("_p", "_b")


def rebuild(baseline: DataFrame, generated: DataFrame) -> DataFrame:
    """Baseline records with the tables of each rebuilt page in the place of its first table; all others keep their order.

    ``baseline`` has doc_id, ord, page_start, block_type and record fields; ``generated`` the same fields with table_index and
    table_row_index. Records are numbered anew within their document. A page that only one side has is an error that
    ``page_mismatch`` tells.
    """
    is_table = F.col("block_type").isin("table", "table_row")
    first = baseline.where("block_type = 'table'").groupBy("doc_id", "page_start").agg(F.min("ord").alias("_at"))
    kept = baseline.where(~is_table).withColumn("_key", F.struct(F.col("ord").cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")))
    placed = generated.join(first, ["doc_id", "page_start"]).withColumn(
        "_key", F.struct(F.col("_at").cast("long").alias("a"), F.col("table_index").cast("int").alias("b"), F.coalesce(F.col("table_row_index").cast("int"), F.lit(0)).alias("c"))
    )
    fields = [c for c in baseline.columns if c != "ord"]
    whole = kept.select("_key", *fields).unionByName(placed.select("_key", *[c for c in fields if c in placed.columns]), allowMissingColumns=True)
    return whole.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_key"))).drop("_key")


def page_mismatch(baseline: DataFrame, generated: DataFrame) -> DataFrame:
    """Pages with tables on one side only."""
    a = baseline.where("block_type = 'table'").select("doc_id", "page_start").distinct().withColumn("a", F.lit(True))
    b = generated.where("block_type = 'table'").select("doc_id", "page_start").distinct().withColumn("b", F.lit(True))
    return a.join(b, ["doc_id", "page_start"], "full_outer").where("a is null or b is null").select("doc_id", "page_start", F.col("a").isNotNull().alias("in_baseline"))


def verify_rebuild(baseline: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(rule, n) of what a rebuild broke: records that are no tables changed or moved, ids repeated, texts empty."""
    fields = [c for c in baseline.columns if c != "ord" and c in rebuilt.columns]

    def others(df: DataFrame) -> DataFrame:
        return df.where(~F.col("block_type").isin("table", "table_row")).select(F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("n"), *fields)

    a, b = others(baseline), others(rebuilt)
    parts = {
        "record lost or changed": a.exceptAll(b),
        "record added": b.exceptAll(a),
        "chunk_id repeated": rebuilt.groupBy("chunk_id").count().where("count > 1"),
        "text empty": rebuilt.where("text is null or trim(text) = ''"),
    }
    out = None
    for rule, df in parts.items():
        one = df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def block_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("block_type").agg(F.count(F.lit(1)).alias("n"))


def orphan_rows(records: DataFrame) -> DataFrame:
    """Table rows without their table, and tables without rows; each id is met once, with how many tables and rows it has."""
    is_table = F.col("block_type") == "table"
    some = records.where("block_type in ('table', 'table_row')").select(F.when(is_table, F.col("chunk_id")).otherwise(F.col("parent_table_chunk_id")).alias("t"), is_table.alias("table"))
    ids = some.groupBy("t").agg(F.count_if("table").alias("tables"), F.count_if(~F.col("table")).alias("rows"))
    alone = ids.where("t is null or tables = 0 or rows = 0")  # an id that is null meets none
    sides = F.concat(F.array_repeat(F.lit("row"), F.least("rows", F.lit(1)).cast("int")), F.array_repeat(F.lit("table"), F.col("tables").cast("int")))
    return alone.select("t", F.explode(sides).alias("side"))
