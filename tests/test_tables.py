import pytest
from pyspark.sql import functions as F

from evidra.operators import markdown, tables
from evidra.schema import CELL

CELLS = "array<" + CELL.simpleString() + ">"
SPAN = [(0, 0, 1, 2, "Drug", 90.0), (0, 2, 1, 3, "Dose", None), (1, 0, 2, 1, "A\n x", 80.0), (1, 1, 2, 2, "B", 100.0), (1, 2, 2, 3, "1", None)]


def frame(spark, *cells, **more):
    return spark.createDataFrame([(i, c, *more.values()) for i, c in enumerate(cells)], f"i int, Cells {CELLS}" + "".join(f", {k} string" for k in more))


def test_row_texts_with_spans(spark):
    (got,) = (r[0] for r in frame(spark, SPAN).select(tables.row_texts(F.col("Cells"), F.lit("T"))).collect())
    assert got == ["表格：T\n表头：第1-2列=Drug；第3列=Dose", "表格：T\n第2行：Drug（第1列）=A x；Drug（第2列）=B；Dose=1"]


def test_repeated_and_missing_labels(spark):
    cells = [(0, 0, 1, 1, "X", None), (0, 1, 1, 2, "X", None), (0, 2, 1, 3, "", None), (1, 0, 2, 1, "a\nb", None)]
    rows = frame(spark, cells).select(tables.column_labels(F.col("Cells")), tables.column_labels(F.col("Cells"), paged=True), tables.row_texts(F.col("Cells"), F.lit("T"), paged=True)).first()
    assert rows[0] == ["X", "X（第2列）", "第3列"] and rows[1] == ["X（第1列）", "X（第2列）", "第3列"]
    assert rows[2][1] == "表格：T\n第2行：X（第1列）=a\nb；X（第2列）=；第3列="


@pytest.mark.parametrize(
    ("cells", "error"),
    [
        (SPAN, None), ([], "table has no cells"), ([(0, 0, 1, 1, "a", None), (0, 0, 1, 1, "b", None)], "table cells overlap"), ([(0, -1, 1, 1, "a", None)], "cell coordinates must not be negative"),
        ([(0, 0, 0, 1, "a", None)], "cell spans must be positive"), ([(0, 0, 1, 1, None, None)], "cell text must be a string"), ([(None, 0, 1, 1, "a", None)], "cell coordinates must be integers"),
    ],
)
def test_grid_errors(spark, cells, error):
    assert frame(spark, cells).select(tables.grid_error(F.col("Cells"))).first()[0] == error


def test_html_and_exploded_grid(spark):
    df = frame(spark, SPAN)
    assert df.select(tables.render_html(F.col("Cells"))).first()[0] == (
        '<table class="ocr-table"><tr><th colspan="2">Drug</th><th>Dose</th></tr><tr><td>A<br> x</td><td>B</td><td>1</td></tr></table>'
    )
    assert {(r.r, r.c, r.Text) for r in tables.grid_cells(df).collect()} == {(0, 0, "Drug"), (0, 1, "Drug"), (0, 2, "Dose"), (1, 0, "A\n x"), (1, 1, "B"), (1, 2, "1")}


def test_records(spark):
    df = frame(spark, SPAN).select(
        F.lit("doc").alias("doc_id"), F.lit("D").alias("doc_title"), F.lit(4).alias("page_index"), F.lit(None).cast("string").alias("page_code"), F.lit("S").alias("section_path"), F.lit(2).alias("table_index"),
        F.lit("T").alias("table_title"), F.lit("i.png").alias("source_image"), "Cells",
    )
    got = {r.chunk_id: r for r in tables.table_records(df).collect()}
    assert set(got) == {"doc_p005_t02", "doc_p005_t02_r01", "doc_p005_t02_r02"}
    parent = got["doc_p005_t02"]
    assert (parent.block_type, parent.table_row_count, parent.table_column_count, parent.table_cell_count, parent.ocr_confidence_min, parent.ocr_confidence_mean) == ("table", 2, 3, 5, 80.0, 90.0)
    assert got["doc_p005_t02_r02"].parent_table_chunk_id == "doc_p005_t02" and parent.text.count("\n") == 3
    assert tables.orphan_rows(tables.table_records(df)).count() == 0
    assert {r.page_code for r in tables.table_records(df, paged=True, prefix="x").collect()} == {"PDF-005"}


def test_boxes_and_images(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    boxes = spark.createDataFrame([(1, 1, (0.0, 0.0, 100.0, 100.0)), (1, 2, (200.0, 0.0, 300.0, 100.0)), (1, 3, (200.0, 0.0, 300.0, 100.0))], f"page int, box_id int, box {box}")
    found = spark.createDataFrame([(1, 1, (10.0, 10.0, 90.0, 90.0)), (1, 2, (150.0, 0.0, 260.0, 50.0)), (1, 3, (205.0, 5.0, 250.0, 50.0)), (2, 4, (0.0, 0.0, 1.0, 1.0))], f"page int, table_id int, rect {box}")
    got = {r.table_id: (r.box_id, r.status) for r in tables.match_boxes(boxes, found).collect()}
    assert got == {1: (1, "matched"), 2: (None, "unmatched"), 3: (None, "ambiguous"), 4: (None, "unmatched")}
    assert {r.box_id for r in tables.boxes_without_table(boxes, tables.match_boxes(boxes, found)).collect()} == {2, 3}
    images = spark.createDataFrame([(1, 0, 100, 200), (1, 1, 300, 350)], "page int, image_id int, top int, bottom int")
    t = spark.createDataFrame([(1, "b", 290, 420), (1, "a", 110, 190), (1, "c", 205, 295)], "page int, table_id string, top int, bottom int")
    assert {r.table_id: (r.table_index, r.image_id, r.matched) for r in tables.match_images(images, t).collect()} == {"a": (1, 0, True), "b": (3, 1, True), "c": (2, 0, False)}


def test_contexts_take_boxes_greedily(spark):
    scores = spark.createDataFrame([(1, 0, 0, 0.5, 9.0, 0.0, 50.0), (1, 0, 1, 0.5, 4.0, 0.0, 10.0), (1, 1, 0, 0.1, 9.0, 0.0, 50.0), (1, 1, 1, 0.9, 4.0, 0.0, 10.0)], "page int, context int, box int, score double, area double, x double, y double")
    assert {(r.context, r.box, r.ord) for r in tables.assign_contexts(scores).collect()} == {(0, 1, 1), (1, 0, 2)}


def test_rebuild_keeps_all_but_tables(spark):
    kind = "doc_id string, ord int, page_start int, block_type string, chunk_id string, text string"
    base = spark.createDataFrame([("d", 1, 1, "paragraph", "a", "A"), ("d", 2, 1, "table", "t", "T"), ("d", 3, 1, "table_row", "r", "R"), ("d", 4, 1, "paragraph", "b", "B"), ("d", 5, 1, "table", "u", "U")], kind)
    new = spark.createDataFrame([("d", 1, "table", "n1", "N1", 1, None), ("d", 1, "table_row", "n1r", "N1r", 1, 1), ("d", 1, "table", "n2", "N2", 2, None)], "doc_id string, page_start int, block_type string, chunk_id string, text string, table_index int, table_row_index int")
    out = tables.rebuild(base, new)
    assert [r.chunk_id for r in out.orderBy("ord").collect()] == ["a", "n1", "n1r", "n2", "b"]
    assert tables.verify_rebuild(base, out).count() == 0 and tables.page_mismatch(base, new).count() == 0
    broken = {r.rule: r.n for r in tables.verify_rebuild(base, out.withColumn("text", F.when(F.col("chunk_id") == "b", "").otherwise(F.col("text")))).collect()}
    assert broken == {"record lost or changed": 1, "record added": 1, "text empty": 1}
    first = spark.createDataFrame([(1, 1, "page")], "page int, box_id int, src string")
    second = spark.createDataFrame([(1, 1, "crop"), (1, 2, "crop")], "page int, box_id int, src string")
    assert {(r.box_id, r.src) for r in tables.first_choice(first, second).collect()} == {(1, "page"), (2, "crop")}


def test_markdown_conversion(spark):
    image = '<div style="x"><img src="img/img_in_table_box_10_{}_90_{}.jpg"></div>'
    pages = [
        ("d", 0, 0, "never a record"),
        ("d", 1, 1, "# One\n\nPara a.\n\nPara b.\n\n## Two\n\n" + image.format(100, 200) + "\n\n注：note text\n\n---\n"),
        ("d", 2, 2, '<div style="text-align: center">Centred  title</div>\n\n' + image.format(100, 200) + "\n\n### Three\n\ntail"),
    ]
    df = spark.createDataFrame(pages, "doc_id string, ord int, page int, body string")
    t = spark.createDataFrame([("d", 1, "x", 90, 210), ("d", 2, "y", 100, 200)], "doc_id string, page int, table_id string, top int, bottom int")
    rows = markdown.convert(df, markdown.place_tables(df, t), "k").orderBy("seq").collect()
    assert [(r.chunk_id, r.kind, r.section_path, r.text, r.table_title) for r in rows] == [
        ("k_p001_b001", "paragraph", "One", "Para a.\n\nPara b.", None),
        ("k_p001_t01", "table", "One > Two", "", "Two"),
        ("k_p001_b002", "note", "One > Two", "注：note text", None),
        ("k_p002_b001", "paragraph", "One > Two", "Centred  title", None),
        ("k_p002_t01", "table", "One > Two", "", "Centred title"),
        ("k_p002_b002", "paragraph", "One > Two > Three", "tail", None),
    ]
    with pytest.raises(ValueError, match="has no table"):
        markdown.place_tables(df, t.where("page = 1"))
