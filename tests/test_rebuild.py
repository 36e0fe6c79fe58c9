from pyspark.sql import functions as F

from evidra.operators import rebuild, tables
from evidra.schema import CHUNK

GRID = "doc_id string, page_index int, grid_id int, bbox struct<x0:double,y0:double,x1:double,y1:double>, column_count int, rows array<struct<bottom:double,cells:array<struct<x0:double,y0:double,x1:double,y1:double>>>>, texts array<array<string>>"
PAYLOAD = "struct<TableDetections:array<struct<Type:string,TableCoordPoint:array<struct<X:double,Y:double>>,Cells:array<struct<RowTl:int,ColTl:int,RowBr:int,ColBr:int,Text:string,Confidence:double>>>>>"
BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def detection(x0, y0, x1, y1, *texts, kind="1"):
    points = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return (kind, [tuple(map(float, p)) for p in points], [(i, 0, i + 1, 1, t, 90.0) for i, t in enumerate(texts)])


def plain_cells(rows, texts, columns):
    """The same by loops."""
    out, seen = [], set()
    for r, (_, cells) in enumerate(rows):
        for c, box in enumerate(cells):
            if box is None or tuple(round(v, 4) for v in box) in seen:
                continue
            seen.add(tuple(round(v, 4) for v in box))
            ends = [k + 1 for k in range(r, len(rows)) if rows[k][0] >= box[3] - 0.5]
            nexts = [k for k in range(c + 1, columns) if cells[k] is not None]
            out.append((r, c, ends[0] if ends else len(rows), nexts[0] if nexts else columns, texts[r][c] or "", None))
    return out


def test_vector_cells_equal_loops(spark):
    merged = [(10.0, [(0.0, 0.0, 20.0, 10.0), None, (20.0, 0.0, 30.0, 19.8)]), (20.0, [(0.0, 10.0, 10.0, 20.0), (10.0, 10.0, 20.0, 20.0), (20.00001, 0.0, 30.0, 19.8)])]
    tall = [(5.0, [(0.0, 0.0, 5.0, 99.0), (5.0, 0.0, 9.0, 5.0)]), (9.0, [None, (5.0, 5.0, 9.0, 9.0)])]
    cases = [(merged, [["a", "no", None], ["b", "c", "again"]], 3), (tall, [["x", "y"], ["", "z"]], 2), ([(1.0, [None, None])], [["", ""]], 2)]
    rows = [("d", i, 0, (0.0, 0.0, 1.0, 1.0), n, r, t) for i, (r, t, n) in enumerate(cases)]
    got = spark.createDataFrame(rows, GRID).select("page_index", rebuild.vector_cells(F.col("rows"), F.col("texts"), F.col("column_count")).alias("c")).collect()
    for row in got:
        want = plain_cells(*cases[row.page_index])
        assert (None if row.c is None else [tuple(x) for x in row.c]) == (want or None)
    assert [tuple(x)[:5] for x in got[0].c] == [(0, 0, 1, 2, "a"), (0, 2, 2, 3, ""), (1, 0, 2, 1, "b"), (1, 1, 2, 2, "c")]


def inputs(spark, crops, grids):
    empty = {f: None for f in CHUNK.names}
    kinds = [("paragraph", 0, "A"), ("table", 1, "T"), ("table_row", 1, "R"), ("table", 1, "U"), ("paragraph", 1, "B"), ("table", 2, "V"), ("paragraph", 2, "C")]
    base = [empty | {"chunk_id": f"c{i}", "doc_id": "d", "doc_title": "Doc", "section_path": "S", "block_type": k, "page_start": p, "page_end": p, "text": t, "table_title": "Old" if t == "T" else None} for i, (k, p, t) in enumerate(kinds)]
    baseline = spark.createDataFrame([tuple(b[f] for f in CHUNK.names) + (i,) for i, b in enumerate(base)], CHUNK.simpleString().removeprefix("struct<").removesuffix(">") + ",ord:int")
    two, one = [(0.0, 0.0, 10.0, 10.0), (0.0, 20.0, 10.0, 30.0)], [(0.0, 0.0, 10.0, 10.0)]
    pages = spark.createDataFrame([("d", 1, "p1.png", two, [tuple(2 * v for v in b) for b in two]), ("d", 2, "p2.png", one, [tuple(2 * v for v in b) for b in one])], f"doc_id string, page_index int, image_name string, boxes {BOXES}, scaled_boxes {BOXES}")
    whole = [("d", 1, ([detection(0, 41, 20, 60, "low", "er"), detection(0, 10, 20, 20, "b"), detection(0, 0, 20, 9, "a"), detection(0, 0, 1, 1, "no", kind="0")],)), ("d", 2, ([detection(500, 500, 600, 600, "far")],))]
    answers = spark.createDataFrame(whole, f"doc_id string, page_index int, payload {PAYLOAD}")
    return baseline, pages, answers, spark.createDataFrame(crops, f"doc_id string, page_index int, box_id int, payload {PAYLOAD}"), spark.createDataFrame(grids, GRID)


def test_rebuild_falls_back_by_page_and_box(spark):
    grid = ("d", 2, 0, (0.0, 0.0, 10.0, 10.0), 1, [(10.0, [(0.0, 0.0, 10.0, 10.0)])], [["native"]])
    whole = inputs(spark, [("d", 2, 0, ([],))], [grid, grid[:2] + (1, (50.0, 50.0, 60.0, 60.0)) + grid[4:]])
    out, faults = rebuild.rebuild_tables(*whole)
    assert faults.count() == 0
    rows = out.orderBy("ord").collect()
    assert [(r.block_type, r.page_start, r.table_index) for r in rows if r.block_type != "table_row"] == [
        ("paragraph", 0, None), ("table", 1, 1), ("table", 1, 2), ("table", 1, 3), ("paragraph", 1, None), ("table", 2, 1), ("paragraph", 2, None)
    ]
    titles = {(r.page_start, r.table_index): (r.table_title, r.source_image) for r in rows if r.block_type == "table"}
    assert titles == {(1, 1): ("Old", "p1.png"), (1, 2): ("Old", "p1.png"), (1, 3): ("第3个表格", "p1.png"), (2, 1): ("第1个表格", "p2.png")}
    assert tables.verify_rebuild(whole[0], out).count() == 0
    chosen, _ = rebuild.choose_tables(*whole[1:])
    assert sorted((r.page.page_index, r.box_id, r.ord, r.origin, r.Cells[0].Text) for r in chosen.collect()) == [(1, 0, 1, "page", "a"), (1, 0, 2, "page", "b"), (1, 1, 1, "page", "low"), (2, 0, 1, "vector", "native")]
    told = rebuild.report(whole[0], out, chosen, whole[1])
    assert told["rebuilt_table_count"] == 4 and told["vector_table_count"] == 1 and told["baseline_text_sha256"] == told["rebuilt_text_sha256"] and told["retained_other_count"] == 3

    crop = inputs(spark, [("d", 2, 0, ([detection(0, 0, 9, 9, "crop")],))], [])
    assert {(r.page.page_index, r.origin) for r in rebuild.choose_tables(*crop[1:])[0].collect()} == {(1, "page"), (2, "crop")}


def test_rebuild_names_what_is_missing(spark):
    def rules(*whole):
        return sorted((r.page.page_index, r.box_id, r.rule) for r in rebuild.rebuild_tables(*whole)[1].collect())

    whole = inputs(spark, [], [])
    assert rules(*whole) == [(2, 0, "crop answer")]
    assert rules(*inputs(spark, [("d", 2, 0, ([],))], [])) == [(2, 0, "vector table")]
    assert rules(whole[0], whole[1], whole[2].where("page_index = 1"), *whole[3:]) == [(2, 0, "page answer")]
    few = rebuild.rebuild_tables(whole[0].where("text <> 'V'"), *whole[1:])[1]
    assert {r.rule for r in few.where("page.page_index = 2").collect()} == {"box count", "crop answer"}
