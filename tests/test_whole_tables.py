"""Queries over tables with odd rows, and operators at sizes where the plain way would not end, against SQL and brute force."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from evidra.operators import markdown, retrieval, tables
from evidra.plans import catalogue
from test_catalogue import SMALL, TABLES, rows


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The small tables with documents that are empty, missing, blank, or begin with blank lines."""
    d = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    text = "CASE doc_id % 9 WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 4 THEN '  ' WHEN 5 THEN chr(10) || '  ' || chr(10) || text WHEN 7 THEN chr(13) || text ELSE text END"
    for t in TABLES:
        here = f"{d}/{t}.parquet"
        if t == "documents":
            c.sql(f"copy (select * replace ({text} as text) from '{SMALL}/documents.parquet') to '{here}'")
        else:
            Path(here).symlink_to(f"{SMALL}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{here}'")
    return str(d), c


@pytest.mark.parametrize("name", ["invalid_records", "rebuild_verification", "markdown_pages"])
def test_query_gives_the_rows_of_its_sql_over_odd_texts(spark, odd, name):
    path, duck = odd
    got = catalogue.queries()[name](spark, path).toPandas()
    assert rows(got) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


def test_reading_order_of_tables_at_one_place_is_by_their_id(spark):
    t = spark.range(0, 400, 1, 7).select(F.lit(1).alias("page"), F.lit(1).alias("box_id"), (F.lit(399) - F.col("id")).alias("table_id"), F.struct(F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0")).alias("rect"))
    assert all(r.ord == r.table_id + 1 for r in tables.reading_order(t).collect())


def _share(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))


def _rows_of_joins(df):
    """Rows that each join of the executed plan makes."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if "AdaptiveSparkPlan" in p.nodeName():
            return walk(p.executedPlan())
        if "QueryStage" in p.nodeName():
            return walk(p.plan())
        if "Join" in p.nodeName():
            out.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return out


def _boxes(spark, rng, n, places):
    at = [(x := rng.randrange(300), y := rng.randrange(300), x + rng.choice([20, 40]), y + rng.choice([20, 30])) for _ in range(places)]
    own = [(rng.randrange(2), i, tuple(map(float, rng.choice(at)))) for i in range(n)]
    return own, spark.createDataFrame(own, "page int, id int, b struct<x0:double,y0:double,x1:double,y1:double>").withColumnRenamed("b", "box")


def test_boxes_at_few_places_are_matched_place_by_place(spark):
    rng = random.Random(5)
    boxes, b = _boxes(spark, rng, 300, 25)
    found, t = _boxes(spark, rng, 300, 25)
    extra = boxes[:40]  # tables that lie in a box wholly, and one without a place
    found += [(p, 1000 + i, r) for p, i, r in extra] + [(0, 5000, None)]
    t = spark.createDataFrame(found, "page int, table_id int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    out = tables.match_boxes(b.withColumnRenamed("id", "box_id"), t)
    want = {}
    for p, i, r in found:
        shares = [(_share(q, r), k) for o, k, q in boxes if o == p and r]
        best = max(shares, default=(0, 0))[0]
        near = [k for s, k in shares if abs(s - best) <= tables.TIE]
        want[p, i] = (None, "unmatched") if best < 0.7 else (near[0], "matched") if len(near) == 1 else (None, "ambiguous")
    assert {(r.page, r.table_id): (r.box_id, r.status) for r in out.collect()} == want
    assert len(set(s for _, s in want.values())) > 1 and max(_rows_of_joins(out)) < 10_000  # 50,000 pairs


def test_images_at_few_heights_are_matched_height_by_height(spark):
    rng = random.Random(6)
    images = [(rng.randrange(2), i, t := rng.randrange(0, 300, 15), t + rng.choice([20, 40])) for i in range(300)]
    found = [(rng.randrange(3), i, t := rng.randrange(0, 400, 15), t + rng.choice([20, 30])) for i in range(300)]
    out = tables.match_images(spark.createDataFrame(images, "page int, image_id int, top int, bottom int"), spark.createDataFrame(found, "page int, table_id int, top int, bottom int"))
    want = {}
    for p, i, t0, t1 in found:
        scored = [(-max(0, min(t1, b) - max(t0, t)) / min(t1 - t0, b - t), t, k) for o, k, t, b in images if o == p]
        index = sorted((y, j) for q, j, y, _ in found if q == p).index((t0, i)) + 1
        want[p, i] = (index, min(scored)[2], -min(scored)[0]) if scored else (index, None, None)
    assert {(r.page, r.table_id): (r.table_index, r.image_id, r.ratio) for r in out.collect()} == want
    assert max(_rows_of_joins(out)) < 10_000


def test_grids_of_any_shape_equal_a_plain_search(spark):
    rng = random.Random(7)
    made = [[(r, c, r + 1, c + 1, f"{r}.{c}", None) for r in range(3) for c in range(2)], []]
    made.append(made[0][::-1])  # all places, not in order
    for _ in range(60):
        made.append([(r := rng.randrange(4), c := rng.randrange(4), r + rng.randint(1, 2), c + rng.randint(1, 3), str(i), None) for i in range(rng.randint(1, 9))])
    cells = "array<struct<RowTl:int,ColTl:int,RowBr:int,ColBr:int,Text:string,Confidence:double>>"
    got = spark.createDataFrame(list(enumerate(made)), f"i int, Cells {cells}").select("i", F.transform(tables.occupancy(F.col("Cells")), lambda r: F.transform(r, lambda x: x["Text"])).alias("g"), tables.grid_error(F.col("Cells")).alias("e"))
    for x in got.collect():
        own = made[x.i]
        rows_, columns = max((v[2] for v in own), default=0), max((v[3] for v in own), default=0)
        want = [[next((v[4] for v in own if v[0] <= r < v[2] and v[1] <= c < v[3]), None) for c in range(columns)] for r in range(rows_)]
        assert x.g == want
        over = sum((v[2] - v[0]) * (v[3] - v[1]) for v in own) != sum(t is not None for r in want for t in r)
        assert x.e == ("table has no cells" if not own else "table cells overlap" if over else None)


def test_counting_records_makes_no_texts_and_orphans_meet_once(spark):
    df = spark.createDataFrame([(1, [(0, 0, 1, 1, "a", 1.0)])], "k int, Cells array<struct<RowTl:int,ColTl:int,RowBr:int,ColBr:int,Text:string,Confidence:double>>")
    made = df.select(*(F.lit("d").alias(c) for c in ("doc_id", "doc_title", "page_code", "section_path", "table_title", "source_image")), F.lit(0).alias("page_index"), F.lit(1).alias("table_index"), "Cells")
    counts = tables.block_counts(tables.table_records(made))
    assert "表头" not in counts._jdf.queryExecution().optimizedPlan().toString() and {r.block_type: r.n for r in counts.collect()} == {"table": 1, "table_row": 1}
    some = spark.createDataFrame([("table", "a", None), ("table", "a", None), ("table_row", "b1", "b"), ("table_row", "b2", "b"), ("table", "c", None), ("table_row", "c1", "c"), ("table", None, None), ("table_row", "x", None), ("text", "z", None)], "block_type string, chunk_id string, parent_table_chunk_id string")
    out = tables.orphan_rows(some)
    assert sorted((r.t or "", r.side) for r in out.collect()) == [("", "row"), ("", "table"), ("a", "table"), ("a", "table"), ("b", "row")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_are_counted_by_words(spark):
    from collections import Counter

    from evidra.functions import text as T

    texts = ["", "a", "ab", "abc", "ab ab ab", "  x  yz  ", "long" * 40 + " end", "药 药物\n乳腺癌 𝒳y z", None, "a b", "ab ab ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter(t[i : i + n] for t in texts if t for n in (2, 3) for i in range(len(t) - n + 1))
    out = T.ngram_counts(df)
    assert {r.gram: r.n for r in out.collect()} == want
    many = spark.range(500).select(F.lit("the same words again and again").alias("text"))
    assert T.ngram_counts(many)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3


def test_headings_are_read_in_order_and_not_in_groups(spark):
    """The open headings of a document are carried from batch to batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "3")
        pages = [(d, p, p + 1, f"# Part {p}\n\na\n\n### Deep {d}\n\nb\n\n## Mid\n\nc" if p % 3 == 0 else "d") for d in ("x", "y") for p in range(7)]
        none = spark.createDataFrame([], "doc_id string, page int, image_id int, table_index int")
        got = markdown.convert(spark.createDataFrame(pages, "doc_id string, ord int, page int, body string"), none, "m")
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        rows = sorted((r.doc_id, r.seq, r.section_path) for r in got.collect())
        want = [(d, s) for d in ("x", "y") for p in range(7) for s in ([f"Part {p}", f"Part {p} > Deep {d}", f"Part {p} > Mid"] if p % 3 == 0 else [f"Part {p // 3 * 3} > Mid"])]
        assert [(d, s) for d, _, s in rows] == want
    finally:
        spark.conf.set(name, before)


def test_token_counts_move_instead_of_postings(spark):
    """Unique nodes are counted where they are; nodes that are several rows meet; a missing id counts in tf alone."""
    rows = [(1, "a b a"), (2, "b c"), (2, "c c d"), (3, None), (None, "a z"), (4, "")]
    for some, repeated in ((rows, True), ([r for r in rows if r[0] != 2], False)):
        nodes = spark.createDataFrame([("v", i, t) for i, t in some], "version_id string, node_id long, text string")
        got = retrieval.node_token_stats(nodes)
        want = {t: (sum((x or "").split().count(t) for _, x in some), len({i for i, x in some if i is not None and t in (x or "").split()})) for t in "abcdz"}
        assert {r.token: (r.tf, r.df) for r in got.collect()} == {t: v for t, v in want.items() if v[0]}
        assert repeated or "hashpartitioning(version_id" not in got._jdf.queryExecution().executedPlan().toString()
