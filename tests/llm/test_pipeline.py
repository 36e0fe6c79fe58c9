import corpus_pipeline
from evidra.llm import queries, staging

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_clean_rows_and_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staging.stage(stage(spark, seen, SMALL), "test-stage")
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id for r in seen.select("doc_id").collect()}
        assert ids <= before
        if name == "quality":
            good = {i for i, q in labels.items() if q == 1}
            assert len(good & ids) >= 0.97 * len(good) and len({i for i, q in labels.items() if q == 0} & ids) <= 2
        if name in ("line_dedup", "mixing"):
            assert ids == before
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in out.select("n_chars", "text").collect())
        if name == "near_dedup":
            from evidra.llm import dart_minhash

            left = {r.doc_id: r.class_id for r in dart_minhash.classes(seen).collect()}
            assert ids == {i for i, c in left.items() if i == c}
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SMALL).collect()
    assert len(last) == seen.count() and all(r.round_trip for r in last)


def test_stages_take_empty_and_odd_tables(spark, docs_schema):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c\nd", "en", None, 7), (2, "a b c\nd", "en", None, 7), (3, "x " * 60_000, "de", "s", 120_000)]
    for data in ([], rows):
        docs = spark.createDataFrame([(*r, 1) for r in data], docs_schema + ", band int")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() <= len(data), name


def test_queries_have_the_columns_of_their_contracts(spark):
    want = {
        "op1": ["query_id", "rank", "vec_id", "score"], "op2": ["doc_id", "held_out", "score", "predicted"], "op4": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op5": ["query_id", "rank", "vec_id", "score"], "op6": ["doc_id", "held_out", "lang_pred", "score"], "op7": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        "op10": ["page_id", "url", "text", "n_chars"],
    }
    kinds = {"rank": "int", "vec_id": "bigint", "held_out": "boolean", "predicted": "int", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "n_chars": "bigint"}
    for name, query in queries.queries().items():
        if columns := want.get(name.split("_")[0]):
            df = query(spark, SMALL)
            assert set(columns) <= set(df.columns), name
            assert all(kinds.get(c, k) == k for c, k in df.dtypes if c in columns), (name, df.dtypes)
