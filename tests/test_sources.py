import hashlib
import json

import pytest

from evidra.operators.reports import file_inventory, spacing_job
from evidra.sources import connectors as c
from evidra.sources import jsonl, markdown

RECORD = {"chunk_id": "c1", "doc_id": "d", "doc_title": "D", "section_path": "S", "page_code": None, "page_start": 0, "page_end": None, "block_type": "paragraph", "text": "x"}


def write(path, lines, end="\n"):
    path.write_bytes(("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + end).encode())
    return str(path)


def test_chunks_keep_text_order_and_presence(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [RECORD | {"text": "  Ａ\t"}, RECORD | {"chunk_id": "c2", "part": 2, "extra": 1}], end="")
    rows = jsonl.read_chunks(spark, path, "f").orderBy("source_ordinal").collect()
    assert [(r.id, r.source_ordinal, r.text) for r in rows] == [("f:c1", 1, "  Ａ\t"), ("f:c2", 2, "x")]
    assert rows[0].content_sha256 == hashlib.sha256("  Ａ\t".encode()).hexdigest()
    from pyspark.sql import functions as F

    got = [json.loads(r[0]) for r in jsonl.read_chunks(spark, path, "f").orderBy("source_ordinal").select(jsonl.locator_json(F.col("present"), F.col("v"))).collect()]
    assert got[1] == {k: v for k, v in (RECORD | {"part": 2}).items() if k not in ("chunk_id", "text")} and "part" not in got[0]


@pytest.mark.parametrize(
    ("lines", "error"),
    [
        ([RECORD, "", RECORD], "line 2: empty"), (["{"], "line 1: invalid JSON"), (["[1]"], "line 1: record must be an object"), ([{k: v for k, v in RECORD.items() if k != "page_end"}], "line 1: missing required field page_end"),
        ([RECORD | {"chunk_id": 5}], "chunk_id must be"), ([RECORD | {"chunk_id": ""}], "chunk_id must be"), ([RECORD | {"text": None}], "text must be"), ([RECORD, RECORD | {"chunk_id": "z"}, RECORD], "line 3: duplicate"),
    ],
)
def test_wrong_lines(spark, tmp_path, lines, error):
    with pytest.raises(ValueError, match=error):
        jsonl.read_chunks(spark, write(tmp_path / "a.jsonl", lines), "f")


def test_contract_report(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", [RECORD, RECORD | {"chunk_id": "c2"}])
    b = write(tmp_path / "b.jsonl", [{k: v for k, v in RECORD.items() if k != "doc_id"}])
    rows, total = jsonl.contract_report(spark, [a, b])
    got = [(r.record_count, r.missing_fields, r.ids_unique, r.byte_size) for r in rows.collect()]
    assert [g[:3] for g in got] == [(2, [], True), (1, ["doc_id"], True)] and total == {"total_records": 3, "ids_globally_unique": False}


def test_markdown_pages_and_payloads(spark, tmp_path):
    path = write(tmp_path / "m.md", ["intro", "## PDF page 3", "a", "## PDF page 12  ", "b"])
    assert [(r.page, r.body.strip()) for r in markdown.read_pages(spark, path).orderBy("ord").collect()] == [(0, "intro"), (3, "a"), (12, "b")]
    with pytest.raises(ValueError, match="no page marks"):
        markdown.read_pages(spark, write(tmp_path / "n.md", ["x"]))
    from pyspark.sql import functions as F

    payload = {"Response": {"TableDetections": [{"Type": 1, "Cells": [{"RowTl": 0, "ColTl": 0, "RowBr": 1, "ColBr": 1, "Text": "t", "Confidence": 9}]}, {"Type": 0}]}}
    got = [spark.createDataFrame([(json.dumps(p),)], "j string").select(markdown.valid_detections(markdown.parse_payload(F.col("j")))).first()[0] for p in (payload, payload["Response"], {})]
    assert [len(g) for g in got] == [1, 1, 0] and got[0][0]["Cells"][0]["Text"] == "t"
    assert markdown.read_json_objects(spark, write(tmp_path / "o.json", [payload])).count() == 1
    with pytest.raises(ValueError, match="JSON object"):
        markdown.read_json_objects(spark, write(tmp_path / "p.json", ["[1]"]))


def test_spacing_job_keeps_values_and_their_types(spark, tmp_path):
    odd = {"page_start": 0, "conf": 98.0, "big": 12345678901234567890123, "none": None, "list": [1, "x", {"q": True}], "z": 'ü"\\'}
    record = odd | {"text": "t u m o r \\ ü", "after": "t u m o r"}
    spacing_job(spark, write(tmp_path / "in.jsonl", [record]), str(tmp_path / "out"))
    got = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert got == record | {"text": "tumor \\ ü"} and list(got) == list(record)
    assert [type(got[k]) for k in odd] == [type(v) for v in odd.values()]
    with pytest.raises(FileExistsError):
        spacing_job(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"))
    assert not list(tmp_path.glob("*.tmp"))


def test_spacing_job_and_inventory(spark, tmp_path):
    path = write(tmp_path / "in.jsonl", [RECORD | {"text": "a t u m o r"}, RECORD | {"chunk_id": "c2", "text": "plain"}])
    report = spacing_job(spark, path, str(tmp_path / "out"))
    assert (report["record_count"], report["affected_count"], report["replacement_count"], report["residual_count"]) == (2, 1, 1, 0)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x["text"] for x in lines] == ["a tumor", "plain"]
    with pytest.raises(ValueError, match="line 1"):
        spacing_job(spark, write(tmp_path / "bad.jsonl", [{"text": 5}]), str(tmp_path / "out2"))
    assert file_inventory(spark, str(tmp_path / "out")).count() >= 1


class Answers:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, url, headers, body, timeout):
        self.calls.append((url, headers, body))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a[0], json.dumps(a[1]).encode()


def vectors(*order):
    return {"data": [{"index": i, "embedding": [float(i), 1.0]} for i in order]}


def test_remote_encoder_retries_and_reorders():
    t = Answers((429, {}), OSError(), (200, vectors(1, 0)))
    assert c.RemoteEncoder("https://x/v1", "m", 2, t).encode(["a", "b"]) == [[0.0, 1.0], [1.0, 1.0]] and len(t.calls) == 3
    for answer in ((200, vectors(0)), (200, vectors(0, 0)), (200, {"data": [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": [1.0]}]}), (200, {})):
        with pytest.raises(ValueError):
            c.RemoteEncoder("https://x/v1", "m", 2, Answers(answer)).encode(["a", "b"])
    t = Answers((400, {}))
    with pytest.raises(RuntimeError):
        c.RemoteEncoder("https://x/v1", "m", 2, t).encode(["a"])
    with pytest.raises(ValueError, match="https"):
        c.RemoteEncoder("http://x/v1", "m", 2, t)
    assert "secret" not in repr(c.RemoteEncoder("http://localhost/v1", "m", 2, t, api_key="secret"))


def test_table_ocr_client():
    def client(*answers):
        t, naps = Answers(*answers), []
        return c.TableOcrClient("ocr.example", "ocr", "A", "V", "R", "id", "hidden-key", t, sleep=naps.append, clock=lambda: 1_700_000_000), t, naps

    one, t, naps = client((500, {}), OSError(), (200, {"Response": {"TableDetections": []}}))
    assert one.recognise(b"png") == {"Response": {"TableDetections": []}} and naps == [1.0, 2.0]
    assert t.calls[0][1]["Authorization"].startswith("TC3-HMAC-SHA256 Credential=id/2023-11-14/ocr/tc3_request") and "hidden-key" not in repr(one)
    for answers in (((403, {}),), ((200, {"Response": {"Error": {"Code": "X"}}}),), ((500, {}),) * 3):
        with pytest.raises(RuntimeError):
            client(*answers)[0].recognise(b"png")


def test_connectors_on_tables(spark):
    df = c.encode_column(spark.createDataFrame([(1, "abc"), (2, None)], "i int, text string"), c.HashingEncoder(8))
    got = {r.i: r.embedding for r in df.collect()}
    assert len(got[1]) == 8 and abs(sum(x * x for x in got[1]) - 1) < 1e-5
    files = spark.createDataFrame([("f", bytearray(b"x"))], "path string, content binary")
    wanted = spark.createDataFrame([("f", 0, 1)], "path string, page_index int, expected int")
    reader = lambda content, pages: iter([(0, [(0.0, 5.0, 1.0, 6.0), (0.0, 0.0, 10.0, 4.0)])])
    assert [(r.ord, r.y1, r.sx1) for r in c.discover_tables(files, wanted, reader).collect()] == [(1, 4.0, 20.0)]
