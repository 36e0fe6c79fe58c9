import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evidra import config
from evidra.api import EvidenceBase, GlossarySource
from evidra.operators import release, tables
from evidra.operators.registry import Registry
from evidra.operators.snapshot import model_profile
from evidra.sources.connectors import HashingEncoder
from evidra.sources.markdown import strict_detections

CONFIG = {
    "actor": " me ", "version": {"id": "v1", "guideline_id": "g1", "version_label": "2026", "published_at": None}, "language": "zh", "authority_level": "primary_guideline",
    "sources": [{"id": "p", "path": "/a.pdf", "source_kind": "pdf", "provenance": {"role": "cited"}}, {"id": "j", "path": "/a.jsonl", "source_kind": "jsonl"}],
    "jsonl_source_id": "j", "citation_source_id": "p",
}
GUIDELINE = {"id": "g1", "title": "T", "language": "zh", "authority_level": "primary_guideline"}


def test_ingest_config(tmp_path):
    root = tmp_path / "project"
    root.mkdir()

    def load(value, path=root / "c.json"):
        path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
        return config.load_ingest(path, root)

    actor, r = load(CONFIG)
    assert (actor, r.version_id, r.title, r.chunks.path, r.citation.provenance, r.chunks.provenance) == ("me", "v1", "", "/a.jsonl", {"role": "cited"}, {})
    more = CONFIG | {"guideline": GUIDELINE | {"publisher": "P"}, "version": CONFIG["version"] | {"published_at": "2026-01-02"}}
    assert (load(more)[1].title, load(more)[1].publisher, load(more)[1].published_at) == ("T", "P", "2026-01-02")
    for wrong in (
        "{", "[]", CONFIG | {"actor": " "}, CONFIG | {"actor": 3}, CONFIG | {"version": None}, CONFIG | {"authority_level": "x"}, CONFIG | {"sources": CONFIG["sources"][:1]},
        CONFIG | {"sources": CONFIG["sources"] + CONFIG["sources"][:1]}, CONFIG | {"jsonl_source_id": "none"}, CONFIG | {"guideline": GUIDELINE | {"language": "en"}},
    ):
        with pytest.raises(ValueError):
            load(wrong)
    with pytest.raises(ValueError, match="below"):
        load(CONFIG, tmp_path / "outside.json")
    (root / "link.json").symlink_to(tmp_path / "outside.json")
    with pytest.raises(ValueError, match="below"):
        config.load_ingest(root / "link.json", root)


def test_release_is_the_same_for_the_same_files(tmp_path):
    for folder in release.FOLDERS:
        (tmp_path / "data" / folder / "deep").mkdir(parents=True)
    (tmp_path / "data/reports/deep/b.json").write_text("{}")
    (tmp_path / "data/registry/_hidden").write_bytes(b"x" * (release.BLOCK + 5))
    (tmp_path / "data/other").write_text("not in it")
    archive, check = release.build_bundle(str(tmp_path), str(tmp_path / "out"), "1", "data", left_out=("cache",))
    again, _ = release.build_bundle(str(tmp_path), str(tmp_path / "out2"), "1", "data", left_out=("cache",))
    whole = open(archive, "rb").read()
    assert whole == open(again, "rb").read() and open(check).read() == f"{hashlib.sha256(whole).hexdigest()}  data-1.zip\n"
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"data-1.zip", "data-1.zip.sha256"}
    with zipfile.ZipFile(archive) as z:
        told = json.loads(z.read("data/DATA_MANIFEST.json"))
        assert [f["path"] for f in told["files"]] == ["data/registry/_hidden", "data/reports/deep/b.json"] and told["excluded_roots"] == ["data/cache"]
        for f in told["files"]:
            assert hashlib.sha256(z.read(f["path"])).hexdigest() == f["sha256"] and len(z.read(f["path"])) == f["size"]
        assert {i.date_time for i in z.infolist()} == {(1980, 1, 1, 0, 0, 0)}
    (tmp_path / "data/registry/x.TMP").write_text("")
    with pytest.raises(ValueError, match="temporary"):
        release.build_bundle(str(tmp_path), str(tmp_path / "out"), "2", "data")
    (tmp_path / "data/registry/x.TMP").unlink()
    with pytest.raises(FileNotFoundError):
        release.build_bundle(str(tmp_path), str(tmp_path / "out"), "2", "data", ("none",))
    release.write_json(tmp_path / "out" / "r.json", {"a": "ä"})
    assert json.loads((tmp_path / "out" / "r.json").read_text("utf-8")) == {"a": "ä"} and len(list((tmp_path / "out").iterdir())) == 3


def test_strict_detections(spark):
    cell = {"RowTl": 0, "ColTl": 0, "RowBr": 1, "ColBr": 1, "Text": "a"}
    box = [{"X": 0, "Y": 0}, {"X": 2, "Y": 3}]
    kinds = [{"Type": k, "Cells": [cell], "TableCoordPoint": box} for k in (1, "1", 2, 0, None)]
    flat = {"Type": 1, "Cells": [cell], "TableCoordPoint": box[:1]}
    rows = [(0, json.dumps({"TableDetections": kinds})), (1, json.dumps({"Response": {"TableDetections": kinds}})), (2, "{"), (3, json.dumps({"TableDetections": [flat, flat | {"Cells": []}]}))]
    df = spark.createDataFrame(rows, "n int, j string").withColumn("found", strict_detections(F.col("j")))
    got = df.select("n", F.transform("found", lambda d: d["Type"]).alias("t"), F.transform("found", tables.detection_error).alias("e")).orderBy("n").collect()
    assert [r.t for r in got] == [["1", "2"], None, None, ["1", "1"]]
    assert got[0].e == [None, None] and got[3].e == ["table has no bounds", "table has no cells"]


def test_rebased_paths_must_exist(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "r"))
    reg.create_guideline("me", id="g", title="G", language="en", authority_level="secondary_summary")
    reg.create_draft_version("me", id="v", guideline_id="g", version_label="1")
    reg.add_source_file("me", id="s", document_version_id="v", source_kind="pdf", original_path="/o", managed_path="/old/m/a.pdf", sha256="0" * 64, byte_size=1)
    with pytest.raises(FileNotFoundError):
        reg.rebase_paths("me", "/old", str(tmp_path))
    assert [r.managed_path for r in reg.table("source_file").collect()] == ["/old/m/a.pdf"] and reg.table("audit_event").where("action = 'paths_rebased'").isEmpty()
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.pdf").write_text("x")
    assert reg.rebase_paths("me", "/old", str(tmp_path)) == 1


def test_facade_mines_its_glossary_or_falls_back_to_seeds(spark, tmp_path):
    def pairs(*rows):
        return spark.createDataFrame(rows, "english string, chinese string")

    def base(name, seeds):
        source = GlossarySource(str(tmp_path / name), ("g1",), seeds, pairs(("docetaxel", "多西他赛")))
        return EvidenceBase(spark, str(tmp_path / "registry"), str(tmp_path / "snapshots"), str(tmp_path / "managed"), HashingEncoder(16), model_profile("local", "hashing", 16, True, "r1"), source)

    one = base("good", pairs(("therapy", "疗法")))
    assert one.terms() == {"therapy": ["疗法"], "疗法": ["therapy"]} and one.terms() is one.terms()
    with pytest.warns(UserWarning, match="seeds are used"):
        assert base("bad", pairs(("5 mg", "剂量"))).terms() == {"5 mg": ["剂量"], "剂量": ["5 mg"]}
