import json

import pytest
from pyspark.sql import functions as F

from evidra.api import EvidenceBase, IngestRequest, SourceInput
from evidra.operators import constraints
from evidra.operators.registry import Registry
from evidra.operators.retrieval import SearchRequest
from evidra.operators.snapshot import SnapshotStore, model_profile, safe_name
from evidra.sources.connectors import HashingEncoder
from evidra.streaming import audit as stream

RECORD = {"doc_id": "d", "doc_title": "Doc", "section_path": "Part", "page_code": None, "page_start": 0, "page_end": 1, "block_type": "paragraph"}


@pytest.fixture
def base(spark, tmp_path):
    profile = model_profile("local", "hashing", 16, True, "r1")
    return EvidenceBase(spark, str(tmp_path / "registry"), str(tmp_path / "snapshots"), str(tmp_path / "managed"), HashingEncoder(16), profile, {"疗法": ["therapy"]})


def request(tmp_path, version, texts, **more):
    chunks = tmp_path / f"{version}.jsonl"
    chunks.write_text("".join(json.dumps(RECORD | {"chunk_id": f"c{i}", "text": t}) + "\n" for i, t in enumerate(texts)), encoding="utf-8")
    pdf = tmp_path / f"{version}.pdf"
    pdf.write_bytes(b"%PDF " + version.encode())
    fields = {"guideline_id": "g1", "title": "G", "language": "en", "authority_level": "primary_guideline", "version_id": version, "version_label": version} | more
    return IngestRequest(**fields, chunks=SourceInput(f"{version}-chunks", str(chunks), "jsonl"), citation=SourceInput(f"{version}-pdf", str(pdf), "pdf"))


def test_life_of_a_guideline(spark, base, tmp_path):
    base.ingest(request(tmp_path, "v1", ["advanced therapy of tumours", "surgery alone", "12 / 3"]), "me")
    with pytest.raises(ValueError):
        base.search(SearchRequest("therapy"))  # a draft is not searched
    base.approve("v1", "me")
    got = base.search(SearchRequest("疗法", top_k=2, use_bm25=True))
    rows = got.evidence.collect()
    assert got.resolved_version_ids == ["v1"] and got.retrieval_modes == ["vector", "bm25"] and rows[0].text == "advanced therapy of tumours"
    assert rows[0].citation.locator == "PDF 页序号 1–2" and rows[0].citation.source_title == "Doc" and rows[0].raw_chunk_id == "v1-chunks:c0"
    assert len(rows) == 2  # the node of digits alone takes no part

    base.ingest(request(tmp_path, "v2", ["advanced therapy of tumours", "surgery and more"]), "me")
    assert {r.chunk_id: r.change_type for r in base.diff("v2", "v1").collect()} == {"c0": "unchanged", "c1": "modified", "c2": "removed"}
    base.approve("v2", "me")
    assert {r.id: r.status for r in base.registry.versions().collect()} == {"v1": "superseded", "v2": "active"}
    assert base.search(SearchRequest("surgery", version_ids=("v1",))).resolved_version_ids == ["v1"]
    base.registry.archive_version("me", "v1")
    assert base.registry.get("version", "v1").status == "archived"
    assert [[v.id for v in r.versions] for r in base.guidelines().collect()] == [["v1", "v2"]]

    log = base.audit().collect()
    assert [r.id for r in log] == list(range(1, len(log) + 1))
    actions = [r.action for r in log]
    assert actions.count("raw_chunk_added") == 5 and actions.count("ingest_succeeded") == 2 and actions[-1] == "version_archived"
    assert base.registry.count_rows("node") == 5 and base.registry.count_nodes("v2") == 2
    with pytest.raises(ValueError):
        base.registry.count_rows("secrets")
    t = {n: base.registry.table(n) for n in ("guideline", "source_file", "raw_chunk", "node")} | {"document_version": base.registry.versions()}
    assert constraints.violations(t).count() == 0

    folders = [f"{base.registry.root}/{f}" for f in base.registry.folders("audit_event")]
    s = stream.tail(spark, f"{base.registry.root}/data/audit_event", spark.read.parquet(*folders).schema)
    q = stream.write(s, str(tmp_path / "stream"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "stream")).count() == len(log)


def test_failures_are_told_and_kept(spark, base, tmp_path):
    good = request(tmp_path, "v1", ["a b c"])
    for wrong in ({"authority_level": "x"}, {"version_id": "../v"}, {"guideline_id": "CON"}):
        with pytest.raises(ValueError):
            base.ingest(IngestRequest(**{**good.__dict__, **wrong}), "me")
    assert base.registry.versions().count() == 0
    (tmp_path / "v1.jsonl").write_text("{\n")
    with pytest.raises(ValueError, match="line 1"):
        base.ingest(good, "me")
    assert base.registry.get("version", "v1").status == "draft" and base.audit().where("action = 'ingest_failed'").count() == 1
    with pytest.raises(ValueError, match="snapshot"):
        base.approve("v1", "me")
    assert base.audit().where("action = 'approval_failed'").count() == 1
    with pytest.raises(KeyError):
        base.diff("v1", "none")
    with pytest.raises(ValueError):
        base.ingest(request(tmp_path, "v9", ["x"], language="zh"), "me")


def test_registry_rules(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "r"))
    reg.create_guideline("me", id="g", title="G", language="en", authority_level="secondary_summary")
    for call in (
        lambda: reg.create_guideline("me", id="g", title="G", language="en", authority_level="secondary_summary"),
        lambda: reg.create_guideline("me", id="h", authority_level="none"),
        lambda: reg.record_audit(" ", "x", "y", "z"),
        lambda: reg.approve_version("me", "v"),
    ):
        with pytest.raises((ValueError, KeyError)):
            call()
    reg.create_draft_version("me", id="v", guideline_id="g", version_label="1")
    with pytest.raises(ValueError, match="label"):
        reg.create_draft_version("me", id="w", guideline_id="g", version_label="1")
    with pytest.raises(ValueError, match="superseded"):
        reg.archive_version("me", "v")
    reg.add_source_file("me", id="s", document_version_id="v", source_kind="pdf", original_path="/o", managed_path="/old/root/a.pdf", sha256="0" * 64, byte_size=1)
    assert reg.rebase_paths("me", "/old/root") == 1 and reg.rebase_paths("me", "/old/root") == 0
    assert [r.managed_path for r in reg.table("source_file").collect()] == ["a.pdf"]
    diffs = spark.createDataFrame([("i", "a", "b", "added", None, "x", "c", "{}")], "id string, prior_version_id string, current_version_id string, change_type string, prior_raw_chunk_id string, current_raw_chunk_id string, chunk_id string, detail_json string")
    reg.replace_version_diffs("me", diffs)
    reg.replace_version_diffs("me", diffs.withColumn("change_type", F.lit("modified")))
    reg.replace_version_diffs("me", diffs.limit(0))
    assert [r.change_type for r in reg.list_version_diffs("a", "b").collect()] == ["modified"]
    with pytest.raises(ValueError, match="several"):
        reg.replace_version_diffs("me", diffs.union(diffs.withColumn("prior_version_id", F.lit("z"))))


def test_a_commit_number_is_taken_once(spark, tmp_path):
    one, two = (Registry(spark, str(tmp_path / "r")) for _ in "ab")
    assert one._publish({"seq": 1, "add": {}, "remove": {}}) and not two._publish({"seq": 1, "add": {}, "remove": {}})
    assert two.record_audit("me", "a", "b", "c") == 1 and [c["seq"] for c in one.commits()] == [1, 2]


def test_snapshots_are_checked(spark, tmp_path):
    profile = model_profile("huggingface", "m", 2, True)
    assert profile["provider"] == "local"
    store = SnapshotStore(spark, str(tmp_path / "s"), profile)
    nodes = spark.createDataFrame([("n1", "v", "a text", [1.0, 0.0]), ("n2", "v", "b", [0.0, 1.0])], "node_id string, version_id string, text string, embedding array<float>")
    path, digest = store.build("g", "v", nodes)
    assert store.load("g", "v", digest).count() == 2
    with pytest.raises(FileExistsError):
        store.build("g", "v", nodes)
    with pytest.raises(ValueError, match="wrong size"):
        store.build("g", "w", nodes.withColumn("embedding", F.array(F.lit(1.0))))
    for wrong in (lambda: store.verify("g", "v", "0" * 64), lambda: store.verify("g", "v", digest, path + "2"), lambda: SnapshotStore(spark, str(tmp_path / "s"), model_profile("remote", "m", 2, True)).verify("g", "v", digest)):
        with pytest.raises(ValueError):
            wrong()
    (tmp_path / "s/g/v/extra.bin").write_bytes(b"x")
    with pytest.raises(ValueError, match="changed or added"):
        SnapshotStore(spark, str(tmp_path / "s"), profile).verify("g", "v", digest)
    for name in ("", "..", "a/b", "a:b", "con", "LPT1.txt", "x."):
        with pytest.raises(ValueError):
            safe_name(name)
