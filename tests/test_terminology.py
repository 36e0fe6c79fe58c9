import pytest

from evidra.operators import terminology as t

GLOSSARY = {
    "脑转移": ["brain metastasis"], "转移": ["metastasis"], "晚期": ["advanced"], "淋巴转移": ["lymph node metastasis"], "ADC": ["抗体药物偶联物", "表观扩散系数"],
    "HER2": ["人表皮生长因子受体2"], "brain metastasis": ["脑转移"],
}


def test_longest_terms_win_and_aliases_are_appended_once():
    assert t.expand_query("  脑转移   晚期 ", GLOSSARY) == "脑转移 晚期 brain metastasis advanced"
    assert t.expand_query("brain metastasis 脑转移", GLOSSARY) == "brain metastasis 脑转移 脑转移 brain metastasis"
    assert t.expand_query("ADC", GLOSSARY) == "ADC" and t.expand_query("xHER2y", GLOSSARY) == "xHER2y" and t.expand_query(" ", GLOSSARY) == ""


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("脑转移 晚期", [["脑转移", "brain metastasis"], ["晚期", "advanced"]]),
        ("lymph node status and advanced", [["lymph node status"], ["advanced"]]),
        ("the state of the art", [["state of the art"]]),
        ("alpha, beta", [["alpha"], ["beta"]]),
        ("新药 癌 HER2+", [["新药"], ["HER2", "人表皮生长因子受体2"]]),
        ("淋巴转移", [["淋巴转移", "lymph node metastasis", *t.NODE_TERM_VARIANTS]]),
        ("", []),
    ],
)
def test_concept_groups(query, want):
    assert t.concept_groups(query, GLOSSARY) == want


def pairs(spark, rows):
    return spark.createDataFrame(rows, "english string, chinese string")


CHUNKS = [("1", "c1", "多西他赛（docetaxel，mmol/L）", "h1"), ("2", "c2", "Paclitaxel (紫杉醇) 与 患者（tumor）", "h2"), ("3", "c3", "甲药（drugone）；乙药（drugone）", "h3")]


def test_mined_glossary(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "id string, chunk_id string, text string, content_sha256 string")
    reviewed = pairs(spark, [("docetaxel", "多西他赛"), ("paclitaxel", "紫杉醇"), ("drugone", "甲药"), ("drugone", "乙药")])
    seeds = pairs(spark, [("therapy", "疗法")])
    glossary, rejected = t.mine_glossary(chunks, seeds, reviewed)
    assert {r.term: r.aliases for r in glossary.collect()} == {
        "docetaxel": ["多西他赛"], "多西他赛": ["docetaxel"], "Paclitaxel": ["紫杉醇"], "紫杉醇": ["Paclitaxel"], "therapy": ["疗法"], "疗法": ["therapy"],
    }
    assert {(r.chunk_id, r.source, r.reason) for r in rejected.collect()} == {
        ("c1", "mmol/L", "measurement_or_threshold"), ("c2", "tumor", "sentence_fragment"), ("c3", "drugone", "ambiguous_alias"),
    }
    assert t.audit(glossary, reviewed.unionByName(seeds)).count() == 0
    assert tuple(t.pair_counts(glossary).first()) == (6, 3)
    with pytest.raises(ValueError, match="invalid seed mapping"):
        t.mine_glossary(chunks, pairs(spark, [("5 mg", "剂量")]), reviewed)


def test_glossary_cache(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS[:2], "id string, chunk_id string, text string, content_sha256 string")
    reviewed, seeds = pairs(spark, [("docetaxel", "多西他赛")]), pairs(spark, [("therapy", "疗法")])
    path = str(tmp_path / "glossary")
    first = t.load_or_mine(spark, path, chunks, ["v1"], seeds, reviewed)
    stamp = {f: f.stat().st_mtime_ns for f in (tmp_path / "glossary" / "cache").glob("*.json")}
    assert t.load_or_mine(spark, path, chunks, ["v1"], seeds, reviewed) == first
    assert stamp == {f: f.stat().st_mtime_ns for f in (tmp_path / "glossary" / "cache").glob("*.json")}
    (file,) = stamp
    file.write_text(file.read_text().replace("docetaxel", "tampered"))
    for crc in (tmp_path / "glossary" / "cache").glob(".*.crc"):
        crc.unlink()
    assert t.load_or_mine(spark, path, chunks, ["v1"], seeds, reviewed) == first
