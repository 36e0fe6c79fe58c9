import unicodedata
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidra.functions import nodes as N
from evidra.functions import text as T
from evidra.operators import terminology


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_tokens_agree_with_the_scalar_form(spark):
    r = random.Random(0)
    texts = ["HER2阳性 乳腺癌 T-DXd 4/6", "癌", "", "a.b+c_d/e -x- 12.5"] + ["".join(r.choice("乳腺癌复发ab1 .-/") for _ in range(30)) for _ in range(50)]
    for text, got in zip(texts, column(spark, texts, T.tokens), strict=True):
        assert Counter(got) == Counter(terminology.tokenize(text)), text


def test_normalised_text(spark):
    assert column(spark, ["  ＨＥＲ２\r\n  positive\t disease  ", None, "a　b\x1cc"], T.normalize_text) == ["HER2 positive disease", None, "a b c"]


def test_variants(spark):
    texts = ["The HER2-positive case", "her2x", "患者脑转移", ""]
    assert column(spark, texts, lambda c: T.contains_variant(c, "HER2")) == [True, False, False, False]
    assert column(spark, texts, lambda c: T.contains_variant(c, "脑转移")) == [False, False, True, False]
    assert column(spark, texts, lambda c: T.contains_variant(c, " ")) == [False] * 4
    assert column(spark, ["C++ (x)", "c x"], lambda c: T.contains_variant(c, "c++")) == [True, False]


def test_concepts_need_one_variant_of_each(spark):
    texts = ["brain metastasis advanced", "brain metastasis", "advanced"]
    assert column(spark, texts, lambda c: T.matches_concepts(c, [["brain metastasis", "脑转移"], ["advanced"]])) == [True, False, False]
    assert column(spark, texts, lambda c: T.matches_concepts(c, [["x"]])) == [True] * 3


def test_spacing_rules(spark):
    texts = ["a t u m o r and H E R 2 5 m g / k g", "B L O K E J, K R O E P J R", "plain", "P R E P A R E - 2"]
    assert column(spark, texts, lambda c: T.normalize_spacing(c)[0]) == ["a tumor and HER2 5 mg/kg", texts[1], "plain", "PREPARE-2"]
    assert column(spark, texts, lambda c: T.normalize_spacing(c)[1]["split_tumor"]) == [1, 0, 0, 0]
    assert column(spark, ["x t u m y", "A B c d"], lambda c: F.size(T.suspicious_spacing(c))) == [1, 1]


def test_html_and_blocks(spark):
    assert column(spark, ["TSAT&lt;50% <b>T&lt;2cm</b><br>x"], T.html_to_text) == ["TSAT<50% T<2cm\nx"]
    assert column(spark, ['<div><img src="a"></div>A  \n---\n<i>B</i>\r\n'], T.normalize_block) == ["A\nB"]


def test_long_texts_are_cut_at_sentences_without_loss(spark):
    text = "甲" * 450 + "。" + "乙" * 440 + "。" + "丙" * 300 + "。"
    pieces = T.split_long_value(text)
    assert "".join(pieces) == text and len(pieces) == 2 and pieces[0].endswith("。") and all(len(p) <= 900 for p in pieces)
    assert T.split_long_value("x" * 2000) == ["x" * 900, "x" * 900, "x" * 200] and T.split_long_value("") == []
    assert column(spark, [text, None], T.split_long) == [pieces, None]


def test_ngrams_and_containment(spark):
    assert column(spark, ["乳腺癌", "a", ""], lambda c: T.ngrams(c, 2)) == [["乳腺", "腺癌"], [], []]
    assert set(column(spark, ["A b，cd"], T.match_tokens)[0]) == {"ab", "b，", "，c", "cd"}
    assert column(spark, ["abcd"], lambda c: T.containment(T.ngrams(c, 2), F.array(F.lit("ab"), F.lit("zz")))) == [0.5]


def flag(spark, **fields):
    row = {"text": "words", "block_type": None, "section_path": None, "retrieval_role": None, "page_start": None, "explicit": None} | fields
    df = spark.createDataFrame([tuple(row.values())], "text string, block_type string, section_path string, retrieval_role string, page_start string, explicit string")
    return df.select(N.indexable(*(F.col(c) for c in df.columns))).first()[0]


@pytest.mark.parametrize(
    ("fields", "want"),
    [
        ({}, True), ({"text": "  "}, False), ({"text": "12 / 3.4"}, False), ({"explicit": " No "}, False), ({"explicit": "yes", "text": ""}, True),
        ({"block_type": "TABLE", "section_path": "Copyright"}, True), ({"section_path": "General Principles"}, False), ({"section_path": "目录"}, False),
        ({"retrieval_role": "Legal"}, False), ({"retrieval_role": "front_matter"}, False), ({"retrieval_role": "front_matter", "text": "therapy " * 50}, True),
        ({"page_start": "1", "text": "NCCN Guideline"}, False), ({"page_start": "2", "text": "NCCN Guideline"}, True), ({"page_start": "5", "text": "ISBN 1"}, False),
        ({"page_start": "x", "text": "ISBN 1"}, True),
    ],
)
def test_indexable_rules(spark, fields, want):
    assert flag(spark, **fields) is want


def test_locators(spark):
    rows = [("pdf", 0, 1, "H", "S"), ("pdf", 3, None, "H", "S"), ("pdf", 3, 3, "H", "S"), ("pdf", None, None, "H", ""), ("html", 1, 1, None, None)]
    df = spark.createDataFrame(rows, "k string, a long, b long, h string, s string")
    got = [r[0] for r in df.select(N.locator(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["PDF 页序号 1–2", "PDF 页序号 4", "PDF 页序号 4", "H", "未提供定位信息"]


def test_case_folding_of_all_signs(spark):
    signs = [chr(c) for c in range(0x20, 0x1_F000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]  # those that this Python knows
    assert column(spark, signs, T.fold) == [c.casefold() for c in signs]


def test_terms_are_found_whatever_their_case(spark):
    text = ["die Straße ist lang", "DIE STRASSE", "Strassen", "ΟΔΟΣ", None]
    assert column(spark, text, lambda c: T.contains_variant(c, "straße")) == [True, True, False, False, None]
    assert column(spark, text, lambda c: T.contains_variant(c, "οδος"))[3]


def test_html_text_of_odd_markup(spark):
    cases = {
        "a<script>x<p>&amp;</script>b": "ax<p>&amp;b", "a<!-- <b> -->b": "ab", "1 < 2 <b title='>'>c</b>": "1 < 2 c", "x<br/>y</br>z": "x\nyz", "a<b c=\"": "a", "&lt;b&gt;": "<b>",
    }
    assert column(spark, list(cases), T.html_to_text) == list(cases.values())
    assert T.html_to_text_value('<a href="' * 200_000) == ""


def test_python_gets_small_batches_of_the_texts_that_need_it(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        texts = [None, "", "plain  text", "ﬁne &amp; <b>é</b>", "x" * 899 + "。" + "y" * 5] * 250
        assert column(spark, texts, T.normalize_text)[2:4] == ["plain text", "fine &amp; <b>é</b>"]
        assert int(spark.conf.get(name)) <= 2000
        assert column(spark, texts, T.html_to_text) == [None if t is None else T.html_to_text_value(t) for t in texts]
        assert column(spark, texts, T.split_long) == [None if t is None else T.split_long_value(t) for t in texts]
    finally:
        spark.conf.set(name, before)
