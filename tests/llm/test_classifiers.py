import zlib

import numpy as np
import pytest

from evidra.llm import ecoc_langid, gam

SCHEMA = "doc_id long, text string, lang string"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def junk(text):
    return " ".join(w + "###" for w in text.split())


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rows = [(i, junk(prose(60, i)) if i % 4 == 0 else prose(60, i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_gam_on_held_out_rows(labelled):
    docs, labels = labelled
    out = gam.score(docs, gam.fit(docs, labels)).collect()
    assert len(out) == 400
    for r in out:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= gam.THRESHOLD)
        assert r.predicted == int(r.doc_id % 4 != 0)


def test_gam_does_not_learn_from_held_out_rows(spark, labelled):
    docs, labels = labelled
    model = gam.fit(docs, labels)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    x = gam.features(*_bytes(["some words of text", "x ### y", ""]))
    assert (model.score(x) == gam.fit(docs, flipped).score(x)).all()


def _bytes(texts):
    import pyarrow as pa

    from evidra.llm import textkit

    return textkit.utf8(pa.array(texts, pa.string()))


def test_gam_edges(spark, labelled, prose):
    docs, labels = labelled
    model = gam.fit(docs, labels)
    rows = [(1, None, "a", 0.5), (2, "", "b", 0.5), (None, "x y", "c", 0.5), (3, prose(50_000, 1), "d", 0.5), (2, "", "b", 0.5)]
    out = gam.score(spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double").withColumnRenamed("predicted", "f0"), model)
    assert out.columns == ["doc_id", "text", "f0", "held_out", "score", "predicted"]
    got = {r.f0: r for r in out.collect()}
    assert out.count() == 5 and got["a"].score == got["b"].score and got["c"].held_out is False and got["d"].predicted == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert gam.score(empty, model).count() == 0
    assert gam.fit(docs, labels.limit(0)).value == 0.5 and gam.fit(empty, labels).value == 0.5
    assert gam.fit(docs, labels.where("quality = 1")).value == 1.0


def plain_features(text):
    """The features of one text, by its bytes and words one after the other."""
    import math
    import re

    data = text.encode()
    size, one = len(data), max(1, len(data))
    words = [w.translate(bytes([*range(65), *range(97, 123), *range(91, 256)])) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)]
    some = max(1, len(words))
    inside = lambda signs: sum(b in signs for b in data) / one
    lines = [tuple(re.findall(rb"[0-9A-Za-z\x80-\xff]+", x.lower())) for x in data.split(b"\n")]
    lines = [sum(hash(w) for w in x) for x in lines if x]  # a line is known by its words, whatever their order
    punct = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    return [
        math.log1p(size), math.log1p(len(words)), size / some, inside(range(65, 91)), inside(range(48, 58)), inside(punct), inside(range(128, 256)), inside(b"\t\n\v\f\r "),
        data.count(b"\n") / some, len(set(words)) / some * math.log1p(some), max((words.count(w) for w in set(words)), default=0) / some, inside(b"#$%&*+<=>@\\^_`{}~"),
        data.count(b"!") / one, data.count(b"|") / one, data.count(b".") / some, len(set(lines)) / max(1, len(lines)),
    ]


def test_gam_scores_equal_brute_force(spark, labelled, prose):
    import bisect
    import math

    docs, labels = labelled
    model = gam.fit(docs, labels)
    texts = [prose(60, 1000), junk(prose(9, 7)), "", "One\none\n\nTwo | 3! ...", "ÄÖ é\té", "a " * 500, prose(5000, 3).replace(" ", "\n")]
    out = gam.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    for r in out.collect():
        x = plain_features(texts[r.doc_id])
        z = model.base + sum(float(t[bisect.bisect_right(list(e), v)]) for v, e, t in zip(x, model.edges, model.tables, strict=True))
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            a, b = (bisect.bisect_right(list(model.coarse[k]), x[k]) for k in (i, j))
            z += float(table.reshape(len(model.coarse[i]) + 1, -1)[a, b])
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), texts[r.doc_id][:40]


def test_gam_learns_from_ids_with_one_label_and_one_text(spark, labelled):
    docs, labels = labelled
    more = docs.unionByName(docs.where("doc_id < 9")).unionByName(docs.limit(1).selectExpr("-7L as doc_id", "'! ! !' as text"))
    both = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(-7, 0), (-7, 1), (3, 1)], "doc_id long, quality int"))
    x = gam.features(*_bytes(["some words of text", "x ### y", ""]))
    assert (gam.fit(more, both).score(x) == gam.fit(docs, labels).score(x)).all()


def test_pairs_find_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gam.PairwiseGam(x, y)
    assert (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_features_of_a_document_do_not_depend_on_its_neighbours():
    texts = ["one two\nthree", "", "ÜBER alles | x!", "same same same", "a"]
    whole = gam.features(*_bytes(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], gam.features(*_bytes([t]))[0])


LANGS = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "äöüßé"}


def sample(lang, seed, n=40):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list(LANGS[lang]), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rows = [(i, sample(k, i), k if i % 7 else None) for i, k in enumerate(sorted(LANGS) * 60)]
    return spark.createDataFrame(rows, SCHEMA)


def test_languages_of_held_out_rows(tongues):
    model = ecoc_langid.fit(tongues)
    out = ecoc_langid.predict(tongues, model).collect()
    truth = sorted(LANGS) * 60
    for r in out:
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert r.lang_pred == truth[r.doc_id]


def test_language_edges(spark, tongues):
    model = ecoc_langid.fit(tongues)
    rows = [(1, None, "x", True), (2, "", "x", True), (3, "123 !?", "x", True), (None, sample("aa", 5), "x", True), (4, "é", "x", True), (5, sample("bb", 9, 60_000), "x", True), (6, sample("aa", 1, 6) + " " + sample("bb", 2, 6), "x", True)]
    out = ecoc_langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string, ambiguous boolean"), model)
    assert out.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score", "ambiguous"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, None, 4, 5)] == ["und", "und", "und", "aa", "dd", "bb"] and got[1].score == 0.0
    assert got[6].lang_pred in ("aa", "bb") and got[6].score < got[5].score
    empty = tongues.limit(0)
    assert ecoc_langid.predict(empty, model).count() == 0
    none = ecoc_langid.predict(tongues.limit(3), ecoc_langid.fit(empty)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = ecoc_langid.predict(tongues.limit(3), ecoc_langid.fit(tongues.where("lang = 'aa'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("aa", 1.0)}


@pytest.mark.parametrize("k", [2, 4, 6, 7, 30])
def test_codewords_are_apart(k):
    code = ecoc_langid.codewords(k)
    apart = (code.shape[1] - code @ code.T) / 2
    assert set(np.unique(code)) == {-1.0, 1.0} and apart[~np.eye(k, dtype=bool)].min() >= max(1, code.shape[1] // 5)


def test_language_scores_equal_brute_force(spark, tongues):
    import math

    model = ecoc_langid.fit(tongues)
    texts = [sample("aa", 900), sample("dd", 3, 7), "Ab1, cD é!", "x", sample("bb", 1, 5) + "\n" + sample("cc", 2, 9)]
    out = ecoc_langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    for r in out.collect():
        data = bytes(b if b > 127 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in texts[r.doc_id].encode())
        x = [0.0] * ecoc_langid.WIDTH
        letters = [b for b in data if b != 32]
        for b in letters:
            x[b] += 1 / len(letters)
        grams = [(data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 0x9E3779B1 % 2**32 >> 20 for i in range(len(data) - 2)]
        for h in grams:
            x[256 + h] += 1 / len(grams)
        z = [sum(math.sqrt(v) * float(model.w[i, c]) for i, v in enumerate(x) if v) + float(model.w[-1, c]) for c in range(model.code.shape[1])]
        loss = [sum(w * math.log1p(math.exp(-b * v)) for w, b, v in zip(ws, code, z, strict=True)) * len(z) / 2 for ws, code in zip(model.bit_weight, model.code, strict=True)]
        p = [math.exp(-v) for v in loss]
        best = min(range(len(loss)), key=loss.__getitem__)
        assert r.lang_pred == model.names[best] and r.score == pytest.approx(p[best] / sum(p), abs=1e-3)


def test_fitting_sample_is_bounded_for_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(ecoc_langid, "ROWS_PER_LANGUAGE", 5)
    monkeypatch.setattr(ecoc_langid, "MAX_ROWS", 40)
    seen = []

    class Spy(ecoc_langid.Ecoc):
        def __init__(self, x, y, names, steps=1):
            seen.append((len(x), np.bincount(y, minlength=len(names)), names))
            super().__init__(x, y, names, steps)

    monkeypatch.setattr(ecoc_langid, "Ecoc", Spy)
    rows = [(i, sample("aa", i % 9, 3), f"l{i % 30:02}") for i in range(600)] + [(9, sample("bb", i, 2), "hot") for i in range(300)]
    ecoc_langid.fit(spark.createDataFrame(rows, SCHEMA))
    n, each, names = seen[0]
    assert n == 40 and len(names) == 31 and each.max() <= 2 and each.min() >= 1
    ecoc_langid.fit(spark.createDataFrame([r for r in rows if r[2] in ("l00", "hot")], SCHEMA))
    assert seen[1][0] == 10 and list(seen[1][1]) == [5, 5]
