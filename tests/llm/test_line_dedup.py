import hashlib
from collections import Counter

from evidra.llm.line_dedup import dedup_lines, digest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute(rows, min_docs):
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and counts[key(x)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


ROWS = [
    (1, "Shared Line\nown one\n\nshared line "), (2, "\tSHARED LINE\r\nÉtat\nétat"), (3, "shared line"), (4, None), (5, ""), (6, "x\n" * 3), (7, "x"),
    (8, "X\nonly here"), (None, "shared line\nno id"), (3, "shared line"), (9, " shared line"), (10, "État\nx y\n" + "z" * 50_000 + "\nx"),
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for least in (2, 3, 5):
        got = Counter(map(tuple, digest(dedup_lines(df, min_docs=least)).collect()))
        assert got == brute(ROWS, least)


def test_shuffled_keys_give_the_same(spark, monkeypatch):
    from evidra.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert Counter(map(tuple, digest(dedup_lines(df, min_docs=3)).collect())) == brute(ROWS, 3)


def test_empty_table_and_other_columns(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a\nb", 7, "k"), (2, "a", 8, "l")], "doc_id long, text string, n_lines int, pos string")
    out = dedup_lines(df, min_docs=2)
    assert out.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped"]
    assert {tuple(r) for r in out.collect()} == {(1, "b", "k", 2, 1), (2, "", "l", 1, 1)}


def test_one_text_in_most_rows(spark):
    rows = [(i, "same\nlines") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(300)]
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 2 for i in range(300)) and all(got[1000 + i] == 0 for i in range(300))
