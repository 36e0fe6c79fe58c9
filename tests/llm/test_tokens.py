import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evidra.llm import spm_trie, staging, token_store

BPE = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [
    "", " ", "  ", "\n", "a  b\n c\tü", "Hello 世界 　x ﬁ \x00b\r\n", "a▁b ▁", "\n\n x", "x\n", "don't DON'T it's o'clock", "éñ𝔘 😀😀", "İstanbul ǅ é",
    "a\x1cb\x1d c", "<s></s><0x0A><|endoftext|>", "x. y!! (z) 1,000.50 A,b", "aaaa" * 50, "́ x ̇I",
]


def texts():
    r = random.Random(3)
    return ODD + ["".join(r.choice("ab ▁\n\tEcd éßtion.,'09") for _ in range(r.randint(0, 60))) for _ in range(600)]


def test_pieces_equal_the_library():
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=PIECES), spm_trie.Encoder(PIECES)
    for t, ids in zip(texts(), enc.encode(texts()), strict=True):
        assert ids.tolist() == lib.encode(t), repr(t)
        assert enc.decode(ids) == t.replace("▁", " ")


def test_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(spm_trie, "MEMO_WORDS", 3)
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=PIECES), spm_trie.Encoder(PIECES)
    for _ in range(2):
        assert [i.tolist() for i in enc.encode(texts())] == [lib.encode(t) for t in texts()]


def test_unigram_walk_is_the_best_path():
    enc = spm_trie.Encoder.__new__(spm_trie.Encoder)
    enc.bpe, enc.longest, enc.dtype, enc.byte_id, enc.raw = False, 3, np.uint16, list(range(256)), {}
    enc.score = {"▁": -2.0, "▁a": -1.0, "a": -1.5, "b": -1.6, "ab": -1.7, "▁ab": -9.0, "ba": -1.1}
    enc.id = {p: 300 + i for i, p in enumerate(enc.score)}

    def best(word):
        if not word:
            return 0.0, []
        return max((enc.score[word[:n]] + best(word[n:])[0], [enc.id[word[:n]], *best(word[n:])[1]]) for n in (1, 2, 3) if word[:n] in enc.score)

    words = ["▁" + w for w in ("a", "ab", "aba", "abba", "bab", "abab")]
    for w, ids in enc.encode_words(words).items():
        assert np.frombuffer(ids, np.uint16).tolist() == best(w)[1]


def test_encode_documents(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(100, None, 1), (None, "x", 2), (100, None, 1), (101, "long words " * 30_000, 3)]
    out = spm_trie.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PIECES)
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 100} == {0}
    assert spm_trie.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def ids_of(text):
    return [*Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture
def store(spark):
    return staging.new_path(spark, "test-store")


def test_store_gives_all_ids_back(spark, store, monkeypatch, prose):
    monkeypatch.setattr(token_store, "RANGE_ROWS", 100)
    lib = Tokenizer.from_file(BPE)
    rows = [(7 * i + 1, t) for i, t in enumerate(texts())] + [(3, None), (5, prose(40_000, 1)), (6, "start " + prose(40_000, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_store.write_store(df, store, BPE)
    want, start = {}, 0
    for i, t in sorted(rows):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (start, ids)
        start += len(ids)
    got = token_store.read_digests(spark, store).collect()
    assert len(got) == len(rows)
    for r in got:
        s, ids = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    for r in token_store.read_documents(spark, store).collect():
        assert (r.start, np.frombuffer(r.ids, "<u4").tolist()) == want[r.doc_id]
    assert token_store.verify_manifest(spark, store)
    stored = spark.read.parquet(f"{store}/content/part=chunks").selectExpr("sum(octet_length(ids)) / 4", "count(*)", "count(distinct key)").first()
    assert stored[0] < start - 40_000 and stored[1] == stored[2]  # the second long text shares the first one's chunks
    files = spark.read.parquet(f"{store}/recipes").collect()
    assert sorted(r.doc_id for r in files) == [i for i, _ in sorted(rows)]


def test_damage_is_found(spark, store, prose):
    df = spark.createDataFrame([(1, prose(300, 1)), (2, prose(300, 2))], "doc_id long, text string")
    token_store.write_store(df, store, BPE)
    chunks = spark.read.parquet(f"{store}/content/part=chunks").collect()
    spark.createDataFrame([(r.key, r.ids) for r in chunks[1:]], "key binary, ids binary").write.mode("overwrite").parquet(f"{store}/content/part=chunks")
    with pytest.raises(Exception, match="missing"):
        token_store.read_digests(spark, store).collect()
    spark.createDataFrame([(r.key, bytes(r.ids)[:-4] + b"\7\0\0\0") for r in chunks], "key binary, ids binary").write.mode("overwrite").parquet(f"{store}/content/part=chunks")
    with pytest.raises(Exception, match="address"):
        token_store.read_documents(spark, store).collect()


def test_store_of_no_rows_null_ids_and_repeats(spark):
    a, b = (staging.new_path(spark, "test-store") for _ in "ab")
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), a, BPE)
    assert token_store.read_digests(spark, a).count() == 0 and token_store.read_documents(spark, a).count() == 0
    rows = [(2, "two", 0), (None, "none", 0), (2, "two", 0), (1, "", 0)]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string, root int"), b, BPE)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_store.read_digests(spark, b).collect())
    n = len(ids_of("two"))
    assert got == [(0, None, len(ids_of("none"))), (got[1][0], 1, 1), (got[1][0] + 1, 2, n), (got[1][0] + 1 + n, 2, n)]


def test_chunks_move_with_their_content():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 49_000, 60_000).astype(np.uint32)
    moved = np.concatenate([rng.integers(0, 49_000, 333).astype(np.uint32), body])
    cut = [set() for _ in range(2)]
    for s, ids in zip(cut, (body, moved), strict=True):
        (ends,) = token_store.cuts(ids, np.array([0, len(ids)]))
        assert ends[-1] == len(ids) and all(0 < b - a <= token_store.MOST for a, b in zip([0, *ends], ends, strict=False))
        s.update(ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False))
    assert len(cut[0] & cut[1]) >= len(cut[0]) - 2
    apart = token_store.cuts(np.concatenate([body, moved]), np.array([0, len(body), len(body) + len(moved)]))
    assert apart == [token_store.cuts(x, np.array([0, len(x)]))[0] for x in (body, moved)]


def test_reading_checks_the_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_ROWS", 40)
    rows = [(i % 150, f"text number {i} of this table") for i in range(300)] + [(7, "")] * 60
    path = str(tmp_path / "store")
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path, BPE)
    got = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    manifest = spark.read.parquet(path + "/manifest").first()
    assert manifest.documents == 360 and manifest.ids == sum(r.n_tokens for r in got) and len(manifest.ranges) > 1
    assert bytes(manifest.root) == token_store.merkle([bytes(r.root) for r in manifest.ranges])
    lost = sorted(f for f in (tmp_path / "store" / "recipes").glob("part-*") if f.stat().st_size)[0]
    lost.unlink()
    for read in (token_store.read_digests, token_store.read_documents):
        with pytest.raises(ValueError, match="manifest"):
            read(spark, path)
