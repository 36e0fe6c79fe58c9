"""Operator 4, token-ID output: a content-addressed store of id streams.

A document's ids (with the end id) are cut where a rolling hash of the last ``WINDOW`` ids hits a pattern, so
equal passages give equal chunks wherever they stand. A chunk's address is the BLAKE2b digest of its ids;
each distinct chunk is stored once. A recipe lists a document's chunk addresses in order, under the Merkle root of
them. A store is a folder with

* ``content/part=chunks/``: Parquet files of (key, ids): the address and ids as little-endian unsigned 32-bit integers, zstd-compressed,
* ``content/part=recipes/``: the recipes as tasks gave them, which nothing reads later,
* ``recipes/``: Parquet files in ascending doc_id order of (doc_id, ord, start, n_tokens, addresses, root), where
  start counts the ids of all documents before it,
* ``manifest/``: one row with the counts and the Merkle root of each recipe range, and the root over these.

Reading checks the recipes against the manifest, every chunk against its address and every recipe against its root; a missing or damaged chunk,
a lost or changed recipe is an error. ``read_documents`` gives the ids back. ``read_digests`` gives start, n_tokens and the CRC-32 of each
document: each stored chunk is read, checked and summed once, and the sums of a document's chunks are combined
(CRC-32 of a concatenation follows from those of its parts), so no id is shuffled.

Defined results: a null or empty text has only the end id. Rows with a null doc_id come first. Rows with the same
doc_id stand side by side, in the order of their roots. An empty table gives an empty store and
empty results. Other columns of the input are not stored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from .staging import small_batches, stage

#: Ids in the rolling window; mean ids between cuts; most ids in a chunk.
WINDOW, MEAN, MOST = 16, 1024, 8192
#: Words kept with their ids by each Python worker.
MEMO_WORDS = 900_000
SLICE_BYTES = 3 << 20
#: Documents of one recipe range, about.
RANGE_ROWS = 50_000
#: Letters and then ASCII punctuation other than apostrophes, which are two token runs.
_TAILED = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]+)")
_TAILED_ANY = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


def _plain(word: str) -> bool:
    """Letters of the Latin blocks, which all parties know as letters in both cases."""
    return word.isalpha() and max(word) < "\u0250" and word.lower().isalpha()


class WordEncoder:
    """The library's ids for whole texts, by way of each distinct word's ids.

    White space separates all tokens of this tokenizer and it lower-cases, so a text's ids are those of its lower-cased
    words, and a word of letters with punctuation behind it is a token run of each. Words not seen before are encoded by the
    library, many in one call; each run of letters or punctuation ends in a token marked as a word end, which tells the words' ids apart.
    A text with a special token's opening, or with white space that the library and bytes.split() see differently, goes to
    the library whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        vocabulary = self.lib.get_vocab()
        self.dtype = "<u2" if max(vocabulary.values()) < 65536 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        probe = "One two, (three) DON'T naïve\n\tx9y  ü0 It's end... A,b"
        parts = self._add([w for w in set(probe.encode().lower().split())])
        ids = b"".join(parts[w] for w in probe.encode().lower().split())
        self.by_word = self._raw(probe) == np.frombuffer(ids, self.dtype).tolist()

    def _raw(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _add(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words that the memo does not have."""
        out: dict[bytes, bytes] = {}
        memo, joined, single = self.memo, [], set()
        for w in words:
            if w.isalpha():
                single.add(w)
            elif w.isascii() and (m := _TAILED.fullmatch(w)):
                joined.append((w, *m.groups()))
            elif (m := _TAILED_ANY.fullmatch(w.decode())) and _plain(m[1]):
                if m[2]:
                    joined.append((w, m[1].encode(), m[2].encode()))
                else:
                    single.add(w)
            else:
                out[w] = self._bytes(self._raw(w.decode()))
        for _, head, tail in joined:
            if head not in memo:
                single.add(head)
            if tail not in memo:
                single.add(tail)
        units = list(single)
        groups = [units[i : i + 512] for i in range(0, len(units), 512)]
        encoded = self.lib.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(group) or cut[-1] != len(ids):
                out.update((w, self._bytes(self._raw(w.decode()))) for w in group)
                continue
            raw, at = ids.tobytes(), (ids.itemsize * np.append(0, cut)).tolist()
            out.update(zip(group, map(raw.__getitem__, map(slice, at, at[1:])), strict=False))
        for w, head, tail in joined:
            out[w] = (out.get(head) or memo[head]) + (out.get(tail) or memo[tail])
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (a string array without nulls), each with the end id behind it, and where each text's ids end."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.values.slice(words.offsets[0].as_py(), words.offsets[-1].as_py() - words.offsets[0].as_py()).dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        memo = self.memo
        new = self._add([w for w in names if w and w not in memo])
        new[b""] = b""
        parts = [memo[w] if w in memo else new[w] for w in names]
        if len(memo) + len(new) <= MEMO_WORDS:
            memo |= new
        # Words become runs of ids by indexing: where each word's ids lie, then a running place for each id.
        width = np.dtype(self.dtype).itemsize
        flat = np.append(np.frombuffer(b"".join(parts), self.dtype), np.array([end], self.dtype))
        sizes = np.append(np.fromiter(map(len, parts), np.int64, len(parts)) // width, 1)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        of_text = np.diff(words.offsets.to_numpy())
        index = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(of_text), len(names))
        n = sizes[index]
        place = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[index] - place[:-1], n) + np.arange(place[-1])].astype("<u4")
        ends = place[np.cumsum(of_text + 1)]
        odd = pc.match_substring_regex(texts, "<\\||[\\x1c-\\x1f]").to_numpy(zero_copy_only=False)
        if odd.any() or not self.by_word:
            streams = np.split(ids, ends[:-1])
            for i in range(len(streams)) if not self.by_word else np.flatnonzero(odd):
                streams[i] = np.array([*self._raw(texts[int(i)].as_py()), end], "<u4")
            ids, ends = np.concatenate(streams), np.cumsum(list(map(len, streams)))
        return ids, ends


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_GEAR = np.random.default_rng(7).integers(1, 2**63, 1 << 16, dtype=np.uint64)


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each id stream (``bounds``: where the streams lie in ``ids``), counted from its start: where
    the hash of the last WINDOW ids is small, and after MOST ids."""
    n = len(ids)
    v = _GEAR[ids & 0xFFFF] ^ (ids >> 16).astype(np.uint64)
    h = v.copy()
    for k in range(1, min(WINDOW, n)):  # the window's newest id is shifted least, as in a gear hash
        h[k:] += v[:-k] << np.uint64(k)
    found = np.flatnonzero(h * np.uint64(0x9E3779B97F4A7C15) < np.uint64(2**64 // MEAN)) + 1
    stream = np.searchsorted(bounds, found, side="right") - 1
    inside = stream < len(bounds) - 1
    found, stream = found[inside], stream[inside]
    found = found[found - bounds[stream] >= WINDOW]  # a window lies in one stream
    out = []
    for a, b, c in zip(bounds[:-1].tolist(), bounds[1:].tolist(), np.split(found, np.searchsorted(found, bounds[1:-1])), strict=True):
        last, ends = a, []
        for e in [*c.tolist(), b]:
            if e <= a or e == last:
                continue
            ends += [*range(last + MOST, e, MOST), e]
            last = e
        out.append([e - a for e in ends])
    return out


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=20).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=20).digest() for x in leaves]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=20).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) & ~1 :]
    return level[0] if level else bytes(20)


def _encode(docs: DataFrame, path: str, id_col: str, text: str, end_id: int) -> DataFrame:
    """Rows of two parts: recipes (key: a name of the row), and chunks (key: the address) new to their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = word_encoder(path)
        task, row = TaskContext.get().partitionId(), 0
        given: set[bytes] = set()
        for batch in batches:
            column, at = pc.fill_null(batch.column(text), ""), 0
            where = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(where, where[at] + SLICE_BYTES)) - at)
                n = min(n, batch.num_rows - at)
                keys, counts, lists, roots, fresh, bodies = [], [], [], [], [], []
                whole, stops = enc.encode(column.slice(at, n), end_id)
                bounds = np.concatenate([[0], stops])
                for a, b, ends in zip(bounds[:-1], bounds[1:], cuts(whole, bounds), strict=True):
                    ids = whole[a:b].tobytes()
                    chunks = [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]  # noqa: B905
                    names = [address(c) for c in chunks]
                    for name, c in zip(names, chunks, strict=True):
                        if name not in given:
                            if len(given) < 200_000:  # beyond it copies go on, and are dropped when chunks are stored
                                given.add(name)
                            fresh.append(name)
                            bodies.append(c)
                    keys.append(struct.pack(">IQ", task, row))
                    row += 1
                    counts.append(len(ids) // 4)
                    lists.append(names)
                    roots.append(merkle(names))
                m = len(fresh)
                ids = batch.column(id_col).slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["recipes"] * n + ["chunks"] * m), pa.array(keys + fresh, pa.binary()), pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                        pa.array(counts + [None] * m, pa.int64()), pa.array(lists + [None] * m, pa.list_(pa.binary())),
                        pa.array(roots + [None] * m, pa.binary()), pa.array([None] * n + bodies, pa.binary()),
                    ],
                    ["part", "key", "doc_id", "n_tokens", "addresses", "root", "ids"],
                )
                at += n

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(
        run, f"part string, key binary, doc_id {kind}, n_tokens long, addresses array<binary>, root binary, ids binary"
    )


def write_store(docs: DataFrame, store: str, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1) -> None:
    """Encode every text of ``docs`` and write the store at ``store`` (a path that all executors reach).

    One shuffle brings equal addresses together, one copy of each is written, and the recipes beside them are then put
    in order and numbered, without the ids.
    """
    spark = docs.sparkSession
    rows = _encode(docs, tokenizer_path, id_col, text, end_id)
    first = F.row_number().over(Window.partitionBy("key").orderBy("part")) == 1
    rows.withColumn("first", first).where("first").drop("first").write.option("compression", "zstd").partitionBy("part").parquet(f"{store}/content")
    whole = spark.read.schema(rows.schema).parquet(f"{store}/content")
    recipes = whole.where("part = 'recipes'").select("doc_id", "n_tokens", "addresses", "root")
    _starts(recipes).write.option("compression", "zstd").parquet(f"{store}/recipes")
    _manifest(spark, store).write.parquet(f"{store}/manifest")


def _chunks(spark: SparkSession, store: str) -> DataFrame:
    content = spark.read.schema("part string, key binary, ids binary").parquet(f"{store}/content")
    return content.where("part = 'chunks'").select(F.col("key").alias("address"), "ids")


def _starts(rows: DataFrame) -> DataFrame:
    """Rows in ascending doc_id order with ord (the range) and start, by sums of ranges and then inside each range.

    Spark draws the bounds of ranges, by doc_id and then root, so that rows of one id can be in several; what falls where is written once.
    """
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "root").withColumn("ord", F.spark_partition_id())
    placed = stage(ranged, "recipe-ranges")
    sums = placed.groupBy("ord").agg(F.sum("n_tokens").alias("sum"))
    # One row for each range of about RANGE_ROWS documents: small at any size of the table.
    before = sums.select("ord", F.coalesce(F.sum("sum").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("ord").orderBy(F.col("doc_id").asc_nulls_first(), "root")
    inside = placed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = inside.join(before, "ord").withColumn("start", F.col("before") + F.col("inside"))
    last = placed.agg(F.max("ord")).first()[0] or 0
    return (
        joined.select("doc_id", "ord", "start", "n_tokens", "addresses", "root")
        .repartitionById(last + 1, F.col("ord"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    )


def _manifest(spark: SparkSession, store: str) -> DataFrame:
    """(documents, ids, root, ranges): a Merkle tree over the roots of each range's recipes in order, and one over the ranges' roots."""
    recipes = spark.read.parquet(f"{store}/recipes").select("ord", "start", "n_tokens", "root")
    listed = recipes.groupBy("ord").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"), F.array_sort(F.collect_list(F.struct("start", "n_tokens", "root"))).alias("leaves")
    )
    ranges = listed.select("ord", "documents", "ids", _tree_root(F.col("leaves.root")).alias("root"))
    whole = ranges.agg(
        F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), F.array_sort(F.collect_list(F.struct("ord", "documents", "ids", "root"))).alias("ranges")
    )
    return whole.select("documents", "ids", _tree_root(F.col("ranges.root")).alias("root"), "ranges")


@F.pandas_udf(BinaryType())
def _tree_root(lists: pd.Series) -> pd.Series:
    return lists.map(lambda leaves: merkle([bytes(x) for x in leaves]))


def verify_manifest(spark: SparkSession, store: str) -> bool:
    """Whether the recipes as they stand give the manifest that was written."""
    return spark.read.parquet(f"{store}/manifest").exceptAll(_manifest(spark, store)).isEmpty()


def _recipes(spark: SparkSession, store: str) -> DataFrame:
    """The recipes, after they have been held against the manifest."""
    if not verify_manifest(spark, store):
        raise ValueError(f"the recipes at {store} are not those of its manifest")
    return spark.read.parquet(f"{store}/recipes")


@lru_cache(maxsize=64)
def _zeros(k: int) -> np.ndarray:
    """What 2**k zero bytes do to a CRC-32 register, as tables for each of its four bytes (linear over GF(2))."""
    if k:
        return _after(_zeros(k - 1), _zeros(k - 1))
    bits = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        bits = np.where(bits & 1, (bits >> np.uint32(1)) ^ np.uint32(0xEDB88320), bits >> np.uint32(1))
    low = np.arange(256, dtype=np.uint32)
    return np.stack([bits, low, low << np.uint32(8), low << np.uint32(16)])


def _after(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]


def crc_join(crcs: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations, from the CRC-32 and the size in bytes of their parts (``firsts``: each one's first part).

    The sum of a concatenation is the exclusive or of the sums of its parts, each moved on by the bytes that follow it.
    """
    total = np.cumsum(sizes)
    last = np.append(firsts[1:], len(sizes)) - 1
    behind = np.repeat(total[last], np.diff(np.append(firsts, len(sizes)))) - total
    out = crcs.astype(np.uint32)
    for k in range(int(behind.max(initial=0)).bit_length()):
        out = np.where(behind >> k & 1, _after(_zeros(k), out), out)
    return np.bitwise_xor.reduceat(out, firsts) if len(firsts) else out


def _checked(batch: pa.RecordBatch) -> list[bytes]:
    bodies = batch.column("ids").to_pylist()
    for name, body in zip(batch.column("address").to_pylist(), bodies, strict=True):
        if address(body) != name:
            raise ValueError(f"the chunk {name.hex()} does not have the ids of its address")
    return bodies


def _complete(names: list[bytes | None], parts: list, root: bytes, doc: object) -> None:
    if any(p is None for p in parts):
        raise ValueError(f"document {doc}: a chunk is missing")
    if merkle(names) != root:
        raise ValueError(f"document {doc}: the recipe does not have its Merkle root")


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files and checked against them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = _checked(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("address"), pa.array([len(b) for b in bodies], pa.int32()), pa.array([zlib.crc32(b) for b in bodies], pa.int64())],
                ["address", "size", "crc"],
            )

    chunks = _chunks(spark, store).mapInArrow(sums, "address binary, size int, crc long")
    recipes = _recipes(spark, store)
    parts = (
        recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("addresses").alias("pos", "address"))
        .join(chunks, "address", "left")
        .groupBy("start", "doc_id", "n_tokens", "root")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "address", "size", "crc"))).alias("parts"))
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            flat = lists.flatten()
            firsts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            names, found = flat.field("address").to_pylist(), flat.field("crc").to_pylist()
            docs, counts = (batch.column(c).to_pylist() for c in ("doc_id", "n_tokens"))
            for i, root in enumerate(batch.column("root").to_pylist()):
                _complete(names[firsts[i] : firsts[i + 1]], found[firsts[i] : firsts[i + 1]], root, docs[i])
            sizes = flat.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
            if (np.add.reduceat(sizes, firsts[:-1]) != 4 * np.array(counts, np.int64)).any():
                raise ValueError("a document's chunks do not have its number of ids")
            crcs = crc_join(np.array(found, np.int64), sizes, firsts[:-1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return parts.mapInArrow(join, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start and the ids (binary, little-endian 32-bit) of every document, checked against recipe and addresses."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _checked(batch)
            yield batch

    chunks = _chunks(spark, store).mapInArrow(check, "address binary, ids binary")
    recipes = _recipes(spark, store)
    parts = (
        recipes.select("doc_id", "start", "root", F.posexplode("addresses").alias("pos", "address"))
        .join(chunks, "address", "left")
        .groupBy("start", "doc_id", "root")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "address", "ids"))).alias("parts"))
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for doc, root, ps in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "root", "parts")), strict=True):
                _complete([p["address"] for p in ps], [p["ids"] for p in ps], root, doc)
                ids.append(b"".join(p["ids"] for p in ps))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return parts.mapInArrow(join, f"doc_id {kind}, start long, ids binary")
