"""Operator 3, near-duplicate documents by DartMinHash.

A document is a weighted set of hashed runs of five words. For each element darts are thrown at its region of the
(weight, rank) plane, as a Poisson process that depends on the element's hash alone: unit area of weight and
rank holds one dart on average, and a document keeps the darts below its weight and below a rank threshold set
so that about ``K ln K + 2K`` stay. Each dart is hashed to one of K coordinates, and the earliest of each is the
signature. Two signatures agree at a coordinate with the probability of their weighted Jaccard similarity. The cost is one
hash for each element and a few operations for each dart, whatever K is. Documents left with empty
coordinates are thrown again with twice the rank.

``BANDS`` bands of ``ROWS`` coordinates make buckets. In a bucket each document is paired with the least id (never with
all), pairs are checked exactly on their sets of shingles, and links make components. A bucket that still has several
components is compared by signature, in blocks of bounded size, each document outside the hub's component with
all of the bucket, so that no link is lost that a bucket could give. Small buckets give their pairs as rows, so that a
pair that meets in many of them is compared once; the hub's own pairs are not compared again. Texts alike but for case and punctuation
are one class from the start, and only one of them goes on.

The similarity is Jaccard on distinct shingles, ``threshold`` and more being a link: the weight of each shingle is 1. With ``weighted`` the weight is
how often the document has the shingle, in the signatures as in the exact check (sum of the lesser by sum of the greater weights). A pair at 0.8 shares a bucket with a
probability of 1 - 7e-6, and passes to the exact check with one of 1 - 6e-9.

Defined results: classes are named by their least doc_id. A text with fewer than five words is one run of
them. A text without words is a class with equal texts only; a null text is alone in its class. Rows with
a null doc_id get a null class. Repeated rows get the class of their text. Where an id
comes with different texts each is classed by itself, two classes may have that id as their name, and ``deduplicate`` keeps one row of each. An empty table gives an empty result. Other columns
are left out of ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .components import components
from .staging import small_batches, stage

BANDS, ROWS = 30, 5
K = BANDS * ROWS
DARTS = K * np.log(K) + 2 * K
#: Documents compared by signature in one group, of either side of a pair of blocks.
BLOCK = 512
#: Documents of an open bucket up to which its pairs are listed, once over all buckets; larger buckets are compared in blocks.
FEW = 32
#: Shingles (a document counts as PER_DOC more) whose signatures are made together: the shortest documents need very many rounds, whether few or many.
TOGETHER, PER_DOC = 1 << 19, 100
#: Shingles (a document counts as 10 more) whose darts are thrown at one time: that takes some hundred bytes for each.
THROWN = 1 << 16
#: Signature agreement from which a pair is checked exactly: 6 standard deviations below 0.8, where the loss is small beside the bands'.
MAYBE = 0.6
#: Ids of documents whose texts are looked up are broadcast up to this count, and joined by shuffle beyond it.
BROADCAST_IDS = 1_000_000

_SEED = np.uint64(0x5851F42D4C957F2D)
_SCALE = 1.0 / 2**53


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * _SCALE


def throw(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, rank_limit: np.ndarray, n_docs: int) -> np.ndarray:
    """The earliest dart of each coordinate of each document, as rank (float bits) and name; all ones where there is none.

    ``element``, ``weight`` and ``doc`` have a row for each element of a document; ``rank_limit`` one for each document.
    The weight axis is cut at powers of two. In a strip of width s darts arrive along the rank axis at rate s, each at
    a hashed place within the strip's weights.
    """
    best = np.full(n_docs * K, np.uint64(2**64 - 1))
    limit = rank_limit[doc]
    low, width = 0.0, 1.0
    while len(element):
        h = textkit.mix64(element ^ textkit.mix64(np.array([_SEED + np.uint64(int(low) + 1)]))[0])
        rank = np.zeros(len(h))
        e_weight, e_doc, e_limit = weight, doc, limit
        first = True
        while len(h):
            u = _uniform(h)
            if first:  # the logarithm is taken only where a dart stays
                stay = u > np.exp(-width * e_limit)
                first = False
                h, u, rank, e_weight, e_doc, e_limit = (x[stay] for x in (h, u, rank, e_weight, e_doc, e_limit))
                rank = -np.log(u) / width
            else:
                rank = rank - np.log(u) / width
                stay = rank < e_limit
                h, rank, e_weight, e_doc, e_limit = (x[stay] for x in (h, rank, e_weight, e_doc, e_limit))
            name = textkit.mix64(h + _SEED)
            within = low + width * _uniform(textkit.mix64(name)) < e_weight
            place = e_doc[within] * K + (name[within] % np.uint64(K)).astype(np.int64)
            earliest = rank[within].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            np.minimum.at(best, place, earliest | (name[within] >> np.uint64(32)))
            h = textkit.mix64(h ^ np.uint64(0xA0761D6478BD642F))
        low, width = (1.0, 1.0) if low == 0 else (low * 2, low * 2)
        more = weight > low
        element, weight, doc, limit = element[more], weight[more], doc[more], limit[more]
    return best.reshape(n_docs, K)


def _thrown(element: np.ndarray, weight: np.ndarray, starts: np.ndarray, count: np.ndarray, rank_limit: np.ndarray) -> np.ndarray:
    """``throw`` for documents whose elements begin at ``starts``, THROWN elements at a time."""
    ends = np.cumsum(count)
    best = np.full((len(count), K), np.uint64(2**64 - 1))
    for low in range(0, int(ends[-1]), THROWN):
        at = np.arange(low, min(low + THROWN, int(ends[-1])))
        doc = np.searchsorted(ends, at, side="right")
        at += (starts - ends + count)[doc]
        first = int(doc[0])
        mine = best[first : int(doc[-1]) + 1]
        np.minimum(mine, throw(element[at], weight[at], doc - first, rank_limit[first : first + len(mine)], len(mine)), out=mine)
    return best


def signatures(element: np.ndarray, weight: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """K names of darts (uint32) for each document; documents without elements get zeros."""
    n = len(firsts) - 1
    count = np.diff(firsts)
    total = np.add.reduceat(np.append(weight, 0.0), np.minimum(firsts[:-1], len(weight)))
    total[count == 0] = 0
    out = np.zeros((n, K), np.uint32)
    # Documents of like sizes are thrown together: the short ones alone take many rounds, and they have few shingles.
    todo, darts = np.flatnonzero(count > 0), DARTS
    todo = todo[np.argsort(total[todo], kind="stable")]
    while len(todo):
        cost = np.cumsum(count[todo] + 10) // THROWN
        missed = []
        for some in np.split(todo, np.flatnonzero(np.diff(cost)) + 1):
            best = _thrown(element, weight, firsts[some], count[some], darts / total[some])
            full = (best != np.uint64(2**64 - 1)).all(1)
            out[some[full]] = best[full].astype(np.uint32)
            missed.append(some[~full])
        todo, darts = np.concatenate(missed), darts * 2
    return out


def _elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with documents' offsets in them; word hashes with theirs; shingle multiplicities."""
    starts, ends, firsts = textkit.words(data, offsets)
    hashes = textkit.word_hashes(data, starts, ends)
    runs, bounds = textkit.shingles(hashes, firsts)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.argsort(runs)
    place = doc[order]
    if len(offsets) <= 1 << 16:  # 16-bit numbers are sorted by counting
        place = place.astype(np.uint16)
    order = order[np.argsort(place, kind="stable")]
    runs, doc = runs[order], doc[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(runs)))
    runs, doc = runs[at], doc[at]
    return runs, np.searchsorted(doc, np.arange(len(offsets))), hashes, firsts, times


def _contents(ids: pa.Array, null: np.ndarray, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    out = []
    for i in range(len(ids)):
        if null[i]:
            body = b"N" + str(ids[i].as_py()).encode()
        elif firsts[i] == firsts[i + 1]:
            body = b"T" + data[offsets[i] : offsets[i + 1]].tobytes()
        else:
            body = b"W" + hashes[firsts[i] : firsts[i + 1]].tobytes()
        out.append(hashlib.blake2b(body, digest_size=16).digest())
    return out


def _content(doc: str, text: str) -> Column:
    """The content of rows, as ``sign`` has it."""

    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.string(), from_pandas=True)
        data, offsets = textkit.utf8(column)
        starts, ends, firsts = textkit.words(data, offsets)
        hashes = textkit.word_hashes(data, starts, ends)
        null = column.is_null().to_numpy(zero_copy_only=False)
        return pd.Series(_contents(pa.array(ids.astype("int64")), null, data, offsets, hashes, firsts))

    return F.pandas_udf(run, "binary")(F.col(doc).cast("long"), F.col(text))


def sign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", weighted: bool = False) -> DataFrame:
    """(doc, content, sig, bands): content names the words in order; bands is null where there are no words."""

    def signed(parts: list[tuple]) -> pa.RecordBatch:
        ids, contents, some, runs, times, counts = zip(*parts, strict=True)
        times, bounds = np.concatenate(times), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        names = signatures(np.concatenate(runs), times.astype(np.float64) if weighted else np.ones(len(times)), bounds)
        h = np.zeros((len(names), BANDS), np.uint64)
        for r in range(ROWS):
            h = textkit.mix64(h * np.uint64(31) + names[:, r::ROWS].astype(np.uint64) + np.uint64(1))
        h = textkit.mix64(h + np.arange(BANDS, dtype=np.uint64)[None]).view(np.int64)
        bands = pa.array([r if ok else None for r, ok in zip(h, np.concatenate(some), strict=True)], pa.list_(pa.int64()))
        sig = names.astype(np.uint16)
        content = pa.array([c for part in contents for c in part], pa.binary())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), content, pa.array([r.tobytes() for r in sig], pa.binary()), bands], ["doc", "content", "sig", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        textkit.forget()
        for batch in batches:
            null = batch.column(text).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(id_col).cast(pa.int64())
            for a, b, data, offsets in textkit.slices(batch, text):
                runs, bounds, hashes, firsts, times = _elements(data, offsets)
                content = _contents(ids.slice(a, b - a), null[a:b], data, offsets, hashes, firsts)
                parts.append((ids.slice(a, b - a), content, np.diff(firsts) > 0, runs, times, np.diff(bounds)))
                held += len(runs) + PER_DOC * (b - a)
                if held >= TOGETHER:
                    out = signed(parts)
                    parts, held = [], 0
                    yield out
        if parts:
            yield signed(parts)

    small_batches(docs.sparkSession)
    return docs.select(id_col, text).mapInArrow(run, "doc long, content binary, sig binary, bands array<long>")


def _repeated(runs: np.ndarray, bounds: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: the k-th copy of an element is an element of its own."""
    copy = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    total = np.concatenate([[0], np.cumsum(times)])
    return textkit.mix64(np.repeat(runs, times) + textkit.mix64(copy.astype(np.uint64))), total[bounds]


def _runs(data: np.ndarray, offsets: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of documents, in any order and repeated as they are, or with ``weighted`` the set that stands for the multiset."""
    if weighted:
        runs, bounds, _, _, times = _elements(data, offsets)
        return _repeated(runs, bounds, times)
    starts, ends, firsts = textkit.words(data, offsets)
    return textkit.shingles(textkit.word_hashes(data, starts, ends), firsts)


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, weighted: bool = False) -> DataFrame:
    """The pairs (a, b) of at least ``threshold`` Jaccard similarity."""
    joined = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                n, keys = part.num_rows, []
                for c in ("ta", "tb"):
                    runs, bounds = _runs(*textkit.utf8(part.column(c)), weighted)
                    pair = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
                    key = np.sort((runs >> np.uint64(7)) | (pair << np.uint64(57)))  # equal only in the same pair
                    keys.append(key[np.append(True, key[1:] != key[:-1])] if len(key) else key)
                both = np.sort(np.concatenate(keys))
                shared = both[1:][both[1:] == both[:-1]]
                *sizes, inter = (np.bincount((k >> np.uint64(57)).astype(np.int64), minlength=n) for k in (*keys, shared))
                ok = inter >= threshold * (sizes[0] + sizes[1] - inter) - 1e-9
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(ok)), part.column("b").filter(pa.array(ok))], ["a", "b"])

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between minors and other rows of one block pair; of the links that join the same components one is given."""
    minor = pdf[pdf["side"] == 0]
    other = pdf[pdf["side"] == 1]
    out: list[tuple[int, int]] = []
    if len(minor) and len(other):
        m, o = (np.frombuffer(b"".join(x["sig"]), np.uint16).reshape(-1, K) for x in (minor, other))
        mc, oc, md, od = minor["comp"].to_numpy(), other["comp"].to_numpy(), minor["doc"].to_numpy(), other["doc"].to_numpy()
        mt, ot = minor["text"].to_numpy(), other["text"].to_numpy()
        threshold, weighted, sets, up = float(pdf["threshold"].iloc[0]), bool(pdf["weighted"].iloc[0]), {}, {}

        def root(c: int) -> int:
            while (d := up.get(c, c)) != c:
                c = d
            return c

        def shingles(doc: int, text: str) -> np.ndarray:
            if doc not in sets:
                runs, bounds, _, _, times = _elements(*textkit.utf8(pa.array([text])))
                sets[doc] = _repeated(runs, bounds, times)[0] if weighted else runs
            return sets[doc]

        for i in range(len(m)):
            for j in np.flatnonzero(((o == m[i]).sum(1) >= MAYBE * K) & (oc != mc[i])):
                if root(mc[i]) == root(oc[j]):
                    continue
                x, y = shingles(md[i], mt[i]), shingles(od[j], ot[j])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    out.append((min(md[i], od[j]), max(md[i], od[j])))
                    up[root(mc[i])] = root(oc[j])
    return pd.DataFrame({"a": pd.Series([x for x, _ in out], dtype="int64"), "b": pd.Series([y for _, y in out], dtype="int64")})


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough for a link."""
    joined = pairs.join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, K) for c in ("sa", "sb"))
            ok = pa.array((x == y).sum(1) >= MAYBE * K)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents; their ids (8 bytes each) are broadcast up to BROADCAST_IDS."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc", "left_semi")


def _members(band_rows: DataFrame, buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of buckets with several components: their components, and the component of the bucket's hub."""
    joined = band_rows.join(buckets.select("band", "hub"), "band").join(comps.select(F.col("node").alias("doc"), "comp"), "doc", "left").select(
        "band", "hub", "doc", F.coalesce("comp", "doc").alias("comp")
    )
    mains = joined.where("doc = hub").select("band", F.col("comp").alias("main"))
    with_main = joined.join(mains, "band")
    open_ = with_main.where("comp <> main").select("band").distinct()
    return with_main.join(open_, "band", "left_semi")


def _few(inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that small open buckets leave to compare, each once; and the rows of the larger ones."""
    small = inside.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= FEW).select("band")
    # The hub has been compared with all of its bucket. A pair outside its component is met from one side.
    others = inside.where("doc <> hub").join(small, "band", "left_semi")
    minors = others.where("comp <> main").select("band", F.col("doc").alias("x"), F.col("comp").alias("xc"))
    met = minors.join(others, "band").where("comp <> xc and (comp = main or x < doc)")
    pairs = met.select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b")).distinct()
    return pairs, inside.join(small, "band", "left_anti")


def _left_over(inside: DataFrame, sigs: DataFrame, texts: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Links inside the buckets that have several components after the hubs' pairs."""
    docs = _needed(texts, inside.select("doc").distinct()).dropDuplicates(["doc"]).join(sigs, "doc")
    whole = inside.join(docs, "doc")
    minor = F.col("comp") != F.col("main")
    blocks = inside.groupBy("band").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_all"), F.ceil(F.count_if(minor) / BLOCK).cast("int").alias("n_minor")
    )
    spread = F.xxhash64("doc")
    columns = ["band", "i", "j", "side", "doc", "comp", "sig", "text", "threshold", "weighted"]
    placed = whole.join(blocks, "band").withColumn("threshold", F.lit(threshold)).withColumn("weighted", F.lit(weighted))
    left = (
        placed.where(minor)
        .withColumn("i", F.pmod(spread, F.col("n_minor")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)))
        .withColumn("side", F.lit(0))
        .select(*columns)
    )
    right = (
        placed.withColumn("j", F.pmod(spread, F.col("n_all")).cast("int"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_minor") - 1)))
        .withColumn("side", F.lit(1))
        .select(*columns)
    )
    return left.unionByName(right).groupBy("band", "i", "j").applyInPandas(_compare, "a long, b long").distinct()


def _apart(contents: DataFrame, mixed: DataFrame, signed: DataFrame) -> DataFrame:
    """``contents`` with node: the rep, or where the rep's id has several contents a number of its own beyond all ids."""
    low, high = signed.agg(F.min("doc"), F.max("doc")).first()
    if high < 2**62:
        own = F.lit(high + 1) + F.monotonically_increasing_id()
    elif low > -(2**62):
        own = F.lit(low - 1) - F.monotonically_increasing_id()
    else:
        raise ValueError("repeated ids with different texts need free numbers below or above all ids")
    marked = contents.join(mixed.select(F.col("doc").alias("rep"), F.lit(True).alias("m")), "rep", "left").withColumn("own", own)
    return stage(marked.select("content", "rep", F.when(F.col("m"), F.col("own")).otherwise(F.col("rep")).alias("node")), "content-nodes")


def _resolve(docs: DataFrame, threshold: float, id_col: str, text: str, weighted: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Signed rows; (content, class_id); and where ids have several contents, (rep, content) of the row that stands for each class."""
    signed = stage(sign(docs, id_col, text, weighted), "dart-signatures")
    contents = stage(signed.where("doc is not null").groupBy("content").agg(F.min("doc").alias("rep")), "contents")
    per_id = signed.where("doc is not null").groupBy("doc").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    mixed = stage(per_id.where("lo <> hi").select("doc"), "mixed-ids")
    several = not mixed.isEmpty()
    contents = _apart(contents, mixed, signed) if several else contents.withColumn("node", F.col("rep"))
    own = contents.select(F.col("rep").alias("doc"), "content", "node")
    reps = signed.where("bands is not null").join(own, ["doc", "content"]).select(F.col("node").alias("doc"), "sig", "bands")
    band_rows = reps.select("doc", F.explode("bands").alias("band")).distinct()
    buckets = stage(
        band_rows.groupBy("band").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub"),
        "buckets",
    )
    in_buckets = stage(band_rows.join(buckets.select("band"), "band", "left_semi"), "bucket-rows")
    sigs = reps.select("doc", "sig").dropDuplicates(["doc"])
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    if several:
        of_mixed = texts.join(mixed, "doc", "left_semi").withColumn("content", _content("doc", "text")).join(own, ["doc", "content"])
        texts = texts.join(mixed, "doc", "left_anti").unionByName(of_mixed.select(F.col("node").alias("doc"), "text").dropDuplicates(["doc"]))

    def linked(pairs: DataFrame) -> DataFrame:
        sure = stage(_likely(pairs, sigs), "pairs")
        ids = sure.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        return stage(_verify(sure, _needed(texts, ids), threshold, weighted), "links")

    pairs = in_buckets.join(buckets, "band").where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    comps = stage(components(linked(pairs)), "components")
    inside = stage(_members(in_buckets, buckets, comps), "open-buckets")
    if not inside.isEmpty():
        pairs, large = _few(inside)
        more = linked(pairs)
        if not (large := stage(large, "large-buckets")).isEmpty():
            more = stage(more.union(_left_over(large, sigs, texts, threshold, weighted)), "more-links")
        if not more.isEmpty():
            comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    named = contents.join(comps.select("node", "comp"), "node", "left").select("content", "rep", F.coalesce("comp", "node").alias("class_id"))
    if not several:
        return signed, named.drop("rep"), None
    named = stage(named, "classes-by-node")
    heads = stage(named.groupBy("class_id").agg(F.min(F.struct("rep", "content")).alias("h")), "heads")
    return signed, named.join(heads, "class_id").select("content", F.col("h.rep").alias("class_id")), heads.select("h.*")


def _by_id(signed: DataFrame, named: DataFrame, id_col: str) -> DataFrame:
    return signed.select("doc", "content").join(named, "content", "left").select(
        F.col("doc").alias(id_col), F.when(F.col("doc").isNotNull(), F.col("class_id")).alias("class_id")
    )


def classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text", weighted: bool = False) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``."""
    signed, named, _ = _resolve(docs, threshold, id_col, text, weighted)
    return _by_id(signed, named, id_col)


def deduplicate(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text", weighted: bool = False) -> DataFrame:
    """``docs`` with one row of each class, that with the least doc_id; rows with a null doc_id all stay."""
    signed, named, heads = _resolve(docs, threshold, id_col, text, weighted)
    twice = stage(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("__twice")), "repeats")
    repeated = F.col(id_col) == F.col("__twice")
    if heads is not None:
        # An id has several texts: rows are chosen by id and content.
        heads = heads.select(F.col("rep").alias("__rep"), F.col("content").alias("__head"))
        chosen = F.col(id_col).cast("long") == F.col("__rep")
        once = docs.join(twice, repeated, "left_anti")
        single = once.where(F.col(id_col).isNotNull()).join(heads.select("__rep").distinct(), chosen, "left_semi")
        many = docs.join(twice, repeated, "left_semi").withColumn("__content", _content(id_col, text))
        many = many.join(heads, chosen & (F.col("__content") == F.col("__head")), "left_semi").dropDuplicates([id_col, "__content"])
        return single.unionByName(many.drop("__content")).unionByName(once.where(F.col(id_col).isNull()))
    gone = stage(_by_id(signed, named, id_col).where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("__gone")).distinct(), "gone")
    kept = docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    if twice.isEmpty():
        return kept
    single = kept.join(twice, repeated, "left_anti")
    return single.unionByName(kept.join(twice, repeated, "left_semi").dropDuplicates([id_col]))
