"""Operator 6, language ID with error-correcting output codes.

Each language has a codeword of +1 and -1. One binary classifier for each bit, a logistic model over
hashed byte trigrams and bytes of the whole text, predicts that bit; all are fitted together. Decoding weights
each bit's logistic loss by how well that bit was learned for the language, and picks the nearest
codeword. A prediction whose runner-up is nearly as near is flagged in ``ambiguous``.

The model is fitted on a bounded sample: at most ``ROWS_PER_LANGUAGE`` rows of each language, those with the
least hash of doc_id and text, and at most ``MAX_ROWS`` rows in all, taken in turn from the languages (so with more languages than
that, those without a row in the sample are not learned). Every row is predicted. Rows that share an id are rows of their own.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Rows with a null doc_id are
predicted and never learned from. Without any row to learn from each text is ``und`` with score 0; with one
language each text with a letter has it, with score 1. An empty table gives an empty result.
Other columns pass through; held_out, lang_pred, score and ambiguous are replaced if there.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from . import textkit
from .staging import small_batches

#: Bound of the fitting sample for each language, and of all of it (8.7 KB a row on the driver).
ROWS_PER_LANGUAGE, MAX_ROWS = 1000, 8_000
TRIGRAM_BITS = 12
WIDTH = (1 << TRIGRAM_BITS) + 256
AMBIGUOUS_BELOW = 0.6
UNKNOWN = "und"

#: Letters lower-cased, bytes of non-ASCII characters as they are, all else a space.
_SHAPE = np.full(256, 32, np.uint32)
_SHAPE[65:91] = np.arange(97, 123)
_SHAPE[97:123] = np.arange(97, 123)
_SHAPE[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, np.int64)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = 1


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed trigrams and of bytes, for each document."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    b = _SHAPE[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    one = np.bincount(doc * 256 + b, minlength=n * 256).reshape(n, 256)[:, :256].astype(np.float32)
    one[:, 32] = 0
    if len(b) > 2:
        h = ((b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS)
        whole = doc[:-2] == doc[2:]
        three = np.bincount((doc[:-2] * (1 << TRIGRAM_BITS) + h)[whole], minlength=n << TRIGRAM_BITS)
        out[:, 256:] = three.reshape(n, -1)
    out[:, :256] = one
    for part in (out[:, :256], out[:, 256:]):
        part /= np.maximum(part.sum(1, keepdims=True), 1)
    return np.sqrt(out, out=out)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: every split of the classes while that is few, else the best of some random codes."""
    if k <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=k) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float32).T.reshape(k, -1)
    rng, best = np.random.default_rng(k), (-1, None)
    bits = math.ceil(10 * math.log2(k))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        apart = (bits - code @ code.T) / 2
        least = apart[~np.eye(k, dtype=bool)].min()
        if least > best[0] and (np.abs(code.sum(0)) < k).all():
            best = (least, code)
    return best[1]


class Ecoc:
    """Binary models of codeword bits and the decoding of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str], steps: int = 120) -> None:
        self.names = names
        k = len(names)
        if k < 2:
            return
        self.code = codewords(k)
        target = self.code[y]
        share = np.bincount(y, minlength=k)
        weight = (len(y) / (k * share))[y][:, None].astype(np.float32) / len(y)
        w = np.zeros((x.shape[1] + 1, self.code.shape[1]), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):  # Adam on the logistic loss with a little shrinkage
            z = x @ w[:-1] + w[-1]
            g = -target * weight / (1 + np.exp(np.clip(target * z, -30, 30)))
            grad = np.vstack([x.T @ g, g.sum(0, keepdims=True)]) + 1e-6 * w
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        self.w = w
        right = (np.sign(x @ w[:-1] + w[-1]) == target).astype(np.float64)
        learned = np.array([right[y == c].mean(0) for c in range(k)])
        self.bit_weight = learned / learned.sum(1, keepdims=True)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest language, its share among all by loss, and whether another is about as near."""
        n = len(x)
        if len(self.names) < 2:
            return np.zeros(n, int), np.full(n, float(len(self.names))), np.zeros(n, bool)
        z = (x @ self.w[:-1] + self.w[-1]).astype(np.float64)
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None])
        total = (loss * self.bit_weight[None]).sum(2) * self.code.shape[1] / 2
        p = np.exp(total.min(1, keepdims=True) - total)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(n), best]
        return best, top, top < AMBIGUOUS_BELOW


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Ecoc:
    """A model of a sample of the rows that have a language and are not held out."""
    small_batches(docs.sparkSession)
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    # A first cut by hash leaves about twice as many rows of a language as are wanted, so that few texts move; then their number is exact.
    counts = usable.groupBy(lang).agg(F.count(F.lit(1)).alias("__n"))
    order = F.xxhash64(F.col(id_col).cast("string"), F.col(text))
    place = F.shiftrightunsigned(order, 1) / float(1 << 63)
    likely = usable.select(id_col, text, lang, order.alias("__order"), place.alias("__place")).join(counts, lang)
    first = F.row_number().over(Window.partitionBy(lang).orderBy("__order", F.col(id_col).cast("string"), text))
    best = likely.where(F.col("__place") * F.col("__n") < 2 * ROWS_PER_LANGUAGE + 20).withColumn("__nr", first).where(F.col("__nr") <= ROWS_PER_LANGUAGE)
    # One row of each language, then a second one, and so on, up to the bound.
    rows = best.orderBy("__nr", "__order", lang, text).limit(MAX_ROWS).select(id_col, text, lang)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textkit.slices(batch, text, max_rows=256):
                x = grams(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(a, b - a).cast(pa.string()), batch.column(lang).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["id", "lang", "x"],
                )

    found = rows.mapInArrow(extract, "id string, lang string, x binary").toArrow()
    if not found.num_rows:
        return Ecoc(np.zeros((0, WIDTH), np.float32), np.zeros(0, int), [])
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    langs, ids = found.column("lang").to_pylist(), found.column("id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (langs[i], ids[i]))  # the fit does not depend on the order of rows
    names = sorted(set(langs))
    at = {name: i for i, name in enumerate(names)}
    return Ecoc(x[order], np.array([at[langs[i]] for i in order], int), names)


def predict(docs: DataFrame, model: Ecoc, id_col: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and ambiguous."""
    small_batches(docs.sparkSession)
    new = {"held_out", "lang_pred", "score", "ambiguous"}
    others = [c for c in docs.columns if c.lower() not in new]
    wanted = [c for c in others if keep_text or c != text]
    schema = StructType(
        [docs.schema[c] for c in wanted]
        + [StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, unsure = [], [np.zeros(0)], [np.zeros(0, bool)]
            for a, b, data, offsets in textkit.slices(batch, text, max_rows=256):
                known = textkit.sums(_ASCII_LETTER[data], offsets) > 0
                for i in np.flatnonzero(~known):
                    known[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
                if not model.names:
                    known[:] = False
                best, top, close = model.decode(grams(data, offsets))
                lang += [model.names[c] if k else UNKNOWN for c, k in zip(best, known, strict=True)]
                score.append(np.where(known, top, 0.0))
                unsure.append(np.where(known, close, True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in wanted]
                + [batch.column("held_out"), pa.array(lang, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(unsure))],
                [*wanted, "held_out", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(*others, held_out(id_col).alias("held_out")).mapInArrow(run, schema)
