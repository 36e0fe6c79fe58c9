"""Operator 7, line dedup: lines found in many documents go, in DataFrame operations only.

Each text is split at ``\\n``. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and
with A-Z lower-cased. Keys are exploded once per document, hashed to 128 bits, and counted with a
map-side combine. Keys found in ``min_docs`` documents or more lose all their lines; the kept lines
are put together again by position.

Defined results: every row counts as a document of its own, so repeated rows (also with one doc_id)
count each. A null or empty text is one empty line, which has an empty key: it is never dropped with
``min_chars`` of 1 or more. A row with a null doc_id is kept. An empty table gives an empty result. Other
columns pass through; those that have the name of an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Characters stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent keys (16 bytes each) are broadcast up to this count, and joined by shuffle beyond it.
BROADCAST_KEYS = 500_000

_ID, _TEXT, _POS, _H1, _H2 = "__ld_id", "__ld_text", "__ld_pos", "__ld_h1", "__ld_h2"


def line_key(line: Column) -> Column:
    """The line's key. Trimming and the slow translate() run only where a line needs them."""
    edge = (F.substring(line, 1, 1) <= F.lit(" ")) | (F.substring(line, -1, 1) <= F.lit(" "))
    bare = F.when(edge, F.trim(line, F.lit(STRIPPED))).otherwise(line)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(key: Column) -> list[Column]:
    """128 bits: two 64-bit hashes of different inputs."""
    return [F.xxhash64(key).alias(_H1), F.xxhash64(F.concat(F.lit("\x01"), key)).alias(_H2)]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_keys(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Hashes of the keys of at least ``min_chars`` code points in at least ``min_docs`` documents."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col(text)), line_key))).alias("key"))
    return (
        keys.where(F.char_length("key") >= min_chars)
        .select(*_hashes(F.col("key")))
        .groupBy(_H1, _H2)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs)
        .select(_H1, _H2)
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` rid of frequent lines, and the columns n_lines and n_dropped."""
    frequent = stage(frequent_keys(docs, text, min_docs, min_chars), "frequent-lines")
    small = frequent.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    # A row is known by its id and text: rows alike in both lose the same lines.
    row = [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(_ID), F.xxhash64(F.col(text)).alias(_TEXT)]
    lines = docs.select(*row, F.posexplode(_lines(F.col(text))).alias(_POS, "line"))
    keyed = lines.select(_ID, _TEXT, _POS, line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hits = (
        keyed.select(_ID, _TEXT, _POS, *_hashes(F.col("key")))
        .join(F.broadcast(frequent) if small else frequent, [_H1, _H2], "left_semi")
        .groupBy(_ID, _TEXT)
        .agg(F.collect_set(_POS).alias(_POS))
    )
    others = [c for c in docs.columns if c.lower() not in {"n_lines", "n_dropped"}]
    joined = docs.select(*others, *row).join(hits.hint("shuffle_hash"), [_ID, _TEXT], "left")
    split = joined.withColumn("__ld_lines", _lines(F.col(text)))
    size = F.size("__ld_lines")
    kept = F.array_except(F.sequence(F.lit(0), size - 1), F.col(_POS))
    whole = F.coalesce(F.col(text), F.lit(""))
    new_text = F.when(F.col(_POS).isNull(), whole).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("__ld_lines"), i)), "\n")
    )
    columns = [new_text.alias(c) if c == text else F.col(c) for c in others]
    return split.select(
        *columns,
        size.cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col(_POS)), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(result: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return result.select(id_col, "n_lines", "n_dropped", F.sha2(F.col(text), 256).alias("kept_sha256"))
