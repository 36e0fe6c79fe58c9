"""Vector tables as Arrow batches, and packing of rows into blocks of bounded size for searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(batch: pa.RecordBatch, id_col: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as doubles) by dimension, of the rows with an id whose vector is neither null nor holds
    a null or non-finite component."""
    column = batch.column(vector)
    ids = batch.column(id_col)
    ok = ~(column.is_null().to_numpy(zero_copy_only=False) | ids.is_null().to_numpy(zero_copy_only=False))
    column, ids = column.filter(pa.array(ok)), ids.filter(pa.array(ok)).to_numpy().astype(np.int64)
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = flat[starts[at][:, None] + np.arange(dim)[None]] if dim else np.zeros((len(at), 0))
        good = np.isfinite(x).all(1)
        yield ids[at[good]], x[good]


def prepared(df: DataFrame, change: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], dtype: str, id_col: str, vector: str) -> DataFrame:
    """(vec_id, dim, vec): each usable vector after ``change``, which gives new vectors and which of them take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in rows_of(batch, id_col, vector):
                y, ok = change(x)
                y, ids = np.ascontiguousarray(y[ok], dtype), ids[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.full(len(ids), x.shape[1], np.int32)), pa.array([r.tobytes() for r in y], pa.binary())],
                    ["vec_id", "dim", "vec"],
                )

    return df.select(id_col, vector).mapInArrow(run, "vec_id long, dim int, vec binary")


def distinct(rows: DataFrame) -> DataFrame:
    """``rows`` without copies of a row, which a mass-repeated row loses before the shuffle, so that blocks stay of bounded size."""
    return rows.dropDuplicates(["vec_id", "dim", "vec"])


def sample(rows: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` rows, those with the least hash of the id."""
    return rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(most).toPandas()


def with_part(rows: DataFrame, part: Callable[[int, np.ndarray], np.ndarray], dtype: str, many: bool = False) -> DataFrame:
    """``rows`` and the part (``many``: one row for each of its parts) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                b = batch.filter(pa.array(dims == dim))
                x = matrix(b.column("vec").to_pylist(), int(dim), dtype).astype(np.float64)
                parts = part(int(dim), x)
                if many:
                    b = b.take(pa.array(np.repeat(np.arange(len(x)), parts.shape[1])))
                    parts = parts.ravel()
                yield b.append_column("part", pa.array(parts.astype(np.int32)))

    return rows.mapInArrow(run, "vec_id long, dim int, vec binary, part int")


def matrix(vecs: list[bytes], dim: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype).reshape(len(vecs), dim)


def salted(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with a salt that cuts each (dim, part) into blocks of about ``most`` rows at most, rows of one id among them."""
    sizes = rows.groupBy("dim", "part").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("n_salts"))
    # One row for each part; parts are bounded by a parameter, dimensions are few.
    return rows.join(sizes, ["dim", "part"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "vec"), F.col("n_salts")).cast("int")).drop("n_salts")
