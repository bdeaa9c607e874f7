"""Vectors as bytes: the 32-bit floats of a vector one after the other, the least byte first. Columns are taken as Arrow
holds them, their buffers read as the other type: nothing is done value by value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DataType, FloatType, StructField, StructType


def _bytes_of(vectors: pa.Array) -> pa.Array:
    """A vector that is null or has a null in it has no bytes."""
    values = vectors.flatten()
    if values.null_count:
        ends = np.cumsum(np.append(0, np.diff(vectors.offsets.to_numpy())))
        gaps = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
        vectors = pc.if_else(pa.array(gaps[ends[1:]] == gaps[ends[:-1]]), vectors, None)
        values = vectors.flatten()
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    offsets = np.append(0, np.cumsum(lengths, dtype=np.int64)) * 4
    data = np.ascontiguousarray(values.to_numpy(zero_copy_only=False), "<f4")
    flat = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pc.if_else(vectors.is_valid(), flat, None)


def _vectors_of(data: pa.Array) -> pa.Array:
    """Bytes that are no whole number of floats make no vector."""
    data = pc.if_else(pc.equal(pc.bit_wise_and(pc.binary_length(data), 3), 0), data, None)
    lengths = pc.fill_null(pc.binary_length(data), 0).to_numpy()
    offsets = np.append(0, np.cumsum(lengths // 4, dtype=np.int64)).astype(np.int32)
    joined = b"".join(data.drop_null().to_pylist()) if data.offset or data.null_count else (data.buffers()[2] or b"")
    values = pa.array(np.frombuffer(joined, "<f4", count=int(offsets[-1])), pa.float32())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=data.is_null())


def _mapped(rows: DataFrame, column: str, into: str, f: Callable[[pa.Array], pa.Array], kind: DataType) -> DataFrame:
    columns = [c for c in rows.columns if c != into]
    schema = StructType([rows.schema[c] for c in columns] + [StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = f(batch.column(column))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), made], [*columns, into])

    return rows.mapInArrow(run, schema)


def with_bytes(rows: DataFrame, column: str, into: str) -> DataFrame:
    """rows with a vector column of floats also as bytes."""
    return _mapped(rows.withColumn(column, rows[column].cast("array<float>")), column, into, _bytes_of, BinaryType())


def with_vectors(rows: DataFrame, column: str, into: str) -> DataFrame:
    """rows with a column of bytes also as vectors."""
    return _mapped(rows, column, into, _vectors_of, ArrayType(FloatType()))
