"""Helpers of the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Regular expression of a word: a run of bytes other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased.

    ``bytes.lower`` touches A-Z only, and ``bytes.split`` cuts at exactly the
    six bytes that the word pattern excludes.
    """
    return text.lower().split()


def utf8(column: str = "text") -> Column:
    """The column's UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def batch_of(schema: str | None = None, **columns) -> pa.RecordBatch:
    """A record batch from keyword columns (arrow arrays, numpy arrays or lists)."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def column(batch: pa.RecordBatch, name: str, dtype=np.int64) -> np.ndarray:
    """A column without nulls as a numpy array."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def size_within(df: DataFrame, rows: int) -> bool:
    """Whether the frame has at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def give_back() -> None:
    """Return a Python worker's freed memory to the system, as workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def documents_schema(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NullType)]


#: Types of arrays that are packed as steps.
STEPS = (np.uint64, np.uint32)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, one plane of bytes after the other; unsigned ones, which come in order or in runs, as steps."""
    planes = []
    for a in arrays:
        if a.dtype in STEPS:
            a = np.diff(a, prepend=a.dtype.type(0))
        planes.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.itemsize).T))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, *dtypes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = [np.dtype(d).itemsize for d in dtypes]
    n, at, out = len(raw) // sum(sizes), 0, []
    for d, s in zip(dtypes, sizes):
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * s, at).reshape(s, n).T).view(d).ravel()
        out.append(np.cumsum(a, dtype=d) if d in STEPS else a)
        at += n * s
    return out
