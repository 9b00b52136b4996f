"""Helpers shared by the operators: cutting lineage, Arrow text buffers, byte contexts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.session import work_dir

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again: a lost executor costs no
    recomputation of what lies before, and later plans see real sizes."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value):
    """A broadcast of any object; ``shared`` gives it back in a worker, which needs not have the
    object's module."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast):
    if not hasattr(broadcast, "loaded"):
        broadcast.loaded = pickle.loads(broadcast.value)
    return broadcast.loaded


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant of it that clashes with no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def bucket_of(column: Column, buckets: int) -> Column:
    """crc32 of the value as text, modulo ``buckets``; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % buckets


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``size`` bytes of text in a column, or one row, each, so
    that what a function makes of a part stays small beside a batch of long texts."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row of a string column; nulls count as empty."""
    data, offsets = utf8(column)
    data = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of runs of rows of about ``size`` bytes. A row
    longer than that comes alone, in several pieces."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        if end > row:
            yield row, end, int(offsets[row]), int(offsets[end])
            row = end
        else:
            for at in range(int(offsets[row]), int(offsets[row + 1]), size):
                yield row, row + 1, at, min(at + size, int(offsets[row + 1]))
            row += 1


def context_codes(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, order: int) -> np.ndarray:
    """For bytes lo..hi of ``data`` the ``order`` bytes before each, as an integer with the
    nearest byte lowest. Bytes before a row's start are zero."""
    starts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
    codes = np.zeros(hi - lo, np.int64)
    for back in range(1, order + 1):
        before = np.zeros(hi - lo, np.int64)
        first = max(0, back - lo)
        before[first:] = data[lo + first - back : hi - back] if hi > back else 0
        for offset in range(back):
            at = starts + offset
            before[at[at < hi - lo]] = 0
        codes |= before << (8 * (back - 1))
    return codes


def row_sums(values: np.ndarray, offsets: np.ndarray, rows: slice, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with bytes in a block, and the sums of ``values`` (bytes first) over each of them."""
    begin = np.maximum(offsets[rows.start : rows.stop], lo) - lo
    end = np.minimum(offsets[rows.start + 1 : rows.stop + 1] - lo, len(values))
    full = np.flatnonzero(end > begin)
    if not len(full):
        return full, np.zeros((0, *values.shape[1:]))
    return full + rows.start, np.add.reduceat(values, begin[full], axis=0, dtype=np.float64)
