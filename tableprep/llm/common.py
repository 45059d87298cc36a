"""What several of these operators share: reading, hold-out rows, and walking Arrow batches in small pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
HELD_OUT_REMAINDER = 2
# Text handled at once inside a task, so that arrays of a few times its size stay small.
PIECE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a row stays out of training: crc32 of its id's text, modulo 4, is 2 (a null id counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == HELD_OUT_REMAINDER


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 places where its texts begin. Null is empty."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    if filled.offset or len(filled) == 0:
        filled = pa.concat_arrays([filled, pa.array([""], pa.large_string())])[:-1]
    starts = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1 + filled.offset)[filled.offset :]
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def pieces(starts: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most `most` bytes each, or one text where it alone is longer."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def sums_between(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]], zero where that is empty."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out
