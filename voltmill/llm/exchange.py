"""Compact questions to a distributed dictionary.

Every chunk of documents reduces its keys to one sorted list, cuts it at fixed borders, and sends each cut to the task
that owns that range of keys. There the cuts of all chunks meet as flat arrays. This is a shuffle of sorted, packed
columns instead of one row for each key: a common key travels once per chunk, however often it occurs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

#: Bits of a key. Keys are hashes; two of them agree by chance about once in 2^48 comparisons.
KEY_BITS = 48


def ranges(spark: SparkSession) -> int:
    """Number of key ranges: several for each shuffle partition, so that they spread evenly."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def borders(count: int) -> np.ndarray:
    """Lower border of each key range, and the end of the last."""
    return np.array([(r << KEY_BITS) // count for r in range(count + 1)], np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes of the smallest width that holds them all."""
    if len(values) == 0:
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + planes.T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, :width] = planes.T
    return values.view("<u8").ravel()


def pack_sorted(values: np.ndarray, base: int = 0) -> bytes:
    """Ascending numbers, none below ``base``, as packed differences."""
    if len(values) == 0:
        return b""
    values = values.astype(np.uint64)
    steps = np.empty_like(values)
    steps[0] = values[0] - np.uint64(base)
    steps[1:] = values[1:] - values[:-1]
    return pack(steps)


def unpack_sorted(data: bytes, base: int = 0) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64) + np.uint64(base)
