"""Which 64-bit values do several owners hold? Told with four bytes a value, in shards of the values.

Owners lie in buckets. Each batch of a bucket sends a shard its distinct values, as 31 bits besides
those that tell the shard and a bit for values that several owners of the batch hold. The shard
returns to each bucket those of its values that several owners hold, or seem to: values that agree in
31 bits are taken for one, so a value may be called shared by chance but never not shared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _bytes as B

SCHEMA = "shard long, bucket long, data binary"


def shard_of(value: np.ndarray, shards: int) -> np.ndarray:
    return (value % np.uint64(shards)).astype(np.int64)


def _brief(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(33)).astype(np.uint32)


def _blocks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new))


def pack(bucket: np.ndarray, value: np.ndarray, owner: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rows (shard, bucket, data) of the batch's values."""
    shard, brief = shard_of(value, shards), _brief(value)
    order = np.lexsort((owner, brief, shard, bucket))
    bucket, shard, brief, owner = bucket[order], shard[order], brief[order], owner[order]
    first, stop = _blocks(bucket, shard, brief)
    several = owner[first] != owner[stop - 1]
    bucket, shard, data = bucket[first], shard[first], (brief[first] << np.uint32(1)) | several.astype(np.uint32)
    first, stop = _blocks(bucket, shard)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[first]), pa.array(bucket[first]), pa.array([data[i:j].tobytes() for i, j in zip(first, stop, strict=True)], pa.binary())], ["shard", "bucket", "data"]
    )


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]
    every = np.concatenate(parts)
    brief = every >> np.uint32(1)
    value = np.sort(brief)
    several = np.unique(np.concatenate([value[1:][value[1:] == value[:-1]], brief[every & np.uint32(1) == 1]]))
    hit = np.isin(brief, several)
    bucket, brief = B.distinct(np.repeat(table.column("bucket").to_numpy(), [len(x) for x in parts])[hit], brief[hit])
    first, stop = _blocks(bucket)
    data = [brief[i:j].tobytes() for i, j in zip(first, stop, strict=True)]
    return pa.table({"shard": pa.array([key[0].as_py()] * len(data), pa.int64()), "bucket": pa.array(bucket[first], pa.int64()), "data": pa.array(data, pa.binary())})


def shared(packed: DataFrame) -> DataFrame:
    """(shard, bucket, data): each bucket's shared values. A value is in one row of a batch at most, so a hot one is a row a batch."""
    return packed.groupBy("shard").applyInArrow(_answer, SCHEMA)


def unpack(answers: pa.Table) -> np.ndarray:
    """A bucket's shared values, for among()."""
    known = [np.zeros(0, np.uint64)]
    for shard, data in zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True):
        known.append(np.frombuffer(data, np.uint32).astype(np.uint64) | (np.uint64(shard) << np.uint64(31)))
    return np.sort(np.concatenate(known))


def among(known: np.ndarray, value: np.ndarray, shards: int) -> np.ndarray:
    """Which values are shared."""
    if not len(known):
        return np.zeros(len(value), bool)
    code = _brief(value).astype(np.uint64) | (shard_of(value, shards).astype(np.uint64) << np.uint64(31))
    return known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
