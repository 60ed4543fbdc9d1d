"""Packed exchange: rows travel as sorted numpy arrays between frames (groups of documents) and buckets (ranges of keys).

A frame sends each bucket one row that holds its distinct keys, so a key in very many rows is one entry for each frame.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrays import U64, mix

FRAME_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh one only in local mode without it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataframe-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"written": path}) if df.columns else df


def drop_written(df: DataFrame) -> None:
    """Delete the table behind written(); its readers must be done."""
    path = df.schema[0].metadata.get("written")
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def frames_for(total_bytes: int, spark: SparkSession) -> int:
    """Frames of about FRAME_BYTES, a multiple of the shuffle's partitions once there is that much."""
    need = -(-max(total_bytes, 1) // FRAME_BYTES)
    parts = partitions(spark)
    return need if need <= parts else -(-need // parts) * parts


def heads_of(values: np.ndarray) -> np.ndarray:
    """First index of each run of equal values of a sorted array."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def spans_of(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values of a sorted array."""
    heads = heads_of(values)
    return list(zip(heads, [*heads[1:], len(values)], strict=True)) if len(heads) else []


def to_buckets(frame: int, buckets: int, keys: np.ndarray, *more: np.ndarray, first: int = 0) -> pa.Table:
    """One row for each bucket (numbered from first on) that has keys: bucket, frame, and the packed keys and companions."""
    if not len(keys):
        return packed_table([], [], *[[] for _ in range(1 + len(more))])
    bucket = ((mix(keys) >> U64(32)) * U64(buckets)) >> U64(32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    spans = spans_of(bucket)
    heads = [a for a, _ in spans]
    columns = [[x[a:b].tobytes() for a, b in spans] for x in (y[order] for y in (keys, *more))]
    return packed_table((bucket[heads] + U64(first)).astype(np.int32), np.full(len(heads), frame, np.int32), *columns)


def packed_table(first, second, *columns) -> pa.Table:
    names = ["bucket", "frame", *(f"c{i}" for i in range(len(columns)))]
    return pa.table([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names)


def packed_by_frame(frame: np.ndarray, *columns: np.ndarray, bucket: int = 0) -> pa.Table:
    """One row for each frame with its values packed."""
    order = np.argsort(frame, kind="stable")
    frame = frame[order]
    spans = spans_of(frame)
    packed = [[x[a:b].tobytes() for a, b in spans] for x in (y[order] for y in columns)]
    return packed_table(np.full(len(spans), bucket, np.int32), frame[heads_of(frame)].astype(np.int32), *packed)


def packed_schema(columns: int) -> str:
    return "bucket int, frame int" + "".join(f", c{i} binary" for i in range(columns))


def unpacked(column: pa.ChunkedArray, kind=U64) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and how many each row holds."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    sizes = np.array([len(x) for x in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), sizes


def shared_in_bucket(table: pa.Table) -> pa.Table:
    """Keys that two frames hold, or two rows of one frame (flag 1), sent back to every frame that has them."""
    keys, sizes = unpacked(table["c0"])
    flags, _ = unpacked(table["c1"], np.uint8)
    frame = np.repeat(table["frame"].to_numpy(), sizes)
    order = np.argsort(keys, kind="stable")
    keys, frame, flags = keys[order], frame[order], flags[order]
    heads = heads_of(keys)
    counts = np.diff(np.concatenate([heads, [len(keys)]])) if len(heads) else heads
    twice = (counts > 1) | (np.maximum.reduceat(flags, heads) > 0 if len(heads) else np.zeros(0, bool))
    hit = np.repeat(twice, counts)
    keys, frame = keys[hit], frame[hit]
    return packed_by_frame(frame, keys)


def distinct_keys(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a frame, and 1 where two owners of the frame have the key."""
    if not len(keys):
        return keys, np.zeros(0, np.uint8)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    heads = heads_of(keys)
    low, high = np.minimum.reduceat(owner, heads), np.maximum.reduceat(owner, heads)
    return keys[heads], (low != high).astype(np.uint8)


def among(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted pool."""
    if not len(pool):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(pool, values), len(pool) - 1)
    return pool[at] == values


def text_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
