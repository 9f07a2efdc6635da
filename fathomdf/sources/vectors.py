"""Vector files as tables and back: raw f32, .npy, Arrow IPC.

Files are read by Spark's own binary reader, so any store that Spark reads will do; each file is decoded by one task.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fathomdf.session import ship

SCHEMA = "file string, row bigint, embedding array<float>"


def detect(path: str) -> str:
    """Format by extension."""
    for end, kind in ((".npy", "npy"), (".f32", "raw"), (".fvecs", "fvecs"), (".arrow", "ipc"), (".ipc", "ipc"), (".parquet", "parquet")):
        if path.lower().endswith(end):
            return kind
    raise ValueError(f"unknown vector format: {path}")


def decode(raw: bytes, kind: str, dim: int | None = None) -> np.ndarray:
    """The matrix in a file."""
    if kind == "npy":
        m = np.load(io.BytesIO(raw), allow_pickle=False)
        if m.ndim != 2:
            raise ValueError(f"a matrix is needed, not {m.ndim} dimensions")
        return m.astype(np.float32)
    if kind == "ipc":
        t = pa.ipc.open_file(raw).read_all() if raw[:6] == b"ARROW1" else pa.ipc.open_stream(raw).read_all()
        return np.array(t["embedding"].to_pylist(), np.float32)
    if kind == "fvecs":
        d = int.from_bytes(raw[:4], "little")
        return np.frombuffer(raw, np.float32).reshape(-1, d + 1)[:, 1:]
    if not dim or len(raw) % (4 * dim):
        raise ValueError("raw f32 needs a dimension that divides the file")
    return np.frombuffer(raw, np.float32).reshape(-1, dim)


def read_vectors(spark: SparkSession, path: str, kind: str | None = None, dim: int | None = None) -> DataFrame:
    """(file, row, embedding) of one file or of a folder of files of one kind."""
    ship(spark)
    kind = kind or detect(path)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = decode(raw, kind, dim)
                for lo in range(0, len(m), 4096):
                    x = np.ascontiguousarray(m[lo : lo + 4096])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(lo, lo + len(x))), lists], names=["file", "row", "embedding"])

    return files.mapInArrow(run, SCHEMA)


def to_ipc(df: DataFrame) -> bytes:
    """A small result as an Arrow IPC stream."""
    t, out = df.toArrow(), io.BytesIO()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue()


def from_ipc(spark: SparkSession, raw: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(raw).read_all())


def raw_blocks(df: DataFrame, vector_col: str = "embedding", id_col: str | None = None) -> DataFrame:
    """(part, block, content): raw f32 blocks of each partition, in order of id, to be written as binary by any sink."""
    src = df.select(id_col or vector_col, vector_col)
    src = src.sortWithinPartitions(id_col) if id_col else src

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(batches):
            raw = np.array(b.column(b.num_columns - 1).to_pylist(), np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([raw], pa.binary())], names=["block", "content"])

    return src.mapInArrow(run, "block int, content binary")
