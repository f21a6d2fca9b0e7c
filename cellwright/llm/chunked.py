"""Chunks of rows that ask hash buckets about what they hold, and meet the answers compressed.

Chunks are numbered by input task, so a frame that is read twice must be a stored table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from cellwright.llm.tables import column
from cellwright.llm.words import slices

CHUNK_BYTES = 1 << 20


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbered runs of rows with about `size` bytes of text; the number is unique over all tasks."""
    seen = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start, end, _, _ in slices(column(batch, "text"), size):
            yield seen, batch.slice(start, end - start)
            seen += 1


def planes(values: np.ndarray) -> bytes:
    """64-bit values by byte position, so that equal high bytes stand together."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, rows in chunks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_batch(rows)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([zlib.compress(sink.getvalue(), 3)], pa.binary())], ["chunk", "rows"])


def unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(zlib.decompress(raw)).read_all().combine_chunks()
