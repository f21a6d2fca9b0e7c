"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Words are runs of bytes other than the six ASCII spaces, unchanged. A window repeats if the same words also
start in a document with a smaller doc_id; the words that repeated windows cover, merged into maximal
intervals, are removed, and the rest is joined by single spaces; a text that loses nothing stays as it is (its digest
is that of its words joined the same way). All windows are judged on the input.

How it runs. Each task cuts its rows into chunks of about CHUNK_BYTES of text and hashes every window. Equal
windows of a chunk are first reduced to the smallest document that has them. The rest goes, packed, to hash
buckets that look at no more than one entry for a window and chunk, so a passage in a third of all documents
is no hot key; a bucket answers with one bit for each entry: does a smaller document start it elsewhere? Texts
meet the answers of their chunk compressed. Windows match on 64 bits and on a bucket drawn from other bits.
Chunks are numbered by input task and Arrow batch, so `docs` must be a stored table (write a computed frame first), and both
readings take the same columns: the bytes of all columns decide where a batch ends. A checksum of each chunk's windows
travels with the answers; a chunk that reads differently the second time is an error.

Defined results: a null or empty text has no words; a missing doc_id counts as larger than every other
(documents without ids do not remove each other's words); rows with the same doc_id do not remove each
other's words either, since neither is smaller.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.chunked import chunks, from_planes, packed, planes, unpacked
from cellwright.llm.tables import column, own_columns, scan_tasks
from cellwright.llm.words import mixed, run_hashes, slices, tokens, window_starts, word_hashes

WINDOW = 13
_NO_ID = np.iinfo(np.int64).max
_U = np.uint64


class Windows:
    """The windows of a chunk, and its entries: each distinct window with the smallest document that has it."""

    def __init__(self, docs: pa.Array, texts: pa.Array, width: int):
        ids = docs.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        hashes, at, owner, words = [], [], [], [0]
        for start, end, data, offsets in slices(texts):
            starts, ends, rows = tokens(data, offsets)
            first = window_starts(rows, width)
            hashes.append(mixed(run_hashes(word_hashes(data, starts, ends), first, first + width)))
            at.append(first + words[-1])
            owner.append(np.repeat(ids[start:end], np.diff(np.searchsorted(first, rows))))
            words += (rows[1:] + words[-1]).tolist()
        self.rows = np.array(words)
        self.width = width
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        found = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        order = np.lexsort((self.owner, found))
        ordered = found[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)]
        self.hashes, self.smallest = ordered[fresh], self.owner[order][fresh]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1

    def checksum(self) -> int:
        """Tells chunks of other rows apart."""
        found = 0
        for part in (self.rows, self.at, self.owner, self.hashes, self.smallest):
            found = zlib.crc32(part.tobytes(), found)
        return found

    def buckets(self, n: int) -> np.ndarray:
        return (mixed(self.hashes ^ _U(0x5851F42D4C957F2D)) % _U(n)).astype(np.int64)

    def removed(self, elsewhere: np.ndarray) -> np.ndarray:
        """A flag for each word. elsewhere: a flag for each entry."""
        again = elsewhere[self.entry] | (self.owner > self.smallest[self.entry])
        step = np.zeros(int(self.rows[-1]) + 1, np.int64)
        np.add.at(step, self.at[again], 1)
        np.add.at(step, self.at[again] + self.width, -1)
        return np.cumsum(step[:-1]) > 0


def _entries(width: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in chunks(batches):
            w = Windows(column(rows, "doc_id"), column(rows, "text"), width)
            bucket = w.buckets(n)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            full = np.flatnonzero(np.diff(cuts))
            parts = [order[cuts[b]:cuts[b + 1]] for b in full]
            checks = [w.checksum(), *[None] * (len(full) - 1)][:len(full)]  # once for each chunk
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(np.full(len(full), chunk), pa.int64()),
                 pa.array([planes(w.hashes[p]) for p in parts], pa.binary()), pa.array([planes(w.smallest[p]) for p in parts], pa.binary()), pa.array(checks, pa.int64())],
                ["bucket", "chunk", "hashes", "smallest", "checksum"])

    return run


def _answers(entries: pa.Table) -> pa.Table:
    """For each chunk's entries of this bucket: is there a smaller document? Entries with a checksum answer in any case."""
    chunk, checksum, packed = column(entries, "chunk"), column(entries, "checksum"), column(entries, "hashes")
    hashes = [from_planes(x.as_py(), _U) for x in packed]
    smallest = np.concatenate([from_planes(x.as_py(), np.int64) for x in column(entries, "smallest")])
    sizes = [len(h) for h in hashes]
    values = np.concatenate(hashes)
    order = np.lexsort((smallest, values))
    ordered = values[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.repeat(smallest[order][first], np.diff(np.append(first, len(order))))
    flags = np.empty(len(order), bool)
    flags[order] = smallest[order] > least
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    some = [k for k, (p, c) in enumerate(zip(parts, checksum.to_pylist(), strict=True)) if p.any() or c is not None]
    return pa.table({
        "chunk": chunk.take(pa.array(some, pa.int64())),
        "bucket": column(entries, "bucket").take(pa.array(some, pa.int64())),
        "bits": pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary()),
        "checksum": checksum.take(pa.array(some, pa.int64())),
    })


def _removal(width: int, n: int, digest: bool):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        changed = ValueError("the input changed between two readings; write it to a table first")
        if texts.num_rows != 1:
            raise changed
        rows = unpacked(column(texts, "rows")[0].as_py())
        w = Windows(column(rows, "doc_id"), column(rows, "text"), width)
        if column(answers, "checksum").drop_null().to_pylist() != ([w.checksum()] if len(w.hashes) else []):
            raise changed
        bucket, elsewhere = w.buckets(n), np.zeros(len(w.hashes), bool)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n + 1))
        for b, bits in zip(column(answers, "bucket").to_pylist(), column(answers, "bits").to_pylist(), strict=True):
            own = order[cuts[b]:cuts[b + 1]]
            elsewhere[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        gone = w.removed(elsewhere)
        originals = column(rows, "text").to_pylist()
        texts_out, removed = [], np.add.reduceat(np.append(gone, 0), w.rows[:-1]) * (np.diff(w.rows) > 0)
        for k, text in enumerate(column(rows, "text").cast(pa.large_binary()).fill_null(b"").to_pylist()):
            words = text.split()
            if removed[k]:
                flags = gone[w.rows[k]:w.rows[k + 1]]
                words = [x for x, g in zip(words, flags.tolist(), strict=True) if not g]
            texts_out.append(b" ".join(words) if digest or removed[k] else originals[k])
        counts = [pa.array(np.diff(w.rows), pa.int64()), pa.array(removed, pa.int64())]
        if digest:
            return pa.table([column(rows, "doc_id"), *counts, pa.array([hashlib.sha256(t).hexdigest() for t in texts_out], pa.string())],
                            ["doc_id", "n_words", "n_removed", "kept_sha256"])
        texts_out = pa.array([t.decode() if isinstance(t, bytes) else t for t in texts_out], pa.string())
        rest = [c for c in rows.column_names if c not in ("doc_id", "text")]
        return pa.table([column(rows, "doc_id"), texts_out, *[column(rows, c) for c in rest], *counts], ["doc_id", "text", *rest, "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, width: int = WINDOW, carry: tuple[str, ...] = (), digest: bool = False) -> DataFrame:
    """doc_id, the kept text, the `carry` columns, n_words and n_removed; with `digest`, kept_sha256 instead of text and carry."""
    docs = own_columns(docs, "doc_id", "text", *([] if digest else carry))
    n = max(512, 4 * scan_tasks(docs))
    entries = docs.mapInArrow(_entries(width, n), "bucket int, chunk long, hashes binary, smallest binary, checksum long")
    answers = entries.groupBy("bucket").applyInArrow(_answers, "chunk long, bucket int, bits binary, checksum long")
    texts = docs.mapInArrow(packed, "chunk long, rows binary")
    counts = "n_words long, n_removed long"
    kept = ", ".join(["text string", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    schema = f"doc_id long, {counts}, kept_sha256 string" if digest else f"doc_id long, {kept}, {counts}"
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_removal(width, n, digest), schema)


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of removed words, as word positions with exclusive ends."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
