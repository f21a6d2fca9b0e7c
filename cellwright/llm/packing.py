"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Large-item matching: pieces above a third of the capacity go at most two to a sequence, each with the largest
partner that fits; smaller pieces then go, largest first, to the sequence with the smallest gap that takes them.

Equal lengths are interchangeable, so the packing is computed over the histogram of lengths: at most `capacity`
rows reach the driver, whatever the input, and whole runs of equal pieces move at once. The result is a table of
slots (length, ranks from-to, first sequence, offset); pieces are ranked within their length in two steps, by
blocks and within them, so that a length that a third of all pieces share is spread over many tasks.

A document is its token ids and then id 0; a null text is empty. Only longer documents are cut, into full pieces,
of which the first may be shorter. Ids come from the byte-level BPE vocabulary at `vocabulary()`; special strings in
a text get their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.llm.tables import column, own_columns, scan_tasks
from cellwright.session import settle

CAPACITY = 2048
END = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary as ranks, with its one special token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def library(path: str):
    """The same vocabulary in the tokenizer library, from the file beside it."""
    import tokenizers

    return tokenizers.Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def document_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text and END. A text that the encoder cannot take, such as one of a million blanks, goes to the library."""
    try:
        found = encoder(path).encode(text or "", allowed_special="all")
    except ValueError:
        found = library(path).encode(text or "", add_special_tokens=False).ids
    return np.array([*found, END], "<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of each document with their lengths and checksums."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield cut(batch.slice(at, 512))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            ids = document_ids(text, path)
            bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names)

    return own_columns(docs, "doc_id", "text").mapInArrow(run, PIECE)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, offset) that place every piece of the histogram.

    Sequences are held as groups of equal content, by gap: (gap, [lengths], how many).
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    done: list[tuple[tuple[int, ...], int]] = []
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], many: int) -> None:
        gap = capacity - sum(content)
        if gap:
            gaps.setdefault(gap, []).append((content, many))
        else:
            done.append((content, many))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        big = large[-1]
        at = bisect_left(large, capacity - big + 1) - 1
        if at < 0:
            put((big,), left[big])
            left[big] = 0
        else:
            other = large[at]
            many = left[big] // 2 if other == big else min(left[big], left[other])
            if many:
                put((big, other), many)
                left[big] -= many
                left[other] -= many
            else:  # a single piece of this length is left, and no shorter one fits as well
                large.pop()
                partner = bisect_left(large, min(capacity - big + 1, big)) - 1
                if partner < 0:
                    put((big,), 1)
                else:
                    put((big, large[partner]), 1)
                    left[large[partner]] -= 1
                left[big] = 0
        large = [k for k in large if left[k]]
    for small in sorted((k for k in left if left[k] and 3 * k <= capacity), reverse=True):
        while left[small]:
            fitting = min((g for g in gaps if g >= small), default=None)
            if fitting is None:
                each = min(left[small], capacity // small)
                many = left[small] // each
                put((small,) * each, many)
                left[small] -= each * many
                continue
            content, many = gaps[fitting].pop()
            if not gaps[fitting]:
                del gaps[fitting]
            each = min(fitting // small, left[small])
            used = min(many, left[small] // each)
            if used < many:
                gaps.setdefault(fitting, []).append((content, many - used))
            put(content + (small,) * each, used)
            left[small] -= each * used
    slots, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for content, many in done + [g for held in gaps.values() for g in held]:
        offset = 0
        for length in content:
            slots.append((length, ranks[length], ranks[length] + many, sequence, offset))
            ranks[length] += many
            offset += length
        sequence += many
    return slots


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut = settle(pieces(docs, capacity, path), "pieces")
    blocks = max(64, 2 * scan_tasks(docs))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = settle(cut.groupBy("length", "block").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = plan(histogram, capacity)
    # both tables are bounded: by capacity, and by capacity times the number of blocks
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("within", F.row_number().over(within) - 1).join(starts, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("within"))
    frame = _slot_frame(docs, slots)
    placed = ranked.join(frame, "length").where(F.col("slots").isNotNull())
    # the slots of a length are in rising rank order: the last that begins at or before the rank holds it
    slot = F.expr("""aggregate(sequence(1, 24), named_struct('lo', 0, 'hi', size(slots) - 1),
        (s, i) -> IF(s.lo >= s.hi, s, IF(slots[CAST((s.lo + s.hi + 1) DIV 2 AS INT)].first <= rank,
            named_struct('lo', CAST((s.lo + s.hi + 1) DIV 2 AS INT), 'hi', s.hi),
            named_struct('lo', s.lo, 'hi', CAST((s.lo + s.hi + 1) DIV 2 AS INT) - 1))),
        s -> slots[s.lo])""")
    placed = placed.withColumn("slot", slot)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def _slot_frame(docs: DataFrame, slots: list[tuple]) -> DataFrame:
    """One row for each length: its slots in rising rank order."""
    by: dict[int, list[dict]] = {}
    for length, first, _, sequence, offset in slots:
        by.setdefault(length, []).append({"first": first, "sequence": sequence, "offset": offset})
    rows = [(k, sorted(v, key=lambda s: s["first"])) for k, v in by.items()]
    return F.broadcast(docs.sparkSession.createDataFrame(rows, "length long, slots array<struct<first: long, sequence: long, offset: long>>"))
