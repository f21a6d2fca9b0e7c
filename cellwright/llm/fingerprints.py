"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's five-word shingles (words are runs of bytes
other than the six ASCII spaces, unchanged; a text with fewer words has its whole sequence as its one
shingle, a text without words none). The sketch of a union is the k smallest of the merged hashes, so
sketches of parts merge; two sketches estimate resemblance, containment and the distinct count.

As text a sketch is the base64 form of its hashes in rising order, six bytes each, big-endian.
Equal texts have equal sketches; two texts without words resemble each other fully.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.tables import column, own_columns, scan_tasks
from cellwright.llm.words import shingle_hashes, slices, tokens, word_hashes

WIDTH = 5
K = 256
HASH_BITS = 48
_SPACE = float(1 << HASH_BITS)


def sketches(texts: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """One rising array of at most k hashes for each text."""
    found = []
    for _, _, data, offsets in slices(texts):
        starts, ends, rows = tokens(data, offsets)
        hashes, bounds = shingle_hashes(word_hashes(data, starts, ends), rows, width)
        hashes = hashes >> np.uint64(64 - HASH_BITS)
        found += [np.unique(hashes[a:b])[:k] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return found


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Exact below k hashes; else from the k-th smallest."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _SPACE / (float(sketch[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of the union's sketch that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    first = np.concatenate([[True], both[1:] != both[:-1]])
    twice = np.concatenate([both[1:] == both[:-1], [False]])
    union = np.flatnonzero(first)[:k]
    return float(twice[union].sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too; 1 if a has none."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def fingerprint(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id and the sketch of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [to_text(s) for s in sketches(column(batch, "text"), k, width)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def merge_groups(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """One sketch for each value of `key`: the union of the group's documents.

    Every task first merges what it holds of a group, so a large group sends one row from each task.
    """
    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(column(batch, "key").to_pylist(), column(batch, "fingerprint").to_pylist(), strict=True):
                new = from_text(text or "")
                held[name] = merge(held[name], new, k) if name in held else new
                if len(held) >= 4096:
                    yield packed(held)
                    held = {}
        yield packed(held)

    def packed(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([v.astype(np.int64).tolist() for v in held.values()], pa.list_(pa.int64()))],
            ["key", "hashes"])

    parts = prints.select(F.col(key).cast("string").alias("key"), "fingerprint").mapInArrow(partly, "key string, hashes array<long>")
    united = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))), 1, k)
    return parts.groupBy("key").agg(united.alias("hashes")).select(F.col("key").alias(key), "hashes")


def neighbours(docs: DataFrame, least_buckets: int = 256) -> DataFrame:
    """Every text beside its own edited form and the next document's likeness, in falling order of doc_id.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many
    (or all) of the next document; the last document is followed by the first. Rows with the same id follow
    each other by text, rows without an id come last, a null text is empty; a table of one row is its own
    next. Ids are cut into ranges; each range gets the one row that follows it from the range below, so
    the texts are shuffled once and read in order, and only the ranges' bounds reach the driver.
    """
    docs = own_columns(docs, "doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low - 1, high)
    ranges = max(least_buckets, 4 * scan_tasks(docs))
    wide = max(1, -(-(high - low + 1) // ranges))
    keyed = docs.withColumn("at", F.coalesce("doc_id", F.lit(low))).withColumn("bucket", ((F.col("at") - low) / wide).cast("long"))
    tops = sorted((r["bucket"], r["top"]) for r in keyed.groupBy("bucket").agg(F.max("at").alias("top")).collect())
    carried = [(top, tops[k + 1][0], False) for k, (_, top) in enumerate(tops[:-1])]
    carried += [(tops[-1][1], tops[0][0], True)] if tops else []
    spark = docs.sparkSession
    carry = spark.createDataFrame(carried, "at long, into long, wrapped boolean").groupBy("at").agg(F.collect_list(F.struct("into", "wrapped")).alias("more"))
    own = F.array(F.struct(F.col("bucket").alias("into"), F.lit(False).alias("wrapped"), F.lit(True).alias("own")))
    more = F.transform(F.coalesce("more", F.array()), lambda m: F.struct(m["into"].alias("into"), m["wrapped"].alias("wrapped"), F.lit(False).alias("own")))
    # the carried rows are at most one for each range, whatever the input
    sent = keyed.join(F.broadcast(carry), "at", "left").select("doc_id", "text", "at", F.explode(F.concat(own, more)).alias("to"))
    sent = sent.select(F.col("to.into").alias("bucket"), F.col("to.wrapped").alias("wrapped"), F.col("to.own").alias("own"), "at", "doc_id", "text")
    ordered = sent.repartition("bucket").sortWithinPartitions("bucket", "wrapped", F.desc("at"), F.asc("text"))
    return ordered.mapInArrow(_compare, COMPARED)


COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range follow each other; the row after a row of its own range is its next document."""
    waiting: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = list(zip(*[column(part, c).to_pylist() for c in ("bucket", "own", "doc_id")],
                            [t or "" for t in column(part, "text").to_pylist()], strict=True))
            rows = waiting + rows
            waiting = rows[-1:]
            yield _pairs(rows)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    texts = [r[3] for r in rows]
    kept, edited = [], []
    for k in range(len(rows) - 1):
        if rows[k][1] and rows[k + 1][0] == rows[k][0]:
            third = len(texts[k]) // 3
            kept.append(k)
            edited.append(texts[k][:len(texts[k]) - third] + texts[k + 1][:third])
    own, new = sketches(pa.array(texts, pa.large_string())), sketches(pa.array(edited, pa.large_string()))
    out = [
        [rows[k][2] for k in kept], [len(texts[k]) for k in kept], [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        [to_text(own[k]) for k in kept], [to_text(n) for n in new],
        [resemblance(own[k], n) for k, n in zip(kept, new, strict=True)], [resemblance(own[k], own[k + 1]) for k in kept],
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                      ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
