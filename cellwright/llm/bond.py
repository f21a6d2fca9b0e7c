"""Hard-negative mining by a vertical scan (BOND) over columnar dimensions.

Vectors become integers, floor(256 c), and scores are their exact inner products. The rows are cut into blocks of about
BLOCK rows, each stored dimension by dimension with the least and greatest value of each. An anchor reads the
dimensions of a block in the falling order of its own magnitudes: the first quarter and, if that dropped few candidates of the block
before, all at once (STEP at a time where scores need 64-bit integers). What the dimensions not yet read
can add to a score lies between the sums of their least and greatest contributions; a candidate whose score can no
longer enter any window it is sought for leaves the candidate bitmap. What is left after the last dimension has its exact
score. Two such scans are made: one for the best rows of an anchor's own label (its positives, in a window without bounds), and
one for the best rows of other labels in the window that each positive's score sets.

All anchors meet all rows, in blocks: the blocks of rows are dealt over slots by hash, so neither a hot label nor a repeated
vector is gathered anywhere, and the anchors (in parts of about ANCHORS) go to every slot. A task holds the blocks of its slot and
keeps the best few rows of each anchor of the part at hand; these alone are shuffled and ranked.

Rows without vec_id or label, whose vector is null or empty, or holds a null or non-finite component or one beyond the
limit (integers up to 2**26, less for vectors longer than 1,024) take no part. Vectors meet only those of their own
length. Of rows that share vec_id and length one counts: the one with the least label, then the least vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.llm.tables import column, own_columns
from cellwright.llm.vectors import matrices, stepped
from cellwright.session import Steps

SCALE = 256
BLOCK = 4096
ANCHORS = 2048
#: Anchors that meet a block together; slots at least, and bytes of blocks that one of them holds at most.
MANY = 256
SLOTS = 64
HELD = 64 << 20
STEP = 8
MOST = 26


class Share(NamedTuple):
    """A negative's score lies between low / 100 and high / 100 of the positive's."""

    low: int = 50
    high: int = 95


class Block(NamedTuple):
    """Rows of a block by dimension. Sums are exact: floats where all of them stay below 2**24, doubles below 2**53, else 64-bit integers."""

    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray
    least: np.ndarray
    most: np.ndarray


def limit(size: int) -> int:
    return min(1 << MOST, math.isqrt((1 << 62) // size))


def scan(block: Block, query: np.ndarray, alive: np.ndarray, lows: np.ndarray, highs: np.ndarray, count: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the candidates that may be among the best `count` of a window; the windows are closed."""
    order = np.argsort(-np.abs(query), kind="stable")
    ends = query * block.least, query * block.most
    rest_low = np.cumsum(np.minimum(*ends)[order][::-1])[::-1]
    rest_high = np.cumsum(np.maximum(*ends)[order][::-1])[::-1]
    at = np.flatnonzero(alive)
    score = np.zeros(len(at), query.dtype)
    for read in range(0, len(order), step):
        dims = order[read:read + step]
        part = block.columns[dims] if len(at) == len(alive) else block.columns[np.ix_(dims, at)]
        score += query[dims] @ part
        then = read + step
        low, high = (rest_low[then], rest_high[then]) if then < len(order) else (0, 0)
        keep = np.zeros(len(at), bool)
        for a, b in zip(lows.tolist(), highs.tolist(), strict=True):
            inside = score + high >= a
            inside &= score + low <= b
            sure = score[(score + low >= a) & (score + high <= b)]
            if len(sure) >= count:  # as many as are sought can no longer leave the window: the least of the best of these bounds the rest
                inside &= score + high >= np.partition(sure, len(sure) - count)[len(sure) - count] + low
            keep |= inside
        if not keep.all():
            at, score = at[keep], score[keep]
        if not len(at):
            break
    return at, score


def scan_many(block: Block, rows: np.ndarray, queries: np.ndarray, alive: np.ndarray, lows: np.ndarray, highs: np.ndarray, early: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The scan for many queries at once, each with its own order of the dimensions and one closed window: queries, places and exact scores.

    rows: the block by row. early: bounds are tried after the first dimensions of each query. The last value says whether they dropped a half.
    """
    size = queries.shape[1]
    first = size // 4 if early else 0
    score, pays = None, False
    if first:
        order = np.argsort(-np.abs(queries), axis=1, kind="stable")
        rest = queries.copy()
        np.put_along_axis(rest, order[:, :first], 0, axis=1)
        ends = rest * block.least, rest * block.most
        score = (queries - rest) @ block.columns
        before = np.count_nonzero(alive)
        alive &= score + np.maximum(*ends).sum(axis=1)[:, None] >= lows[:, None]
        alive &= score + np.minimum(*ends).sum(axis=1)[:, None] <= highs[:, None]
        pays = 2 * np.count_nonzero(alive) < before
        if 16 * np.count_nonzero(alive) < alive.size:
            own, at = np.nonzero(alive)
            found = score[own, at] + np.einsum("ij,ij->i", rest[own], rows[at])
            inside = (found >= lows[own]) & (found <= highs[own])
            return own[inside], at[inside], found[inside], pays
        queries = rest
    score = queries @ block.columns if score is None else score + queries @ block.columns
    alive &= score >= lows[:, None]
    alive &= score <= highs[:, None]
    own, at = np.nonzero(alive)
    return own, at, score[own, at], pays


class Best:
    """The best `count` rows so far of each window of the anchors of a part: higher scores first, ties by smaller id."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray, count: int):
        self.lows, self.highs, self.count = lows, highs, count
        self.score, self.ids = (np.zeros((len(lows), count), np.int64) for _ in range(2))
        self.held = np.zeros(len(lows), np.int64)

    def floors(self) -> np.ndarray:
        """What a score must reach to enter the window."""
        return np.where(self.held == self.count, np.maximum(self.lows, self.score[:, -1]), self.lows)

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(window):
            return
        some = np.unique(window)
        full = np.arange(self.count) < self.held[some][:, None]
        window = np.concatenate([window, np.repeat(some, self.held[some])])
        score, ids = np.concatenate([score, self.score[some][full]]), np.concatenate([ids, self.ids[some][full]])
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        start = np.searchsorted(window, some)
        rank = np.arange(len(window)) - np.repeat(start, np.diff(np.append(start, len(window))))
        kept = rank < self.count
        self.score[window[kept], rank[kept]], self.ids[window[kept], rank[kept]] = score[kept], ids[kept]
        self.held[some] = np.minimum(np.diff(np.append(start, len(window))), self.count)


def _cells(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.filter(pc.and_(column(batch, "vec_id").is_valid(), column(batch, "label").is_valid()))
            for size, at, vectors in matrices(column(named, "embedding")):
                fits, x = stepped(vectors, SCALE, limit(size))
                kept = named.take(pa.array(at[fits]))
                yield pa.RecordBatch.from_arrays(
                    [column(kept, "vec_id"), column(kept, "label"), pa.array(np.full(len(x), size), pa.int32()), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())],
                    ["vec_id", "label", "size", "x"])

    return rows.mapInArrow(run, "vec_id long, label long, size int, x binary")


def _unique(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Length, ids, labels and integer vectors of the rows, one for each id."""
    ids, labels, held = column(rows, "vec_id").to_numpy(), column(rows, "label").to_numpy(), column(rows, "x").to_pylist()
    size = len(held[0]) // 4
    order = np.lexsort((labels, ids))
    if len(np.unique(ids)) < len(ids):
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], labels[k], held[k])))
    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
    return size, ids[order], labels[order], np.frombuffer(b"".join([held[k] for k in order.tolist()]), np.int32).reshape(-1, size)


def _blocked(rows: pa.Table) -> pa.Table:
    """One row: the vectors by dimension."""
    size, ids, labels, x = _unique(rows)
    parts = {"ids": ids, "labels": labels, "columns": np.ascontiguousarray(x.T), "least": x.min(axis=0), "most": x.max(axis=0)}
    return pa.table({"size": pa.array([size], pa.int32()), "block": column(rows, "block").slice(0, 1), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()}})


def _opened(row: dict, kind: np.dtype) -> Block:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    least, most = (np.frombuffer(row[k], np.int32).astype(kind) for k in ("least", "most"))
    return Block(ids, labels, np.frombuffer(row["columns"], np.int32).reshape(-1, len(ids)).astype(kind), least, most)


def _kind(row: dict, vectors: np.ndarray) -> np.dtype:
    reach = max(int(np.abs(np.frombuffer(row[k], np.int32).astype(np.int64)).max(initial=0)) for k in ("least", "most"))
    most = vectors.shape[1] * reach * int(np.abs(vectors.astype(np.int64)).max(initial=0))
    return np.dtype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)


def _blocks(cells: DataFrame, block: int, steps: Steps) -> DataFrame:
    many = max(1, -(-cells.count() // block))
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(many)))
    kinds = "size int, block long, ids binary, labels binary, columns binary, least binary, most binary"
    return steps.settle(dealt.groupBy("size", "block").applyInArrow(_blocked, kinds), "blocks")


def _scanned(blocks: DataFrame, anchors: DataFrame, count: int, other: bool, per: int) -> DataFrame:
    """size, anchor, window, score and id: the best `count` rows of each window of each anchor, by each task.

    anchors: size, vec_id, label, x and `windows` (id, low, high). other: rows of other labels are sought, else those of the same.
    A block is sent to one slot, the anchors to every slot: what is moved grows with the rows, and with the anchors by the slots.
    """
    groups = max(1, -(-anchors.count() // per))
    many, held_bytes = blocks.agg(F.count_distinct("block"), F.sum(F.length("columns"))).first()
    slots = max(1, min(many, max(SLOTS, -(-(held_bytes or 0) // HELD))))

    def gathered(rows: pa.Table) -> pa.Table:
        own = rows.take(pa.array(np.argsort(column(rows, "vec_id").to_numpy(), kind="stable")))
        windows = column(own, "windows")
        flat, bounds = windows.flatten(), np.concatenate([[0], np.cumsum(windows.value_lengths().to_numpy())]).astype(np.int64)
        parts = {"a_ids": column(own, "vec_id").to_numpy(), "a_labels": column(own, "label").to_numpy(), "a_bounds": bounds,
                 **{f"a_{k}": flat.field(k).to_numpy(zero_copy_only=False) for k in ("id", "low", "high")}}
        packed = {k: pa.array([np.ascontiguousarray(v).astype(np.int64).tobytes()], pa.binary()) for k, v in parts.items()}
        return pa.table({"size": column(own, "size").slice(0, 1), "part": column(own, "part").slice(0, 1), **packed, "a_x": pa.array([b"".join(column(own, "x").to_pylist())], pa.binary())})

    names = ["a_ids", "a_labels", "a_bounds", "a_id", "a_low", "a_high", "a_x"]
    held = anchors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).groupBy("size", "part")
    held = held.applyInArrow(gathered, f"size int, part long, {', '.join(f'{n} binary' for n in names)}")
    held = held.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = blocks.withColumn("slot", F.pmod("block", F.lit(slots)).cast("int")).withColumn("part", F.lit(-1).cast("long"))
    both = dealt.unionByName(held, allowMissingColumns=True)
    # a partition for each slot: the blocks of a length, then its anchors part by part
    both = both.repartitionById(slots, F.col("slot")).sortWithinPartitions("size", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if now != row["size"]:
                    now, own = row["size"], []
                if row["part"] < 0:
                    own.append(row)
                elif own:
                    yield from _met(row, own, count, other)

    return both.mapInArrow(run, "size int, anchor long, window long, score long, id long")


def _met(row: dict, own: list[dict], count: int, other: bool) -> Iterator[pa.RecordBatch]:
    """The best rows that all anchors of a part find in the blocks of a slot."""
    ids, labels, bounds, window, low, high = (np.frombuffer(row[k], np.int64) for k in ("a_ids", "a_labels", "a_bounds", "a_id", "a_low", "a_high"))
    vectors = np.frombuffer(row["a_x"], np.int32).reshape(len(ids), -1)
    best, pays, turn = Best(low, high, count), True, 0
    for stored in own:
        kind = _kind(stored, vectors)
        block = _opened(stored, kind)
        if kind == np.int64:
            _meet(block, vectors.astype(kind), ids, labels, bounds, best, other)
            continue
        rows, queries = np.ascontiguousarray(block.columns.T), vectors.astype(kind)
        for start in range(0, len(ids), MANY):
            turn += 1
            pays = _meet_many(block, rows, queries, ids, labels, bounds, best, other, start, pays or turn % 16 == 0)
    anchor = np.repeat(ids, np.diff(bounds))
    full = np.arange(count) < best.held[:, None]
    if full.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(int(full.sum()), row["size"]), pa.int32()), pa.array(np.repeat(anchor, best.held)), pa.array(np.repeat(window, best.held)), pa.array(best.score[full]), pa.array(best.ids[full])],
            ["size", "anchor", "window", "score", "id"])


def _meet(block: Block, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, bounds: np.ndarray, best: Best, other: bool) -> None:
    """All anchors of a part against one block, one by one: 64-bit integers have no fast products."""
    for k, (anchor, label, a, b) in enumerate(zip(ids.tolist(), labels.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        same = block.labels == label
        alive = (~same if other else same) & (block.ids != anchor)
        lows, highs = best.floors()[a:b], best.highs[a:b]
        at, score = scan(block, vectors[k], alive, lows, highs, best.count)
        for w in range(b - a):
            inside = (score >= lows[w]) & (score <= highs[w])
            best.add(np.full(int(inside.sum()), a + w), score[inside], block.ids[at[inside]])


def _meet_many(block: Block, rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, labels: np.ndarray, bounds: np.ndarray, best: Best, other: bool, start: int, early: bool) -> bool:
    """MANY anchors from `start` on against one block; did the bounds drop a half early?"""
    end = min(start + MANY, len(ids))
    a, b = int(bounds[start]), int(bounds[end])
    owner = np.repeat(np.arange(end - start), np.diff(bounds[start:end + 1]))
    same = block.labels == labels[start:end, None]
    alive = (~same if other else same) & (block.ids != ids[start:end, None])
    floors, highs = best.floors()[a:b], best.highs[a:b]
    least, most = (np.full(end - start, v, np.int64) for v in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
    np.minimum.at(least, owner, floors)
    np.maximum.at(most, owner, highs)
    reach = 1 << (24 if queries.dtype == np.float32 else 53)  # beyond all scores
    least, most = (np.clip(x, -reach, reach).astype(queries.dtype) for x in (least, most))
    own, at, score, pays = scan_many(block, rows, queries[start:end], alive, least, most, early)
    score = score.astype(np.int64)
    many = np.diff(bounds[start:end + 1])
    for turn in range(int(many.max(initial=0))):
        place = bounds[start:end][own] + turn
        inside = many[own] > turn
        place = np.where(inside, place, a)
        inside &= (score >= floors[place - a]) & (score <= highs[place - a])
        best.add(place[inside], score[inside], block.ids[at[inside]])
    return pays


def _ranked(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("size", "anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, share: Share = Share(), block: int = BLOCK, per: int = ANCHORS) -> DataFrame:  # noqa: B008
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    rows: vec_id, label and embedding. anchor: which vec_id are anchors. An anchor's positives are the `positives` other rows
    of its label with the highest scores; for each, the `negatives` first rows of other labels with
    share.low * positive <= 100 * negative <= share.high * positive, higher scores first, ties by smaller vec_id.
    """
    steps = Steps(rows.sparkSession)
    cells = steps.settle(_cells(own_columns(rows, "vec_id", "label", "embedding")), "cells")
    blocks = _blocks(cells, block, steps)
    one = F.struct(F.col("label").alias("label"), F.col("x").alias("x"))
    anchors = cells.where(anchor).groupBy("size", "vec_id").agg(F.min(one).alias("one")).select("size", "vec_id", "one.label", "one.x")
    anchors = steps.settle(anchors, "anchors")
    steps.drop(cells)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(-(1 << 63)).alias("low"), F.lit((1 << 63) - 1).alias("high")))
    near = _ranked(_scanned(blocks, anchors.withColumn("windows", whole), positives, False, per), positives)
    near = steps.settle(near.select("size", F.col("anchor").alias("vec_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # in a window of 64-bit integers: the least and the greatest score that fulfil both conditions
    low, high = (F.col("positive_score").cast("decimal(38,0)") * s for s in share)
    window = F.struct(F.col("positive_id").alias("id"), F.ceil(low / 100).cast("long").alias("low"), F.floor(high / 100).cast("long").alias("high"))
    windows = near.where(window["low"] <= window["high"]).groupBy("size", "vec_id").agg(F.collect_list(window).alias("windows"))
    sought = steps.settle(anchors.join(windows, ["size", "vec_id"]), "sought")
    steps.drop(anchors)
    far = _ranked(_scanned(blocks, sought, negatives, True, per), negatives)
    far = far.select("size", F.col("anchor").alias("vec_id"), F.col("window").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["size", "vec_id", "positive_id"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
