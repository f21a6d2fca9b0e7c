"""N-gram Jaccard join by vertical partitioning, reduced to the classes it links.

The global order of all n-grams is that of their hashes. Two sets that link differ in at most h n-grams, where h
follows from their sizes and the threshold. For each range of sizes the order is cut into more than h fragments;
then at least one fragment of the two sets is equal, so equal fragments find every candidate, and common n-grams
or passages make no hot key. Sets meet in the range of the larger one: each set is cut for its own range and for
the next. A fragment that is empty tells little and is used only where a pair could have no other in common.

A bucket of sets that share a fragment answers with a forest: links that join all its sets that may be similar, by
a parity sketch that bounds the difference from below, never all pairs. The candidates are verified: a second sketch, whose
size follows that of the set, refutes most pairs of large sets that the first cannot tell apart; the overlaps of the others
are counted fragment by fragment and summed per pair. Buckets with a refuted candidate are looked at once more,
then with every pair that may link two different classes. Buckets of more than BLOCK sets are cut into pairs of
blocks. So no link between different classes is lost, and copies of a set are one set throughout.

Tables that no later step reads are removed, and shuffles as soon as the table made from them is written.

Defined results: rows that share a doc_id are one document, linked by any of its texts; a document without an
id, without a text or without words is linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.chunked import from_planes, planes
from cellwright.llm.components import components
from cellwright.llm.tables import column, own_columns, scan_tasks
from cellwright.llm.words import lowered, mixed, shingle_hashes, slices, tokens, word_hashes
from cellwright.session import Steps, settle

_U = np.uint64
PARITY_BITS = 512
PARTS = 8
BLOCK = 2048


@dataclass(frozen=True)
class Rule:
    """Shingles of `width` words link two documents when den * intersection >= num * union."""

    width: int = 3
    num: int = 90
    den: int = 100
    lower: bool = True

    def difference(self, sizes: np.ndarray | int) -> np.ndarray | int:
        """The most n-grams in which two linked sets with that sum of sizes differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=8)
def ranges(rule: Rule, largest: int) -> np.ndarray:
    """First sizes of the ranges: a set links only within its range and the next ones to both sides."""
    found = [1]
    while found[-1] <= largest or len(found) < 3:
        found.append(found[-1] * rule.den // rule.num + 1)
    return np.array([*found, found[-1] * rule.den // rule.num + 1], np.int64)


class Sets:
    """Distinct shingles of the rows of a slice, ordered by row and hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: Rule):
        data = lowered(data) if rule.lower else data
        starts, ends, rows = tokens(data, offsets)
        hashes, bounds = shingle_hashes(word_hashes(data, starts, ends), rows, rule.width)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        self.hashes, self.row = hashes[fresh], row[fresh]
        self.bounds = np.searchsorted(self.row, np.arange(len(offsets)))
        self.sizes = np.diff(self.bounds)
        self.rule = rule

    def sums(self, salt: int) -> np.ndarray:
        """Running sums of the members' hashes: equal sets have equal differences."""
        return np.concatenate([np.zeros(1, _U), np.cumsum(mixed(self.hashes ^ _U(salt)), dtype=_U)])

    def identity(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.sums(0x1F3D5B79), self.sums(0x2E4C6A88)
        return (a[self.bounds[1:]] - a[self.bounds[:-1]]).view(np.int64), (b[self.bounds[1:]] - b[self.bounds[:-1]]).view(np.int64)

    def parity(self) -> list[bytes]:
        """A bit for each of PARITY_BITS classes of n-grams: is their number odd? Differing bits bound the difference from below."""
        bit = (mixed(self.hashes + _U(0x51ED2701)) % _U(PARITY_BITS)).astype(np.int64)
        odd = np.bincount(self.row * PARITY_BITS + bit, minlength=len(self.sizes) * PARITY_BITS) & 1
        packed = np.packbits(odd.astype(bool).reshape(-1, PARITY_BITS), axis=1)
        return [p.tobytes() for p in packed]

    def profile(self) -> list[bytes]:
        """The same for each row by two to four classes for each of its n-grams, a power of two of at least 64 in all."""
        bits = _U(1) << np.maximum(6, np.ceil(np.log2(np.maximum(2 * self.sizes, 1)))).astype(_U)
        base = np.concatenate([[0], np.cumsum(bits.astype(np.int64))])
        place = (mixed(self.hashes + _U(0x2C91B6D5)) & (bits - _U(1))[self.row]).astype(np.int64) + base[self.row]
        odd = np.bincount(place, minlength=int(base[-1])) & 1
        packed = np.packbits(odd.astype(bool), bitorder="little")
        return [packed[a // 8:b // 8].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]

    def fragments(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of the fragments and their rows, for the own range of every set and for the next."""
        if not len(self.hashes):
            return
        first = ranges(self.rule, int(self.sizes.max()))
        own = np.searchsorted(first, self.sizes, "right") - 1
        sums = self.sums(0x3C5A7E91)
        for table in (own, own + 1):
            largest = first[table + 1] - 1
            most = self.rule.difference(2 * largest)
            cuts = np.where(self.sizes > 0, most + 2 + most // 16, 0)
            base = np.concatenate([[0], np.cumsum(cuts)])
            place = (((self.hashes >> _U(32)) * cuts[self.row].astype(_U)) >> _U(32)).astype(np.int64) + base[self.row]
            edge = np.searchsorted(place, np.arange(base[-1] + 1))
            row = np.repeat(np.arange(len(cuts)), cuts)
            empty = edge[1:] == edge[:-1]
            held = np.bincount(row[~empty], minlength=len(cuts))
            reach = self.rule.difference(self.sizes + np.minimum(self.sizes * self.rule.den // self.rule.num, largest))
            used = ~empty | (reach >= held)[row]
            at = (np.arange(base[-1]) - base[row]).astype(_U)
            name = mixed((table[row].astype(_U) << _U(32)) | at)
            yield mixed((sums[edge[1:]] - sums[edge[:-1]]) ^ name)[used], row[used]


def _slices(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[pa.Array, Sets]]:
    for batch in batches:
        for start, end, data, offsets in slices(column(batch, "text")):
            yield column(batch, "doc_id").slice(start, end - start), Sets(data, offsets, rule)


def described(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, the size of its set, two hashes that identify the set, and its parity sketches of fixed and of own size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _slices(batches, rule):
            a, b = sets.identity()
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets.sizes, pa.int64()), pa.array(a), pa.array(b), pa.array(sets.parity(), pa.binary()), pa.array(sets.profile(), pa.binary())],
                                             ["doc_id", "n", "a", "b", "parity", "profile"])

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long, parity binary, profile binary")


def shared_fragments(docs: DataFrame, rule: Rule) -> DataFrame:
    """(key, doc_id, many) for fragments that several rows have, `many` times in all."""
    n = max(512, 4 * scan_tasks(docs))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for ids, sets in _slices(batches, rule):
            docs_of = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for keys, row in sets.fragments():
                held.append((keys[known[row]], docs_of[row[known[row]]]))
            if sum(len(k) for k, _ in held) > 1_000_000:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        keys, owners = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (mixed(keys ^ _U(0x77AA55)) % _U(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, owners = keys[order], owners[order]
        cuts = np.searchsorted(bucket[order], np.arange(n + 1))
        full = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([planes(keys[cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
             pa.array([planes(owners[cuts[b]:cuts[b + 1]]) for b in full], pa.binary())], ["bucket", "keys", "owners"])

    def meet(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([from_planes(x.as_py(), _U) for x in column(rows, "keys")])
        owners = np.concatenate([from_planes(x.as_py(), np.int64) for x in column(rows, "owners")])
        order = np.argsort(keys)
        keys, owners = keys[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        many = np.repeat(np.diff(np.append(first, len(keys))), np.diff(np.append(first, len(keys))))
        some = many > 1
        return pa.table({"key": keys[some].view(np.int64), "doc_id": owners[some], "many": many[some]})

    sent = docs.mapInArrow(emit, "bucket int, keys binary, owners binary")
    return sent.groupBy("bucket").applyInArrow(meet, "key long, doc_id long, many long")


def _candidates(rows: pa.Table, rule: Rule, every: bool) -> pa.Table:
    """Links of the buckets in a group: a forest over the sets that may be similar, or (every) all that may join two classes."""
    names = ["key", "low", "high", "doc_id"]
    key, low, high, ids = (column(rows, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)
    n = column(rows, "n").to_numpy(zero_copy_only=False).astype(np.int64)
    group = column(rows, "component").to_numpy(zero_copy_only=False).astype(np.int64)
    parity = np.frombuffer(b"".join(column(rows, "parity").to_pylist()), _U).reshape(len(ids), -1)
    order = np.lexsort((ids, high, low, key))
    key, low, high, ids, n, group, parity = (x[order] for x in (key, low, high, ids, n, group, parity))
    changed = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    edges = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(ids)]])

    def similar(x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(parity[x] ^ parity[y]).sum(-1, dtype=np.int64)
        near = (rule.den + rule.num) * differ <= (rule.den - rule.num) * (n[x] + n[y])
        return near & (rule.num * np.maximum(n[x], n[y]) <= rule.den * np.minimum(n[x], n[y])) & (ids[x] != ids[y])

    size = np.diff(edges)
    two = edges[:-1][size == 2]
    two = two[similar(two, two + 1) & ((group[two] != group[two + 1]) | (not every))]
    found = [(two, two + 1)]
    for a, b in zip(edges[:-1][size > 2], edges[1:][size > 2], strict=True):
        rest = np.arange(a, b)
        if every:
            for x in range(a, b - 1):
                later = np.arange(x + 1, b)
                later = later[group[later] != group[x]]
                later = later[similar(x, later)]
                found.append((np.full(len(later), x), later))
            continue
        while len(rest) > 1:
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                x = queue.pop(0)
                near = similar(x, rest)
                if near.any():
                    found.append((np.full(int(near.sum()), x), rest[near]))
                    queue += rest[near].tolist()
                    rest = rest[~near]
    x, y = (np.concatenate(z).astype(np.int64) for z in zip(*found, strict=True))
    return pa.table({"key": key[x], "low": low[x], "high": high[x], "u": ids[x], "v": ids[y]})


def difference(left: bytes, right: bytes) -> int:
    """A lower bound of the difference of two sets, from their profiles; the longer one is folded to the size of the other."""
    x, y = sorted((np.frombuffer(p, np.uint64) for p in (left, right)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def judged(pairs: DataFrame, info: DataFrame, rule: Rule) -> DataFrame:
    """The distinct pairs (u, v) with `near`: may any of their texts be linked, by the profiles?"""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (column(batch, c).to_numpy() for c in ("m", "n"))
            differ = [difference(x, y) for x, y in zip(column(batch, "left").to_pylist(), column(batch, "right").to_pylist(), strict=True)]
            near = (rule.den + rule.num) * np.array(differ, np.int64) <= (rule.den - rule.num) * (m + n)
            yield pa.RecordBatch.from_arrays([column(batch, "u"), column(batch, "v"), pa.array(near)], ["u", "v", "near"])

    left = info.select(F.col("doc_id").alias("u"), F.col("n").alias("m"), F.col("profile").alias("left"))
    right = info.select(F.col("doc_id").alias("v"), "n", F.col("profile").alias("right"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "m", "n", "left", "right")
    return both.mapInArrow(run, "u long, v long, near boolean").groupBy("u", "v").agg(F.max("near").alias("near"))


def verified(docs: DataFrame, pairs: DataFrame, info: DataFrame, rule: Rule, steps: Steps) -> DataFrame:
    """The distinct pairs (u, v) with `linked`, settled: overlaps of the near ones are counted in each fragment and summed per pair."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _slices(batches, rule):
            place = (sets.hashes >> _U(61)).astype(np.int64) + sets.row * PARTS
            inner = np.searchsorted(place, np.arange(len(ids) * PARTS + 1)).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(inner), pa.array(sets.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * PARTS), values)], ["doc_id", "parts"])

    told = steps.settle(judged(pairs, info, rule), "judged")
    near = told.where("near").select("u", "v")
    wanted = near.select(F.col("u").alias("doc_id")).union(near.select("v")).distinct()
    sets = steps.settle(docs.join(wanted, "doc_id", "left_semi").mapInArrow(parts, "doc_id long, parts array<array<long>>"), "sets")
    left = sets.select(F.col("doc_id").alias("u"), F.col("parts").alias("left"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("parts").alias("right"))
    total = lambda array: F.aggregate(array, F.lit(0), lambda s, x: s + x)
    shared = total(F.zip_with("left", "right", lambda a, b: F.size(F.array_intersect(a, b))))
    both = total(F.transform(F.concat("left", "right"), lambda a: F.size(a)))
    joined = near.join(left, "u").join(right, "v").select("u", "v", shared.alias("shared"), both.alias("both"))
    linked = F.max(rule.den * F.col("shared") >= rule.num * (F.col("both") - F.col("shared")))
    refuted = told.where("NOT near").select("u", "v", F.lit(False).alias("linked"))
    found = steps.settle(joined.groupBy("u", "v").agg(linked.alias("linked")).union(refuted), "checked")
    steps.drop(told, sets)
    return found


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    docs, steps = own_columns(docs, "doc_id", "text"), Steps(docs.sparkSession)
    info = steps.settle(described(docs, rule), "sets")
    same = info.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "a", "b").agg(F.min("doc_id").alias("doc_id"), F.min("parity").alias("parity"))
    same = steps.settle(same, "classes")
    shared = shared_fragments(docs, rule).join(same.select("doc_id", "n", "parity"), "doc_id")
    blocks = F.ceil(F.col("many") / BLOCK)
    own = F.pmod(F.xxhash64("doc_id"), blocks)
    spread = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    spread = spread.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id", "n", "parity")
    spread = steps.settle(spread.distinct(), "buckets")
    n = max(512, 4 * scan_tasks(spread))
    candidates = steps.settle(_grouped(spread.withColumn("component", F.col("doc_id")), rule, False, n), "candidates")
    checked = verified(docs, candidates.select("u", "v").distinct(), info, rule, steps)
    found = settle(components(checked.where("linked").select("u", "v")), "found")
    again = candidates.join(checked.where("NOT linked"), ["u", "v"]).select("key", "low", "high").distinct()
    rest = spread.join(again, ["key", "low", "high"], "left_semi").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    rest = rest.withColumn("component", F.coalesce("component", "doc_id"))
    more = steps.settle(_grouped(rest, rule, True, n).select("u", "v").distinct().join(checked, ["u", "v"], "left_anti"), "more")
    steps.drop(spread, candidates, checked)
    if not more.isEmpty():
        links = verified(docs, more, info, rule, steps)
        found = settle(components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).union(links.where("linked").select("u", "v"))), "found")
        steps.drop(links)
    steps.drop(more)
    named = same.select("n", "a", "b", "doc_id").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    named = named.select("n", "a", "b", F.coalesce("component", "doc_id").alias("component"))
    placed = info.select("doc_id", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _grouped(spread: DataFrame, rule: Rule, every: bool, n: int) -> DataFrame:
    """The candidates of buckets dealt to n groups. n is told: to count the partitions of joined rows would make the join."""
    grouped = spread.withColumn("bucket", F.pmod(F.xxhash64("key", "low", "high"), F.lit(n))).groupBy("bucket")
    return grouped.applyInArrow(lambda rows: _candidates(rows, rule, every), "key long, low long, high long, u long, v long")
