"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the vectors.

A rotation of the leading principal directions is learned, on a sample of at most SAMPLE vectors in one task, so
that the signs of the rotated coordinates make balanced binary codes of BITS bits. Codes are cut into chunks; two vectors
are compared if a chunk of theirs differs in at most one bit and their codes are near. How wide chunks are, how many codes a vector gets, and
how near codes must be is measured on the sample: its vectors are moved by just the angle of the threshold, in random directions and
in directions in which the vectors themselves differ, and of PLANS, cheapest first, the first is taken that finds MEASURED of those pairs. A mean that
all vectors share makes raw angles wide ones after it is taken off, and calls for more tables. The answers themselves are exact
cosines in double precision.

Equal vectors are one vector with a count. A probe first asks the tables, with codes alone and without making pairs,
whether anything near is there; only then do vectors travel, to blocks of at most about BLOCK entries and probes, which
answer with link counts and a forest of links, never with all pairs. A pair is counted in the first table that finds it.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of each length are compared among
themselves, with a model of their own. Rows with the same vec_id count as several vectors; a missing vec_id is its own component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.components import components
from cellwright.llm.tables import column, own_columns, scan_tasks
from cellwright.llm.vectors import matrices
from cellwright.session import settle

SAMPLE = 20_000
BITS = 64
ROUNDS = 50
LEAST = 0.95
BLOCK = 1024
#: Bits of a chunk, and codes of a vector, in the order of the work they make.
PLANS = ((16, 1), (16, 2), (16, 4), (16, 8), (8, 1), (8, 2), (8, 4), (8, 8))
MEASURED = 0.97
MOVED = 4000


class Model(NamedTuple):
    """One projection per code, the width of a chunk, and the largest distance of codes that are compared."""

    mean: np.ndarray
    projections: tuple[np.ndarray, ...]
    width: int
    near: int

    @property
    def tables(self) -> int:
        return len(self.projections) * (BITS // self.width)


def usable(lists: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and vectors, in double precision, of the usable vectors of each length, or of one."""
    for size, at, rows in matrices(lists):
        if length is None or size == length:
            some = rows.any(axis=1)
            yield at[some], rows[some]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True) if len(rows) else rows
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def learn(rows: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection: principal directions, then the rotation nearest to its own signs."""
    mean = rows.mean(axis=0)
    centred = rows - mean
    _, _, directions = np.linalg.svd(centred.T @ centred)
    directions = directions[:bits].T
    short = bits - directions.shape[1]
    if short > 0:  # fewer directions than bits: the rest are random mixtures of them
        directions = np.hstack([directions, directions @ np.random.default_rng(seed).normal(size=(directions.shape[1], short))])
    projected = centred @ directions
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        rotation = (left @ right).T
    return mean, directions @ rotation


def codes(rows: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = (rows - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.int64) if len(rows) else np.zeros(0, np.int64)


def moved(units: np.ndarray, least: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and others at cosine `least` from them: half in random directions, half along differences of the vectors."""
    rng = np.random.default_rng(seed)
    here = units[rng.integers(0, len(units), MOVED)]
    away = rng.normal(size=here.shape)
    half = MOVED // 2
    away[:half] = units[rng.integers(0, len(units), half)] - units[rng.integers(0, len(units), half)]
    away -= (away * here).sum(axis=1, keepdims=True) * here
    size = np.linalg.norm(away, axis=1, keepdims=True)
    sound = size[:, 0] > 1e-9
    return here[sound], least * here[sound] + np.sqrt(1 - least * least) * away[sound] / size[sound]


def found(left: list[np.ndarray], right: list[np.ndarray], width: int, near: int) -> np.ndarray:
    """Which pairs of codes, one list per code, meet in a table."""
    hit = np.zeros(len(left[0]), bool)
    mask = np.uint64((1 << width) - 1)
    for a, b in zip(left, right, strict=True):
        differ = (a ^ b).view(np.uint64)
        close = np.bitwise_count(differ) <= near
        for t in range(BITS // width):
            hit |= close & (np.bitwise_count((differ >> np.uint64(t * width)) & mask) <= 1)
    return hit


def measure(units: np.ndarray, least: float = LEAST) -> Model:
    """The cheapest plan that finds MEASURED of the pairs at the threshold, each kind of them; else the last."""
    here, there = moved(units, least)
    mean, projections, near = np.zeros(0), [], 0
    for width, many in PLANS:
        while len(projections) < many:
            mean, projection = learn(units, seed=7 + len(projections))
            projections.append(projection)
        pairs = [(codes(here, mean, p), codes(there, mean, p)) for p in projections[:many]]
        left, right = [a for a, _ in pairs], [b for _, b in pairs]
        near = int(np.quantile(np.concatenate([np.bitwise_count((a ^ b).view(np.uint64)) for a, b in pairs]), 0.9999, method="higher")) if len(here) else BITS
        hit = found(left, right, width, near)
        half = len(hit) // 2
        if not len(hit) or min(hit[:half].mean() if half else 1.0, hit[half:].mean()) >= MEASURED:
            break
    return Model(mean, tuple(projections[:many]), width, near)


def fit(vectors: DataFrame, length: int, sample: int = SAMPLE, least: float = LEAST) -> Model | None:
    """The model from the vectors of a length whose ids come first by hash."""
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)

    def train(rows: pa.Table) -> pa.Table:
        own = [x for _, x in usable(column(rows, "embedding"), length) if len(x)]
        if not own:
            return pa.table({"mean": pa.array([b""], pa.binary()), "projections": pa.array([[]], pa.list_(pa.binary())), "width": pa.array([0], pa.int32()), "near": pa.array([0], pa.int32())})
        model = measure(unit(own[0]), least)
        return pa.table({"mean": pa.array([model.mean.tobytes()], pa.binary()), "projections": pa.array([[p.tobytes() for p in model.projections]], pa.list_(pa.binary())),
                         "width": pa.array([model.width], pa.int32()), "near": pa.array([model.near], pa.int32())})

    r = drawn.groupBy(F.lit(0).alias("all")).applyInArrow(train, "mean binary, projections array<binary>, width int, near int").first()
    if r is None or not r["projections"]:
        return None
    return Model(np.frombuffer(r["mean"]), tuple(np.frombuffer(p).reshape(length, BITS) for p in r["projections"]), r["width"], r["near"])


def _coded(vectors: DataFrame, model: Model) -> DataFrame:
    """vec_id, a digest of the vector, its codes and its unit form; null digest where it links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest: list = [None] * batch.num_rows
            code, packed = [None] * batch.num_rows, [None] * batch.num_rows
            for at, rows in usable(column(batch, "embedding"), len(model.mean)):
                units = unit(rows)
                many = np.stack([codes(units, model.mean, p) for p in model.projections], axis=1).tolist() if len(rows) else []
                for k, c, r, u in zip(at.tolist(), many, rows, units, strict=True):
                    digest[k], code[k], packed[k] = hashlib.blake2b(r.tobytes(), digest_size=16).digest(), c, u.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(digest, pa.binary()), pa.array(code, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                                             ["vec_id", "digest", "codes", "unit"])

    return vectors.mapInArrow(run, "vec_id long, digest binary, codes array<long>, unit binary")


def _entries(classes: DataFrame, model: Model, flips: bool) -> DataFrame:
    """One row for each chunk of a code or, for probes, for each chunk with at most one bit flipped."""
    masks = [0, *(1 << b for b in range(model.width))] if flips else [0]
    places, per = [], BITS // model.width
    for t in range(model.tables):
        code = F.get("codes", F.lit(t // per))
        chunk = F.shiftrightunsigned(code, t % per * model.width).bitwiseAND(F.lit((1 << model.width) - 1))
        places += [F.struct(F.lit(t).alias("table"), chunk.bitwiseXOR(F.lit(m)).alias("value"), code.alias("code")) for m in masks]
    return classes.select("id", F.explode(F.array(*places)).alias("p")).select("id", "p.code", "p.table", "p.value")


def _near(left: DataFrame, right: DataFrame, near: int) -> DataFrame:
    """The rows of `left` with another vector near by in the same place of a table."""
    other = right.select(F.col("id").alias("other"), F.col("code").alias("other_code"), F.col("table").alias("t"), F.col("value").alias("v"))
    close = F.bit_count(F.col("code").bitwiseXOR(F.col("other_code"))) <= near
    return left.join(other, (F.col("table") == F.col("t")) & (F.col("value") == F.col("v")) & (F.col("id") != F.col("other")) & close, "left_semi")


def _links(rows: pa.Table, least: float, model: Model) -> pa.Table:
    """Link counts of the probes, and a forest of links, for each block in a group."""
    names = ["table", "value", "left", "right", "probe", "id", "many"]
    table, value, left, right, probe, ids, many = (column(rows, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)
    code = column(rows, "codes").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), -1)
    units = np.frombuffer(b"".join(column(rows, "unit").to_pylist()), np.float64).reshape(len(ids), -1)
    order = np.lexsort((ids, probe, right, left, value, table))
    keys = np.stack([table, value, left, right])[:, order]
    edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(ids)]])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    mask, per = np.uint64((1 << model.width) - 1), BITS // model.width
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        p, e = own[probe[own] == 1], own[probe[own] == 0]
        if not len(p) or not len(e):
            continue
        linked = (units[p] @ units[e].T >= least) & (ids[p][:, None] != ids[e][None, :])
        if not linked.any():
            continue
        here = int(table[own[0]])
        for r in range(here // per + 1):
            differ = (code[p, r][:, None] ^ code[e, r][None, :]).view(np.uint64)
            close = np.bitwise_count(differ) <= model.near
            if r == here // per:
                linked &= close
            for t in range(r * per, min(here, (r + 1) * per)):  # an earlier table has found the pair
                linked &= ~(close & (np.bitwise_count((differ >> np.uint64(t % per * model.width)) & mask) <= 1))
        counts = linked @ many[e]
        some = np.flatnonzero(counts)
        out.append((ids[p[some]], np.full(len(some), -1), counts[some]))
        out.append(_forest(ids[p], ids[e], linked))
    u, v, n = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
    return pa.table({"u": u, "v": pa.array(v, mask=v < 0), "links": n})


def _forest(p: np.ndarray, e: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a two-sided graph that keep its components."""
    free_p, free_e, found = linked.any(axis=1), linked.any(axis=0), []
    for start in np.flatnonzero(free_p):
        if not free_p[start]:
            continue
        free_p[start], queue = False, [(True, int(start))]
        while queue:
            is_p, x = queue.pop()
            near = np.flatnonzero(linked[x] & free_e) if is_p else np.flatnonzero(linked[:, x] & free_p)
            (free_e if is_p else free_p)[near] = False
            found += [(p[x], e[y]) if is_p else (p[y], e[x]) for y in near.tolist()]
            queue += [(not is_p, y) for y in near.tolist()]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)


def near_duplicates(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    vectors = own_columns(vectors, "vec_id", "embedding")
    length = F.coalesce(F.size("embedding"), F.lit(0))
    lengths = sorted(r["n"] for r in vectors.select(length.alias("n")).distinct().collect() if r["n"] > 0)  # as a rule one
    parts = [_of_length(vectors.where(length == n), n, least, sample) for n in lengths]
    return reduce(DataFrame.union, parts, _alone(vectors.where(length <= 0)))


def _alone(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))


def _of_length(vectors: DataFrame, length: int, least: float, sample: int) -> DataFrame:
    model = fit(vectors, length, sample, least)
    if model is None:
        return _alone(vectors)
    coded = settle(_coded(vectors, model), "codes")
    sound = coded.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = settle(sound.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"), F.min("codes").alias("codes"), F.min("unit").alias("unit")), "classes")
    probes, entries = _entries(classes, model, True), _entries(classes, model, False)
    rows = _near(probes, entries, model.near).withColumn("probe", F.lit(1)).unionByName(_near(entries, probes, model.near).withColumn("probe", F.lit(0)))
    rows = settle(rows, "near")
    sizes = rows.groupBy("table", "value").agg(F.count(F.when(F.col("probe") == 1, 1)).alias("p"), F.count(F.when(F.col("probe") == 0, 1)).alias("e"))
    sizes = sizes.select("table", "value", F.ceil(F.col("p") / BLOCK).alias("ps"), F.ceil(F.col("e") / BLOCK).alias("es")).where("ps > 0 AND es > 0")
    rows = rows.join(sizes, ["table", "value"])
    is_probe = F.col("probe") == 1
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(is_probe, F.col("ps")).otherwise(F.col("es"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_probe, F.col("es")).otherwise(F.col("ps")) - 1)))
    rows = rows.withColumn("left", F.when(is_probe, F.col("own")).otherwise(F.col("other"))).withColumn("right", F.when(is_probe, F.col("other")).otherwise(F.col("own")))
    rows = rows.select("table", "value", "left", "right", "probe", "id").join(classes.select("id", "codes", "many", "unit"), "id")
    groups = max(256, 4 * scan_tasks(vectors))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("table", "value", "left", "right"), F.lit(groups)))
    found = settle(rows.groupBy("bucket").applyInArrow(lambda r: _links(r, least, model), "u long, v long, links long"), "links")
    counts = found.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(found.where("v IS NOT NULL").select("u", "v"))
    named = classes.select("digest", "id", "many").join(counts, "id", "left").join(joined, "id", "left")
    named = named.select("digest", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    placed = coded.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    placed = placed.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
