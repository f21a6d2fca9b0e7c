"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Components are floored to integers (x = floor(64 c) + 1000000), so equal vectors can be told exactly. The fit list holds
each distinct x once; Spark forms it, its sums and its scatter, centred before multiplying, from partial sums of every
task. Only what depends on the dimension alone, sums and components, reaches the driver; the scatter is factored in
one task. With S = L L' the rotations that make the columns of L orthogonal leave their squared norms as eigenvalues of S
and their directions as its eigenvectors, without forming S again.

Vectors of different lengths are whitened apart, each length with a fit of its own; lengths are fitted together as long as
their scatter matrices take FIT_BYTES. Rows whose vector is null or empty, or holds a null or non-finite entry or one beyond
2**40 are left out; rows without vec_id and repeated rows are kept as they are. A direction without variance is no component: equal
vectors alone, or a single one, give no rows. `deviation` is null where it does not fit in a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.tables import column, own_columns
from cellwright.llm.vectors import matrices, stepped
from cellwright.session import settle

SCALE, SHIFT = 64, 1_000_000
MOST = 16
LIMIT = float(SCALE << 40)
FIT_BYTES = 64 << 20
SWEEPS = 60
_EPS = np.finfo(np.float64).eps


class Model(NamedTuple):
    """The fit of one length: n vectors, their sums, and unit components with their eigenvalues and shares of the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    components: np.ndarray
    error: float = 0.0


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """L with scatter = L L', lower triangular in the order of the pivots; a column for each pivot above rounding."""
    size = len(scatter)
    left = scatter.diagonal().astype(np.float64).copy()
    least = size * _EPS * max(left.max(initial=0.0), 0.0)
    factor, free = np.zeros((size, size)), np.ones(size, bool)
    for k in range(size):
        pivot = int(np.argmax(np.where(free, left, -np.inf)))
        if not left[pivot] > least:
            return factor[:, :k]
        root = np.sqrt(left[pivot])
        free[pivot] = False
        factor[free, k] = (scatter[free, pivot] - factor[free, :k] @ factor[pivot, :k]) / root
        factor[pivot, k] = root
        left -= factor[:, k] ** 2
    return factor


def _rounds(count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of `count` columns once, in rounds of pairs without a common column."""
    ring = list(range(count + count % 2))
    half, out = len(ring) // 2, []
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[:half - 1:-1], strict=True) if max(a, b) < count]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns rotated against each other until all are orthogonal."""
    turned, rounds = factor.copy(), _rounds(factor.shape[1])
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds:
            a, b = turned[:, p], turned[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            size = np.sqrt(aa * bb)
            slope = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            worst = max(worst, slope.max(initial=0.0))
            turn = slope > _EPS
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            tangent = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cosine = 1 / np.hypot(1.0, tangent)
            sine = cosine * tangent
            turned[:, p], turned[:, q] = cosine * a - sine * b, sine * a + cosine * b
        if worst <= 8 * _EPS:
            break
    return turned


def principal(scatter: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors as rows; the largest entry of each is positive."""
    turned = jacobi(pivoted_cholesky(scatter))
    norms = np.sqrt((turned * turned).sum(axis=0))
    order = np.argsort(-norms, kind="stable")[:most]
    vectors = (turned[:, order] / norms[order]).T
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.zeros(0)
    return norms[order] ** 2, vectors * sign[:, None]


def _centred(x: np.ndarray, model: Model) -> np.ndarray:
    """x - S / n, from the exact n x - S where that fits."""
    if model.n * float(np.abs(x).max(initial=0)) < 2.0 ** 62:
        return (x * model.n - model.sums) / model.n
    return np.array([[float(v * model.n - s) / model.n for v, s in zip(r, model.sums.tolist(), strict=True)] for r in x.tolist()])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """The exact sum of (n x - S)**2 of each row; None beyond a long."""
    reach = n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))
    if reach < 2.0 ** 62:
        apart = x * n - sums
        if len(sums) * float(np.abs(apart).max(initial=0)) ** 2 < 2.0 ** 62:
            return (apart * apart).sum(axis=1).tolist()
    exact = [sum((v * n - s) ** 2 for v, s in zip(r, sums.tolist(), strict=True)) for r in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def _cells(vectors: DataFrame) -> DataFrame:
    """vec_id, the length and the integer components of each usable row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "vec_id")
            for size, at, rows in matrices(column(batch, "embedding")):
                fits, x = stepped(rows, SCALE, LIMIT)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at[fits])), pa.array(np.full(len(x), size), pa.int32()), pa.array([r.tobytes() for r in x + SHIFT], pa.binary())],
                    ["vec_id", "size", "x"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, size int, x binary")


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = column(batch, "size").to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        held = column(batch, "x").take(pa.array(at)).to_pylist()
        yield size, at, np.frombuffer(b"".join(held), np.int64).reshape(len(at), size)


def _summed(cells: DataFrame, parts: Callable[[int, np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """size, place and total of what `parts` makes of all rows of a size: summed in each task, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _by_size(batch):
                part = parts(size, x)
                held[size] = held[size] + part if size in held else part
        for size, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), size), pa.int32()), pa.array(np.arange(len(total)), pa.int32()), pa.array(total)],
                                             ["size", "place", "part"])

    return cells.mapInArrow(run, f"size int, place int, part {kind}").groupBy("size", "place").agg(F.sum("part").alias("total"))


def _collected(totals: DataFrame) -> dict[int, np.ndarray]:
    """For totals whose number follows the length of a vector, not the rows."""
    rows = totals.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("t")).select("size", "t.total").collect()
    return {r["size"]: np.array(r["total"]) for r in rows}


def fit(cells: DataFrame, sizes: list[int], most: int = MOST) -> dict[int, Model]:
    """The models of some lengths over the distinct vectors `cells` (size, x)."""
    own = cells.where(F.col("size").isin(sizes))
    sums = _collected(_summed(own, lambda _, x: np.concatenate([[len(x)], x.sum(axis=0)]), "long"))
    models = {s: Model(int(t[0]), t[1:].astype(np.int64), np.zeros(0), np.zeros(0), np.zeros((0, s))) for s, t in sums.items()}
    sent = models

    def scatter(size: int, x: np.ndarray) -> np.ndarray:
        apart = _centred(x, sent[size])
        return (apart.T @ apart)[np.triu_indices(size)]

    def factor(rows: pa.Table) -> pa.Table:
        size, place = column(rows, "size")[0].as_py(), column(rows, "place").to_numpy()
        whole, upper = np.zeros((size, size)), np.triu_indices(size)
        whole[upper[0][place], upper[1][place]] = column(rows, "total").to_numpy()
        whole = np.triu(whole) + np.triu(whole, 1).T
        values, vectors = principal(whole, most)
        shares = values / whole.trace() if len(values) else values
        return pa.table({"size": pa.array([size], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("v", values), ("s", shares), ("c", vectors))}})

    found = _summed(own, scatter, "double").groupBy("size").applyInArrow(factor, "size int, v binary, s binary, c binary").collect()
    for r in found:
        n, values = models[r["size"]].n, np.frombuffer(r["v"])
        models[r["size"]] = models[r["size"]]._replace(values=values / n, shares=np.frombuffer(r["s"]), components=np.frombuffer(r["c"]).reshape(-1, r["size"]))
    means = {s: t / models[s].n for s, t in _collected(_summed(own, lambda s, x: _whitened(x, models[s]).sum(axis=0), "double")).items()}

    def spread(size: int, x: np.ndarray) -> np.ndarray:
        apart = _whitened(x, models[size]) - means[size]
        return (apart.T @ apart).ravel()

    for size, total in _collected(_summed(own.where(F.col("size").isin(list(means))), spread, "double")).items():
        k = len(models[size].values)
        models[size] = models[size]._replace(error=float(np.abs(total.reshape(k, k) / models[size].n - np.eye(k)).max()))
    return models


def _whitened(x: np.ndarray, model: Model) -> np.ndarray:
    return _centred(x, model) @ model.components.T / np.sqrt(model.values)


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _projected(cells: DataFrame, models: dict[int, Model]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "vec_id")
            for size, at, x in _by_size(batch):
                m = models[size]
                k = len(m.values)
                if not k:
                    continue
                apart = np.repeat(np.array(deviations(x, m.n, m.sums), object), k)
                out = [ids.take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(k * len(x), m.n)),
                       pa.array(apart, pa.int64()), pa.array(_whitened(x, m).ravel()), pa.array(np.tile(m.shares, len(x))), pa.array(np.full(k * len(x), m.error))]
                yield pa.RecordBatch.from_arrays(out, ["vec_id", *[c.split()[0] for c in OUT.split(", ")]])

    return cells.where(F.col("size").isin(list(models))).mapInArrow(run, f"vec_id {cells.schema['vec_id'].dataType.simpleString()}, {OUT}")


def whiten(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    cells = _cells(own_columns(vectors, "vec_id", "embedding"))
    distinct = settle(cells.select("size", "x").distinct(), "distinct")
    batches: list[list[int]] = []
    room = 0
    for size in sorted(r["size"] for r in distinct.select("size").distinct().collect()):
        if room < 8 * size * size:
            batches, room = [*batches, []], FIT_BYTES
        batches[-1].append(size)
        room -= 8 * size * size
    out = [_projected(cells, fit(distinct, sizes, most)) for sizes in batches]
    empty = vectors.sparkSession.createDataFrame([], f"vec_id {cells.schema['vec_id'].dataType.simpleString()}, {OUT}")
    for part in out:
        empty = empty.union(part) if len(out) > 1 else part
    return empty
