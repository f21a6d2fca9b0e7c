"""Hard negatives and whitening against brute force on vectors with awkward rows."""

from __future__ import annotations

import math
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright import session
from cellwright.llm import bond, itq, vectors, whitening

SCHEMA = "vec_id long, label long, embedding array<double>"


def _rows(seed: int, count: int, size: int, mean: float = 0.0, scale: float = 0.3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    held = rng.normal(mean, scale, (count, size))
    held[3], held[4], held[count // 2] = held[0], held[1], held[0]  # equal vectors: ties
    return [(k, int(rng.integers(4)) if k % 3 else 1, held[k].tolist()) for k in range(count)]


ODD = [(900, None, [0.5] * 6), (901, 1, None), (902, 1, []), (903, 2, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, 2, [math.nan] * 6),
       (905, 1, [math.inf] + [0.0] * 5), (None, 1, [0.4] * 6), (906, 1, [1e30] * 6), (907, 1, [0.2, 0.3]), (908, 2, [0.1, 0.2]), (909, 1, [0.3, 0.3]), (910, 7, [0.0] * 6)]


def frame(spark, rows, schema=SCHEMA):
    out = spark.createDataFrame(rows, schema)
    for name in ("size", "x", "block", "part", "slot", "rank", "n", "anchor", "id"):
        out = out.withColumn(name, F.lit("x"))
    return out.repartition(3)


def usable(rows, limit):
    held = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = tuple(math.floor(256 * c) for c in v)
        if max(map(abs, x)) <= limit:
            key = (i, len(x))
            held[key] = min(held.get(key, (label, x)), (label, x))
    return [(i, label, x) for (i, _), (label, x) in held.items()]


def brute_negatives(rows, every, positives=5, negatives=3):
    held, out = usable(rows, 1 << 26), set()
    for a, label, x in held:
        if a % every:
            continue
        others = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, m) for i, m, y in held if i != a and len(y) == len(x)]
        for ps, p, _ in sorted(o for o in others if o[2] == label)[:positives]:
            near = sorted((s, i) for s, i, m in others if m != label and 50 * -ps <= 100 * -s <= 95 * -ps)
            out |= {(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(near[:negatives])}
    return out


@pytest.mark.parametrize("seed, mean, scale, block, per", [(1, 0.0, 0.3, 40, 7), (2, 0.4, 0.2, 64, 100), (3, 0.0, 4e4, 30, 5), (4, -0.2, 0.05, 4096, 2048)])
def test_negatives_equal_brute_force(spark, seed, mean, scale, block, per):
    rows = _rows(seed, 200, 6, mean, scale) + ODD + _rows(seed + 9, 30, 3) + _rows(seed, 5, 6, mean, scale)  # lengths, repeated rows, repeated ids
    got = bond.mine(frame(spark, rows), F.col("vec_id") % 4 == 0, block=block, per=per).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_negatives(rows, 4)


def test_no_rows_no_anchors_and_lone_labels(spark):
    assert bond.mine(frame(spark, []), F.col("vec_id") % 4 == 0).collect() == []
    assert bond.mine(frame(spark, _rows(1, 20, 3)), F.col("vec_id") < 0).collect() == []
    assert bond.mine(frame(spark, [(k, k, [1.0, 1.0]) for k in range(9)]), F.col("vec_id") % 4 == 0).collect() == []


def test_the_scan_drops_candidates_early_and_loses_none():
    rng = np.random.default_rng(0)
    # magnitudes that fall by dimension, as after a rotation to principal directions: most rows leave in the first steps
    x = np.floor(rng.normal(0, 200, (500, 64)) / np.arange(1, 65) ** 1.5)
    block = bond.Block(np.arange(500), np.zeros(500, int), np.ascontiguousarray(x.T), x.min(axis=0), x.max(axis=0))
    full = x @ x[7]
    alive = np.ones(500, bool)
    at, score = bond.scan(block, x[7], alive, np.array([-np.inf]), np.array([np.inf]), 5)
    assert (score == full[at]).all() and set(np.argsort(-full, kind="stable")[:5]) <= set(at.tolist()) and len(at) < 25
    low, high = np.quantile(full, [0.6, 0.9])
    at, score = bond.scan(block, x[7], alive, np.array([low]), np.array([high]), 3)
    inside = np.flatnonzero((full >= low) & (full <= high))
    assert (score == full[at]).all() and set(inside[np.argsort(-full[inside], kind="stable")[:3]]) <= set(at.tolist()) and len(at) < len(inside)


def test_each_block_is_sent_to_one_task_whatever_the_number_of_anchors(spark, tmp_path, monkeypatch):
    """Blocks were sent once for each part of the anchors: with more rows there are more of both, and their product was moved."""
    moved, real = [], bond._scanned

    def watched(blocks, anchors, *rest):
        found = real(blocks, anchors, *rest)
        moved.append((blocks.count(), found._jdf.queryExecution().optimizedPlan().toString()))
        return found

    folder = str(tmp_path / "kept")
    monkeypatch.setattr(bond, "_scanned", watched)
    monkeypatch.setattr(session, "shared_folder", lambda _: folder)
    rows = _rows(6, 300, 5)
    got = bond.mine(frame(spark, rows), F.col("vec_id") % 4 == 0, block=30, per=5).collect()
    assert {tuple(r) for r in got} == brute_negatives(rows, 4)
    assert len(moved) == 2 and all(blocks > 5 and "Join" not in plan and plan.count("explode") == 1 for blocks, plan in moved)
    assert {x.rpartition("-")[0] for x in os.listdir(folder)} <= {"blocks", "positives", "sought"}


@pytest.mark.parametrize("early", [False, True])
def test_many_scans_at_once_equal_full_products(early):
    rng = np.random.default_rng(2)
    for fall in (0.0, 1.5):  # vectors without structure, and such whose dimensions fall off
        x = np.floor(rng.normal(0, 60, (300, 32)) / np.arange(1, 33) ** fall).astype(np.float32)
        block = bond.Block(np.arange(300), np.zeros(300, int), np.ascontiguousarray(x.T), x.min(axis=0), x.max(axis=0))
        queries = x[:40]
        full = queries.astype(np.int64) @ x.T.astype(np.int64)
        alive = rng.random(full.shape) < 0.8
        lows, highs = (np.quantile(full, q, axis=1).round().astype(np.float32) for q in (0.9, 0.99))
        wanted = alive & (full >= lows[:, None]) & (full <= highs[:, None])
        own, at, score, _ = bond.scan_many(block, x, queries, alive.copy(), lows, highs, early)
        assert sorted(zip(own.tolist(), at.tolist(), strict=True)) == list(map(tuple, np.argwhere(wanted).tolist()))
        assert (score == full[own, at]).all()


def test_the_best_rows_of_windows_over_several_blocks():
    rng = np.random.default_rng(4)
    lows, highs = np.array([-(1 << 63), 3, 5]), np.array([(1 << 63) - 1, 9, 4])
    best, told = bond.Best(lows, highs, 3), []
    for _ in range(5):
        w, score = rng.integers(0, 2, 20), rng.integers(3, 9, 20)
        ids = rng.permutation(1000)[:20] + 1000 * len(told)
        best.add(w, score, ids)
        told += [*zip(w.tolist(), score.tolist(), ids.tolist(), strict=True)]
    for w in range(2):
        first = sorted((-s, i) for v, s, i in told if v == w)[:3]
        assert [(-s, i) for s, i in zip(best.score[w].tolist(), best.ids[w].tolist(), strict=True)] == first
        assert best.floors()[w] == -first[-1][0]
    assert best.held.tolist() == [3, 3, 0] and best.floors()[2] == 5


def brute_whitening(rows, most=16):
    held = defaultdict(list)
    for i, _, v in rows:
        if v and not any(c is None or not math.isfinite(c) for c in v) and max(map(abs, v)) <= 2.0 ** 40:
            held[len(v)].append((i, [math.floor(64 * c) + 1_000_000 for c in v]))
    out = {}
    for size, own in held.items():
        fit = np.array(sorted({tuple(x) for _, x in own}))
        n, sums = len(fit), fit.sum(axis=0)
        centred = (fit * n - sums) / n
        values, directions = np.linalg.eigh(centred.T @ centred / n)
        order = np.argsort(-values)[:most]
        out[size] = own, n, sums, values[order], directions[:, order], values.sum()
    return out


def test_whitening_equals_the_eigenvectors(spark):
    rows = _rows(5, 300, 20, 0.5, 0.7) + _rows(6, 40, 3) + ODD[:7] + [(None, 1, [0.25] * 20), (906, 1, [1e30] * 20)] + _rows(5, 9, 20, 0.5, 0.7)
    got = whitening.whiten(frame(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["n"]].append(r)
    want = brute_whitening(rows)
    seen = 0
    for size in (20, 3):
        own, n, sums, values, directions, trace = want[size]
        mine, k = by[n], min(16, size)
        assert len(mine) == len(own) * k
        seen += len(mine)
        # rows with one id may differ, so rows are matched by their exact deviation beside the id
        told = defaultdict(dict)
        for r in mine:
            told[r["vec_id"], r["deviation"]][r["component"]] = r["whitened"]
            assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9) and r["identity_error"] < 1e-9
        centred = np.array([[(n * v - s) / n for v, s in zip(x, sums.tolist(), strict=True)] for _, x in own])
        flat = centred @ directions / np.sqrt(values)
        found = np.array([[told[i, sum((n * v - s) ** 2 for v, s in zip(x, sums.tolist(), strict=True))][c + 1] for c in range(k)] for i, x in own])
        assert np.abs(found * np.sign((found * flat).sum(axis=0)) - flat).max() < 1e-8
    assert seen + 4 * 2 >= len(got)  # lengths 2 and 6 have few vectors


def test_whitening_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5]), (3, 1, None)])).collect() == []
    line = whitening.whiten(frame(spark, [(k, 1, [0.5 * k, 1.0 * k, 2.0]) for k in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 5 and line[0]["explained"] == pytest.approx(1)


def test_factors_of_ill_conditioned_and_singular_scatters():
    rng = np.random.default_rng(3)
    for size, rank, spread in ((1, 1, 0), (2, 2, 0), (7, 7, 8), (40, 40, 10), (33, 12, 4)):
        basis, _ = np.linalg.qr(rng.normal(size=(size, size)))
        values = np.concatenate([10.0 ** -np.linspace(0, spread, rank), np.zeros(size - rank)])
        scatter = (basis * values) @ basis.T
        factor = whitening.pivoted_cholesky(scatter)
        assert factor.shape[1] >= rank and np.allclose(factor @ factor.T, scatter, atol=1e-13)
        found, vectors_ = whitening.principal(scatter, most=size)
        assert found[:rank] == pytest.approx(values[:rank], rel=1e-4)
        assert np.allclose(vectors_[:rank] @ vectors_[:rank].T, np.eye(rank), atol=1e-9)
    assert whitening.pivoted_cholesky(np.zeros((4, 4))).shape == (4, 0)


def test_deviations_are_exact_or_null():
    x = np.array([[1_000_003, 999_990], [1_000_001, 1_000_000]])
    for n, sums in ((2, x.sum(axis=0)), (3_000_000_000, x[0] * 3_000_000_000 - 7)):
        got = whitening.deviations(x, n, np.array(sums))
        want = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
        assert got == [w if w < 1 << 63 else None for w in want]


def test_lengths_are_fitted_in_several_passes(spark, monkeypatch):
    rows = _rows(5, 60, 4) + _rows(6, 50, 3)
    one = {(r["vec_id"], r["n"], r["component"]): r["whitened"] for r in whitening.whiten(frame(spark, rows)).collect()}
    monkeypatch.setattr(whitening, "FIT_BYTES", 8)
    several = {(r["vec_id"], r["n"], r["component"]): r["whitened"] for r in whitening.whiten(frame(spark, rows)).collect()}
    assert one.keys() == several.keys() and all(abs(one[k] - several[k]) < 1e-9 for k in one)


def test_matrices_of_sliced_batches():
    import pyarrow as pa

    lists = pa.array([[9.0], [1.0, 2.0], None, [], [3.0, None], [4.0, 5.0], [6.0]], pa.list_(pa.float32())).slice(1)
    assert {s: (at.tolist(), rows.tolist()) for s, at, rows in vectors.matrices(lists)} == {2: ([0, 4], [[1.0, 2.0], [4.0, 5.0]]), 1: ([5], [[6.0]])}


def _linked(vectors_: dict, least: float = 0.95) -> tuple[dict, dict]:
    """Links and components of brute force, vectors of each length apart."""
    links, component = {k: 0 for k in vectors_}, {k: k for k in vectors_}
    by = defaultdict(list)
    for k, v in vectors_.items():
        by[len(v)].append(k)
    for ids in by.values():
        units = itq.unit(np.array([vectors_[k] for k in ids]))
        near = units @ units.T >= least
        np.fill_diagonal(near, False)
        for a, row in zip(ids, near, strict=True):
            links[a] = int(row.sum())
        for start in sorted(ids):
            if component[start] != start:
                continue
            queue = [start]
            while queue:
                x = queue.pop()
                for y in np.flatnonzero(near[ids.index(x)]):
                    if component[ids[y]] > start:
                        component[ids[y]] = start
                        queue.append(ids[y])
    return links, component


@pytest.mark.parametrize("size, mean", [(32, 0.0), (64, 1.5), (128, 3.0)])
def test_links_are_found_whatever_the_common_mean(spark, size, mean):
    """Pairs at the very threshold, of vectors that share a mean of up to three standard deviations."""
    rng = np.random.default_rng(size)
    rows = rng.normal(mean, 1, (900, size))
    units = itq.unit(rows[:300])
    away = rng.normal(size=units.shape)
    away -= (away * units).sum(axis=1, keepdims=True) * units
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    held = np.concatenate([rows, (0.951 * units + np.sqrt(1 - 0.951**2) * away) * rng.uniform(0.5, 3, (300, 1))])
    want, component = _linked({k: v for k, v in enumerate(held.tolist())})
    got = {r["vec_id"]: r for r in itq.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(held)], "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(held) and sum(want.values()) >= 600
    assert all(got[k]["n_links"] <= want[k] for k in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(want.values())
    assert np.mean([got[k]["component_id"] == component[k] for k in want]) >= 0.95


def test_vectors_of_several_lengths_link_within_their_length(spark):
    rng = np.random.default_rng(1)
    held = {k: rng.normal(size=16).tolist() for k in range(40)} | {100: [1.0, 2.0], 101: [2.0, 4.0], 102: [-1.0, 0.0], 103: [5.0], 104: [0.0, 0.0]}
    held[41] = held[3]
    rows = [(k, v) for k, v in held.items()] + [(200, None), (201, []), (202, [1.0, None]), (None, [1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[100] == (1, 100, True) and got[101] == (1, 100, False) and got[102] == (0, 102, True) and got[103] == (0, 103, True)
    assert got[41] == (1, 3, False) and all(got[k] == (0, k, True) for k in (104, 200, 201, 202)) and got[None][:2] == (0, None) and len(got) == len(rows)


def test_the_plan_follows_the_angle():
    rng = np.random.default_rng(2)
    few = itq.measure(itq.unit(rng.normal(size=(2000, 48))))
    many = itq.measure(itq.unit(rng.normal(2.0, 1, size=(2000, 48))))
    assert (few.width, len(few.projections)) in itq.PLANS and itq.PLANS.index((few.width, len(few.projections))) < itq.PLANS.index((many.width, len(many.projections)))
