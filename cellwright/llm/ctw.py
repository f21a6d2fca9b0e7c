"""Language-model scores: context-tree weighting over bytes, and a word-count baseline.

Texts are lower-cased (A-Z) UTF-8 bytes with an end symbol. Each byte is coded bit by bit; in every context (the last
0 to DEPTH bytes, and the bits of the byte so far) a Krichevsky-Trofimov estimator predicts the next bit. The weight of a
context against the longer ones that refine it is that of context-tree weighting: half its own block probability, half
the product of theirs, over all training texts. Block probabilities need counts only, so the corpus is reduced to the
counts of its (DEPTH + 1)-byte runs, each task first adding up its own, and trees are weighted by their last two bytes; the two
levels above these have at most 65,535 contexts and bits, whatever the corpus.
A context that training has not seen is no node: its path ends at the deepest node seen.

Each distinct run of the corpus gets its log probability once, from all nodes on its path, beside the trees that hold them. Scoring is then a
lookup: the values of the most frequent runs, at most SENT of them, go to every task; for the others chunks of texts ask hash buckets,
as they do for the counts of the distinct words of the baseline, and meet the answers. No context is left out, whatever
the size of the corpus.

A null text is empty and has the end symbol only. Rows with equal ids are scored one by one; a missing id belongs to the
training texts if the rest of the crc32 of an empty text says so. `docs` must be a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.chunked import chunks, from_planes, packed, planes, unpacked
from cellwright.llm.tables import column, own_columns, scan_tasks
from cellwright.llm.words import lowered, mixed, slices, tokens, word_hashes
from cellwright.session import settle

DEPTH = 4
END_BYTE = 0xFF  # never part of UTF-8
SENT = 1 << 22
TREES = 256
_U = np.uint64
_END_WORD = mixed(np.array([0x454E44], _U))[0]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the rows and their end symbols, the byte after its DEPTH predecessors; and the rows' bounds."""
    bounds = offsets + np.arange(len(offsets))
    padded = np.full(bounds[-1] + DEPTH, END_BYTE, _U)
    keep = np.ones(bounds[-1], bool)
    keep[bounds[1:] - 1] = False
    padded[DEPTH:][keep] = lowered(data)
    found = np.zeros(bounds[-1], _U)
    for back in range(DEPTH, -1, -1):
        # before its first byte a row has end symbols only, nothing of the row before it
        part = padded[DEPTH - back:len(padded) - back].copy()
        for step in range(back):
            at = bounds[:-1] + step
            part[at[at < bounds[1:]]] = END_BYTE
        found |= part << _U(8 * back)
    return found, bounds


def count_runs(docs: DataFrame) -> DataFrame:
    """Runs of the texts with their counts: `n` in training texts, `m` in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            train = column(batch, "train").to_numpy(zero_copy_only=False).astype(np.float64)
            for start, end, data, offsets in slices(column(batch, "text")):
                found, bounds = runs(data, offsets)
                keys, at = np.unique(found, return_inverse=True)
                taught = np.bincount(at, np.repeat(train[start:end], np.diff(bounds)), len(keys))
                held.append(np.stack([keys.astype(np.int64), taught.astype(np.int64), np.bincount(at, minlength=len(keys))]))
                if sum(x.shape[1] for x in held) > 1_000_000:
                    held = [added(held)]
                    if held[0].shape[1] > 500_000:
                        yield as_batch(held.pop())
        if held:
            yield as_batch(added(held))

    def added(held: list[np.ndarray]) -> np.ndarray:
        every = np.concatenate(held, axis=1)
        keys, at = np.unique(every[0], return_inverse=True)
        return np.stack([keys, *(np.bincount(at, every[k], len(keys)).astype(np.int64) for k in (1, 2))])

    def as_batch(part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["run", "n", "m"])

    parts = docs.select("text", "train").mapInArrow(run, "run long, n long, m long")
    return parts.groupBy("run").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def node_keys(found: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run and bit: the node at this depth, and the bit. Depth, context and bits so far make a key."""
    byte, context = found & 0xFF, (found >> 8) & ((1 << 8 * depth) - 1)
    level = np.arange(8)
    prefix = (1 << level)[None, :] | (byte[:, None] >> (8 - level)[None, :])
    return (depth << 40) | (context[:, None] << 8) | prefix, (byte[:, None] >> (7 - level)[None, :]) & 1


def level(found: np.ndarray, many: np.ndarray, depth: int, below: tuple[np.ndarray, np.ndarray] | None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Nodes of one depth and their log weighted probabilities. below: keys of nodes here, and what the contexts that refine them come to."""
    keys, bits = node_keys(found, depth)
    key, at = np.unique(keys.ravel(), return_inverse=True)
    total = np.bincount(at, np.repeat(many, 8), len(key))
    ones = np.bincount(at, np.repeat(many, 8) * bits.ravel(), len(key))
    own = block(total - ones, ones)
    share, weighted = np.ones(len(key)), own
    if below is not None:
        rest = np.bincount(np.searchsorted(key, below[0]), below[1], len(key))
        share = 1 / (1 + np.exp(np.clip(rest - own, -60, 60)))
        weighted = np.logaddexp(own, rest) - np.log(2)
    return {"key": key, "one": (ones + 0.5) / (total + 1), "share": share}, weighted


def above(key: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of `depth` that nodes one deeper refine."""
    return (depth << 40) | (((key >> 8) & ((1 << 8 * depth) - 1)) << 8) | (key & 0xFF)


def weigh(found: np.ndarray, many: np.ndarray, top: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Nodes of depth `top` and more, and the log weighted probabilities of those at `top`."""
    nodes, below = [], None
    for depth in range(DEPTH, top - 1, -1):
        own, weighted = level(found, many, depth, below)
        nodes.append(own)
        if depth > top:
            below = (above(own["key"], depth - 1), weighted)
    return {c: np.concatenate([n[c] for n in nodes]) for c in nodes[0]}, own["key"], weighted


def joined(*models: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Nodes of several parts of the tree, by key."""
    key = np.concatenate([m["key"] for m in models])
    order = np.argsort(key)
    return {c: np.concatenate([m[c] for m in models])[order] for c in ("key", "one", "share")}


def _tree(trees: int) -> Column:
    """Which part of the deep nodes a run needs: by the two bytes before its last one."""
    return F.pmod(F.xxhash64(F.shiftright("run", 8).bitwiseAND(0xFFFF)), F.lit(trees))


def values(counts: DataFrame, trees: int = TREES) -> DataFrame:
    """run, `m` and the log10 `value` of every run of `counts` (run, n, m; a stored table)."""
    def tree(rows: pa.Table) -> pa.Table:
        nodes, top, value = weigh(column(rows, "run").to_numpy(), column(rows, "n").to_numpy(), 2)
        at = np.minimum(np.searchsorted(top, nodes["key"]), len(top) - 1)
        nodes["weighted"] = np.where(top[at] == nodes["key"], value[at], 0.0)
        return pa.table({"tree": pa.array(np.full(len(at), column(rows, "tree")[0].as_py())), **{c: nodes[c] for c in ("key", "one", "share", "weighted")}})

    counts = counts.withColumn("tree", _tree(trees))
    deep = settle(counts.where("n > 0").groupBy("tree").applyInArrow(tree, "tree long, key long, one double, share double, weighted double"), "nodes")
    # the two levels above: at most 255 and 255 * 255 nodes, from as few sums
    parent = F.lit(1 << 40).bitwiseOR(F.col("key").bitwiseAND(0xFFFF))
    refined = deep.where(F.shiftright("key", 40) == 2).groupBy(parent.alias("key")).agg(F.sum("weighted").alias("rest")).toArrow()
    pairs = counts.where("n > 0").groupBy(F.col("run").bitwiseAND(0xFFFF).alias("run")).agg(F.sum("n").alias("n")).toArrow()
    found, many = pairs["run"].to_numpy(), pairs["n"].to_numpy()
    first, weighted = level(found, many, 1, (refined["key"].to_numpy(), refined["rest"].to_numpy()))
    root, _ = level(found, many, 0, (above(first["key"], 0), weighted))
    small = joined(root, first)

    def valued(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        every = column(rows, "run").to_numpy()
        order = np.argsort(every)
        model = joined(small, {c: column(nodes, c).to_numpy() for c in ("key", "one", "share")})
        return pa.table({"run": every[order], "m": column(rows, "m").to_numpy()[order], "value": run_log10(every[order], model)})

    found_all = counts.select("tree", "run", "m").groupBy("tree").cogroup(deep.select("tree", "key", "one", "share").groupBy("tree"))
    return settle(found_all.applyInArrow(valued, "run long, m long, value double").where("run IS NOT NULL"), "values")


def frequent(found: DataFrame, most: int = SENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Runs and values of the most frequent runs, at most `most`, and the least count among them; 1 if they are all."""
    sizes = found.groupBy(F.floor(F.log2("m")).alias("size")).count().collect()  # one row for each power of two
    least, held = 1, 0
    for size, many in sorted(((r["size"], r["count"]) for r in sizes), reverse=True):
        held += many
        if held > most:
            least = 1 << (int(size) + 1)
            break
    table = found.where(F.col("m") >= least).select("run", "value").toArrow()
    order = np.argsort(table["run"].to_numpy())
    return table["run"].to_numpy()[order], table["value"].to_numpy()[order], least


def run_log10(found: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each run's last byte after the bytes before it. found: rising."""
    found = found.astype(np.int64)
    if not len(model["key"]):
        return np.full(len(found), 8 * np.log10(0.5))
    chance, known = np.zeros((len(found), 8)), np.zeros((len(found), 8), bool)
    for depth in range(DEPTH, -1, -1):
        # runs that end alike share their shorter contexts
        ends, at = np.unique(found & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        keys, _ = node_keys(ends, depth)
        place = np.minimum(np.searchsorted(model["key"], keys), len(model["key"]) - 1)
        seen = (model["key"][place] == keys)[at]
        one = model["one"][place].astype(np.float64)[at]
        share = model["share"][place].astype(np.float64)[at]
        chance = np.where(seen, np.where(known, share * one + (1 - share) * chance, one), chance)
        known |= seen
    bits = node_keys(found, 0)[1]
    chance = np.where(known, chance, 0.5)
    return np.log10(np.where(bits == 1, chance, 1 - chance)).sum(axis=1)


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted keys stand among rising ones, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class ChunkRuns:
    """The distinct runs of a chunk that are not sent to every task, by bucket."""

    def __init__(self, texts: pa.Array, sent: np.ndarray, buckets: int):
        parts = [np.unique(runs(data, offsets)[0]).astype(np.int64) for _, _, data, offsets in slices(texts)]
        distinct = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))
        self.keys = distinct[~_places(sent, distinct)[1]]
        bucket = _run_bucket(self.keys, buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))


def _run_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys.astype(_U) ^ _U(0x5BD1E995)) % _U(buckets)).astype(np.int64)


def row_scores(data: np.ndarray, offsets: np.ndarray, sent: tuple[np.ndarray, np.ndarray], rare: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each row, from the values of its runs."""
    found, bounds = runs(data, offsets)
    distinct, where = np.unique(found.astype(np.int64), return_inverse=True)
    value = np.full(len(distinct), np.nan)
    for keys, known in (sent, rare):
        at, seen = _places(keys, distinct)
        value[seen] = known[at[seen]]
    if np.isnan(value).any():
        raise ValueError("the input changed between two readings; write it to a table first")
    total = np.concatenate([[0.0], np.cumsum(value[where])])
    return total[bounds[1:]] - total[bounds[:-1]]


class ChunkWords:
    """Words of a chunk: their hashes, the rows' bounds, and the distinct ones by bucket."""

    def __init__(self, texts: pa.Array, buckets: int):
        hashes, rows = [], [0]
        for _, _, data, offsets in slices(texts):
            data = lowered(data)
            starts, ends, bounds = tokens(data, offsets)
            hashes.append(word_hashes(data, starts, ends))
            rows += (bounds[1:] + rows[-1]).tolist()
        self.hashes, self.rows = np.concatenate([np.zeros(0, _U), *hashes]), np.array(rows)
        self.distinct, self.at = np.unique(np.append(self.hashes, _END_WORD), return_inverse=True)
        bucket = (mixed(self.distinct ^ _U(0x1B873593)) % _U(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))


def _asked(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in chunks(batches):
            w = ChunkWords(column(rows, "text"), buckets)
            train = column(rows, "train").to_numpy(zero_copy_only=False)
            weight = np.append(np.repeat(train, np.diff(w.rows)).astype(np.int64), int(train.sum()))
            many = np.bincount(w.at, weight, len(w.distinct)).astype(np.int64)
            full = np.flatnonzero(np.diff(w.cuts))
            parts = [w.order[w.cuts[b]:w.cuts[b + 1]] for b in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(np.full(len(full), chunk), pa.int64()),
                 pa.array([planes(w.distinct[p]) for p in parts], pa.binary()), pa.array([planes(many[p]) for p in parts], pa.binary())],
                ["bucket", "chunk", "words", "many"])

    return run


def _answered(rows: pa.Table) -> pa.Table:
    """The corpus counts of the words that each chunk asks for; and, without a chunk, the bucket's number and sum of counts."""
    words = [from_planes(x.as_py(), _U) for x in column(rows, "words")]
    many = np.concatenate([from_planes(x.as_py(), np.int64) for x in column(rows, "many")])
    keys, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, many, len(keys)).astype(np.int64)
    parts = np.split(total[at], np.cumsum([len(w) for w in words])[:-1])
    n = rows.num_rows
    return pa.table({
        "chunk": pa.array([*column(rows, "chunk").to_pylist(), None], pa.int64()), "bucket": pa.array([*column(rows, "bucket").to_pylist(), None], pa.int32()),
        "counts": pa.array([*[planes(p) for p in parts], None], pa.binary()),
        "words": pa.array([None] * n + [int((total > 0).sum())], pa.int64()), "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()),
    })


def _asked_runs(buckets: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in chunks(batches):
            r = ChunkRuns(column(rows, "text"), sent.value[0], buckets)
            full = np.flatnonzero(np.diff(r.cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), chunk), pa.int64()),
                                              pa.array([planes(r.keys[r.order[r.cuts[b]:r.cuts[b + 1]]]) for b in full], pa.binary())], ["bucket", "chunk", "keys"])

    return run


def _answered_runs(buckets: int):
    """The values that the chunks ask a bucket for; told from the words' answers by their bucket number."""
    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, value = column(known, "run").to_numpy(), column(known, "value").to_numpy()
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        found = []
        for raw in column(asked, "keys"):
            at, seen = _places(keys, from_planes(raw.as_py(), np.int64))
            if not seen.all():
                raise ValueError("the input changed between two readings; write it to a table first")
            found.append(planes(value[at]))
        return pa.table({"chunk": column(asked, "chunk"), "bucket": pa.array(column(asked, "bucket").to_numpy() + buckets, pa.int32()), "counts": pa.array(found, pa.binary())})

    return run


def _bucketed(found: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_run_bucket(column(batch, "run").to_numpy(), buckets), pa.int32()), column(batch, "run"), column(batch, "value")], ["bucket", "run", "value"])

    return found.select("run", "value").mapInArrow(run, "bucket int, run long, value double")


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def score(docs: DataFrame, train: Column, most: int = SENT) -> DataFrame:
    """Every document with its baseline and model scores (log10), `train_tokens`, and bits per byte; `train` says which texts teach.

    most: how many values of runs may be sent to every task.
    """
    docs = own_columns(docs, "doc_id", "text").withColumn("train", F.coalesce(train, F.lit(False)))
    spark, buckets = docs.sparkSession, max(128, scan_tasks(docs))
    known = values(settle(count_runs(docs), "runs"))
    *sent, least = frequent(known, most)
    model = spark.sparkContext.broadcast(tuple(sent))
    asked = docs.mapInArrow(_asked(buckets), "bucket int, chunk long, words binary, many binary")
    answers = settle(asked.groupBy("bucket").applyInArrow(_answered, "chunk long, bucket int, counts binary, words long, tokens long"), "counts")
    sums = answers.where("chunk IS NULL").agg(F.sum("words").alias("v"), F.sum("tokens").alias("n")).first()
    n, v = sums["n"] or 0, sums["v"] or 0

    def run(texts: pa.Table, counted: pa.Table) -> pa.Table:
        if texts.num_rows != 1:
            raise ValueError("the input changed between two readings; write it to a table first")
        rows = unpacked(column(texts, "rows")[0].as_py())
        w = ChunkWords(column(rows, "text"), buckets)
        many = np.zeros(len(w.distinct), np.int64)
        r = ChunkRuns(column(rows, "text") if least > 1 else pa.array([], pa.string()), model.value[0], buckets)
        rare = np.full(len(r.keys), np.nan)
        for b, raw in zip(column(counted, "bucket").to_pylist(), column(counted, "counts").to_pylist(), strict=True):
            if b < buckets:
                many[w.order[w.cuts[b]:w.cuts[b + 1]]] = from_planes(raw, np.int64)
            else:
                rare[r.order[r.cuts[b - buckets]:r.cuts[b - buckets + 1]]] = from_planes(raw, np.float64)
        own = many[w.at]
        logs, end = np.log10((own + 1) / (n + v + 1)), own[-1]
        total = np.concatenate([[0.0], np.cumsum(logs[:-1])])
        known = np.concatenate([[0], np.cumsum(own[:-1] > 0)])
        base = total[w.rows[1:]] - total[w.rows[:-1]] + logs[-1]
        parts = [(row_scores(data, offsets, model.value, (r.keys, rare)), np.diff(offsets)) for _, _, data, offsets in slices(column(rows, "text"))]
        scores, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table([column(rows, "doc_id"), column(rows, "train"), pa.array(np.diff(w.rows) + 1), pa.array(known[w.rows[1:]] - known[w.rows[:-1]] + int(end > 0)),
                         pa.array(base), pa.array(scores), pa.array(sizes)], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    texts = docs.mapInArrow(packed, "chunk long, rows binary")
    told = answers.where("chunk IS NOT NULL").select("chunk", "bucket", "counts")
    if least > 1:  # some runs are not sent: the chunks ask for them
        wanted = docs.mapInArrow(_asked_runs(buckets, model), "bucket int, chunk long, keys binary").groupBy("bucket")
        rest = _bucketed(known.where(F.col("m") < least), buckets).groupBy("bucket")
        told = told.union(settle(wanted.cogroup(rest).applyInArrow(_answered_runs(buckets), "chunk long, bucket int, counts binary"), "run-values"))
    scored = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, SCORED)
    bits = -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)
    return scored.withColumn("train_tokens", F.lit(int(n)).cast("long")).withColumn("bits_per_byte", bits)
