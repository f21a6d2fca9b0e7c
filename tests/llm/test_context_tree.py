"""The context tree's scores against a slow recursion, sent or asked for, and awkward texts."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellwright.llm import ctw

TEXTS = ["abracadabra", "ABRA cadabra banana", "banana bandana", "", None, "x", "aaaaaaaaaaaaaaaaaaaa", "naïve Straße", "banana\nbanana"]


def symbols(text: str | None) -> list[int]:
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*data, 255]


def steps(text):
    """Each symbol with the DEPTH symbols before it, end symbols before the first."""
    found = [255] * ctw.DEPTH + symbols(text)
    return [(tuple(found[k - ctw.DEPTH:k]), found[k]) for k in range(ctw.DEPTH, len(found))]


def bits(symbol):
    return [(1 << k | symbol >> 8 - k, symbol >> 7 - k & 1) for k in range(8)]


def brute(train: list) -> callable:
    counts = defaultdict(lambda: [0, 0])
    for text in train:
        for context, symbol in steps(text):
            for prefix, bit in bits(symbol):
                for depth in range(ctw.DEPTH + 1):
                    counts[context[ctw.DEPTH - depth:], prefix][bit] += 1

    def own(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    children = defaultdict(list)
    for context, prefix in list(counts):
        if context:
            children[context[1:], prefix].append((context, prefix))

    def weighted(node):
        if len(node[0]) == ctw.DEPTH:
            return own(node)
        return math.log(0.5) + math.log(math.exp(own(node)) + math.exp(sum(weighted(c) for c in children[node])))

    def chance(context, prefix, depth):
        """Probability of a one, or None where training has not been."""
        node = (context[ctw.DEPTH - depth:], prefix)
        if node not in counts:
            return None
        a, b = counts[node]
        here = (b + 0.5) / (a + b + 1)
        below = chance(context, prefix, depth + 1) if depth < ctw.DEPTH else None
        if below is None:
            return here
        share = math.exp(math.log(0.5) + own(node) - weighted(node))
        return share * here + (1 - share) * below

    def score(text):
        total = 0.0
        for context, symbol in steps(text):
            for prefix, bit in bits(symbol):
                one = chance(context, prefix, 0)
                one = 0.5 if one is None else one
                total += math.log10(one if bit else 1 - one)
        return total

    return score


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ctw") / "t")
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for name in ("run", "n", "m", "tree", "chunk", "bucket", "train", "value", "key"):
        frame = frame.withColumn(name, F.lit("x"))
    frame.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("most", [ctw.SENT, 20, 0])
def test_scores_equal_the_recursion(docs, most):
    """All values of runs sent to the tasks, only the most frequent ones, or none: the same scores."""
    train = F.col("doc_id") % 3 != 1
    score = brute([t for k, t in enumerate(TEXTS) if k % 3 != 1])
    got = {r["doc_id"]: r["score"] for r in ctw.score(docs, train, most).collect()}
    assert got == {k: pytest.approx(score(t), rel=1e-9) for k, t in enumerate(TEXTS)}


def test_nothing_to_learn_from_and_nothing_to_score(docs):
    """Without training texts every bit is even."""
    got = {r["doc_id"]: (r["score"], r["train_tokens"]) for r in ctw.score(docs, F.lit(False)).collect()}
    assert got == {k: (pytest.approx(8 * len(symbols(t)) * math.log10(0.5)), 0) for k, t in enumerate(TEXTS)}
    assert ctw.score(docs.where("false"), F.lit(True)).count() == 0


def test_every_run_has_a_value_and_none_is_lost_to_the_limit(docs):
    known = ctw.values(ctw.settle(ctw.count_runs(docs.select("text", F.lit(True).alias("train"))), "runs"), trees=5)
    runs = {c + (s,) for t in TEXTS for c, s in steps(t)}
    assert known.count() == len(runs)
    keys, values, least = ctw.frequent(known, 30)
    assert 0 < len(keys) <= 30 and least > 1 and list(keys) == sorted(keys)
    assert known.where(F.col("m") < least).count() == len(runs) - len(keys)
    assert ctw.frequent(known, len(runs))[2] == 1
