"""Block naming against grouping by the whole text, with colliding hashes too."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellwright.llm import naming

RANDOM = random.Random(1)
TEXTS = [None, "", "", " ", "aaaaa", "aaaaaa", "abababab", "abababab", "é😀" * 9, "é😀" * 9, "é", "é", "x\ny\r\nz" * 3, "a" * 3, "a" * 6, "a" * 300, "a" * 301]
TEXTS += ["".join(RANDOM.choice("ab\n😀") for _ in range(RANDOM.randrange(1, 40))) for _ in range(150)]
#: Missing and repeated ids, repeated rows.
ROWS = [(k if k % 7 else None, t) for k, t in enumerate(TEXTS)] + [(3, " "), (3, " "), (5, "other")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("naming") / "t")
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("row", "key", "keys", "name", "names", "level", "kept", "item"):
        frame = frame.withColumn(name, F.lit("x"))
    frame.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def brute() -> tuple[Counter, dict]:
    many, best = Counter(t or "" for _, t in ROWS), {}
    for i, t in ROWS:
        best[t or ""] = max([x for x in (best.get(t or ""), i) if x is not None], default=None)
    return many, best


@pytest.mark.parametrize("collide", [False, True])
def test_identities_equal_whole_texts(docs, monkeypatch, collide):
    if collide:  # five hashes for all blocks: names must come from the blocks themselves
        monkeypatch.setattr(naming, "hashed", lambda v: F.pmod(F.xxhash64(v), F.lit(5)).cast("long"))
    many, best = brute()
    text = {hashlib.sha256(t.encode()).hexdigest(): t for t in many}
    got = naming.groups(docs, size=3, bucket=4).collect()
    assert Counter((r["doc_id"], text[r["text_sha256"]]) for r in got) == Counter((i, t or "") for i, t in ROWS)
    for r in got:
        t = text[r["text_sha256"]]
        assert (r["group_size"], r["keep_id"]) == (many[t], best[t])
        assert not r["kept"] or r["doc_id"] == best[t]
    assert Counter(text[r["text_sha256"]] for r in got if r["kept"]) == {t: 1 for t in many}


def test_only_colliding_blocks_keep_their_text(docs, spark):
    rows = spark.createDataFrame([("aaa",), ("aaa",), ("bbb",)], "item string")
    names = naming._sorted_names(rows.select(naming.hashed(F.col("item")).alias("key"), "item"), 3, 2).collect()
    assert len(names) == 2 and all(r["alone"] for r in names) and len({r["name"] for r in names}) == 2
    same = naming._sorted_names(rows.select(F.lit(1).cast("long").alias("key"), "item"), 3, 2).collect()
    assert [r["item"] for r in sorted(same, key=lambda r: r["name"])] == ["aaa", "bbb"] and not any(r["alone"] for r in same)


def test_kept_rows_come_back_with_all_their_columns(docs):
    kept = naming.deduplicate(docs, size=3)
    assert kept.columns == docs.columns
    many, best = brute()
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter((best[t], t) for t in many)


def test_a_long_text_and_many_copies(spark, tmp_path):
    long_text = "".join(RANDOM.choice("abc ") for _ in range(300_000))
    rows = [(k, long_text if k < 2 else long_text + "x" if k == 2 else "copy " * 50) for k in range(400)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)
    got = {r["doc_id"]: r for r in naming.groups(spark.read.parquet(path), size=64, bucket=16).collect()}
    assert [got[k]["group_size"] for k in (0, 1, 2, 3)] == [2, 2, 1, 397]
    assert [k for k, r in got.items() if r["kept"]] and sorted(k for k, r in got.items() if r["kept"]) == [1, 2, 399]


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    empty = spark.read.parquet(path)
    assert naming.groups(empty).collect() == [] and naming.deduplicate(empty).collect() == []


def test_native(docs):
    plan = naming.groups(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
