"""Operators that must judge all of their input: cases in which a part of it once went missing."""

from __future__ import annotations

import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from cellwright import session
from cellwright.llm import fragment_join, randomness, substring
from cellwright.session import Steps


def test_repeats_with_carried_columns_over_many_batches(spark, tmp_path):
    """The bytes of carried columns end Arrow batches early; windows and texts must still be cut alike."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))) + (f" {passage}" if k % 3 == 0 else "") for k in range(300)]
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, t, "x" * 7 * (k % 90)) for k, t in enumerate(texts)], "doc_id long, text string, note string").coalesce(1).write.parquet(path)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        found = {r["doc_id"]: r for r in substring.remove_repeats(spark.read.parquet(path), carry=("note",)).collect()}
    finally:
        spark.conf.set(name, before)
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        assert found[k]["text"] == (t.removesuffix(f" {passage}") if k else t), k
        assert found[k]["note"] == "x" * 7 * (k % 90)


def test_few_random_tokens_among_many_ordinary_ones(spark):
    """One random token among a hundred ordinary ones: only the fixed floor of its length may lose it."""
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = ["".join(rng.choice(letters) for _ in range(24)) for _ in range(30)]
    parts = ["internationalization", "communication", "configuration", "responsibilities"]
    ordinary = ["".join(rng.choice(parts) for _ in range(3))[:24] for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(secret)] + [(1000 + k, ordinary[k % 300]) for k in range(3000)]
    found = randomness.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    added = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in found}
    assert sum([(a, b) for _, a, b in added[k]] == [(0, len(t))] for k, t in enumerate(secret)) >= 29
    assert {kind for k in range(len(secret)) for kind, _, _ in added[k]} <= set(randomness.ADDED)
    assert not any(added[1000 + k] for k in range(3000))


def test_secrets_after_an_equals_sign_or_between_mixed_signs(spark):
    value = "wJalrXUtnFEMIK7MDENGbPxRfiCYzR4q9Vt2Hs8L"
    forms = [f"AWS_SECRET_ACCESS_KEY={value}", f"see deploy_pw={value} there", f"https://h.example/?key={value}&x=1", f"sk_live/{value}", f"{value}=", f"a+b-{value}/c_d"]
    found = randomness.scan(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")).collect()
    for r in found:
        text = forms[r["doc_id"]]
        spans = {text[s["start"]:s["end"]] for s in r["added"]}
        assert spans & {value, f"{value}="}, (text, spans)


def _large_texts() -> list[str]:
    """Texts of 2,400 words, half of them shared by all, and a near copy of the first."""
    shared = [f"s{k}" for k in range(1200)]
    texts = [" ".join(shared[:600] + [f"d{d}w{k}" for k in range(1200)] + shared[600:]) for d in range(12)]
    return [*texts, texts[0] + " one more word"]


def test_large_sets_that_share_a_half_are_refuted_by_their_profiles(spark, tmp_path):
    """The sketch of fixed size cannot tell them apart: their words were moved for every pair of them."""
    path, rule = str(tmp_path / "t"), fragment_join.Rule(5, 80, 100)
    spark.createDataFrame(list(enumerate(_large_texts())), "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    info = fragment_join.described(docs, rule)
    rows = info.collect()
    assert all(rule.difference(2 * r["n"]) > fragment_join.PARITY_BITS // 2 for r in rows)
    pairs = info.select(F.col("doc_id").alias("u")).crossJoin(info.select(F.col("doc_id").alias("v"))).where("u < v")
    assert [(r["u"], r["v"]) for r in fragment_join.judged(pairs, info, rule).where("near").collect()] == [(0, 12)]
    classes = {r["doc_id"]: r["component_id"] for r in fragment_join.classes(docs, rule).collect()}
    assert classes == {k: k % 12 for k in range(13)}


def test_the_profiles_bound_the_difference_of_sets_of_any_sizes():
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(3000)])
    held = [set(rng.choice(words, n, replace=False)) for n in (0, 1, 2, 30, 33, 500, 620, 2500, 3000)] + [set(words[:40]), set(words[:50])]
    data = np.frombuffer(b"".join(" ".join(sorted(h)).encode() for h in held), np.uint8)
    ends = np.cumsum([len(" ".join(sorted(h))) for h in held])
    profiles = fragment_join.Sets(data, np.concatenate([[0], ends]), fragment_join.Rule(1)).profile()
    for a, x in zip(held, profiles, strict=True):
        for b, y in zip(held, profiles, strict=True):
            assert fragment_join.difference(x, y) == fragment_join.difference(y, x) <= len(a ^ b)
    assert fragment_join.difference(profiles[-1], profiles[-2]) > 5


def test_near_copies_leave_only_tables_that_the_result_reads(spark, tmp_path, monkeypatch):
    """Buckets, candidates and words of the sets stayed until the end of the job and counted against the disk of every later stage."""
    path, folder = str(tmp_path / "t"), str(tmp_path / "kept")
    spark.createDataFrame(list(enumerate(_large_texts())), "doc_id long, text string").write.parquet(path)
    monkeypatch.setattr(session, "shared_folder", lambda _: folder)
    found = fragment_join.classes(spark.read.parquet(path), fragment_join.Rule(5, 80, 100))
    assert {x.rpartition("-")[0] for x in os.listdir(folder)} <= {"sets", "classes", "links", "stars", "found"}
    assert found.count() == 13


def test_shuffles_go_once_the_frame_behind_them_is_written(spark):
    """They stayed until the driver happened to collect its garbage, which it does the less often the more each of them holds."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        files = blocks.getAllFiles()
        return {x for k in range(files.size()) if (x := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffles()
    steps = Steps(spark)
    frame = steps.settle(spark.range(100_000).groupBy((F.col("id") % 1009).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left
    assert frame.count() == 1009
    steps.drop(frame)
    assert not frame.inputFiles() or not any(os.path.exists(x.removeprefix("file://")) for x in frame.inputFiles())
