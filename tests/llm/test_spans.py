"""Texts with many matches, redaction in pieces, and rare words that reveal a person."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cellwright.llm import sanitize, spans


def test_forty_thousand_matches_in_one_text(spark):
    """Seconds, not the square of the matches."""
    text = " ".join(f"a{k}@b{k % 7}.example é" for k in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    start = time.time()
    found = {r["doc_id"]: r for r in sanitize.find(docs).select("doc_id", "base").collect()}
    assert [(s["start"], s["end"]) for s in found[1]["base"]] == [m.span() for m in re.finditer(r"a\d+@b\d\.example", text)]
    hidden = {r["doc_id"]: r["text"] for r in sanitize.redact(docs).collect()}
    assert hidden[1] == " ".join(["<email> é"] * 40_000) and hidden[2] == "none" and hidden[3] == ""
    assert time.time() - start < 120


@pytest.mark.parametrize("piece, step", [(1, 1), (3, 2), (7, 64), (1024, 64)])
def test_redaction_equals_cutting(spark, monkeypatch, piece, step):
    """Overlapping, touching and empty gaps, at any cut of the text."""
    monkeypatch.setattr(spans, "PIECE", piece)
    monkeypatch.setattr(spans, "STEP", step)
    rng = random.Random(piece)
    rows, want = [], []
    for k in range(60):
        text = "".join(rng.choice("abé😀 \n") for _ in range(rng.randrange(1, 40)))
        held = sorted((a, rng.randrange(2), min(len(text), a + rng.randrange(1, 6))) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(6))))
        rows.append((k, text, [(rank, "xy"[rank], a, b) for a, rank, b in held]))
        out, at = "", 0
        for a, rank, b in held:
            if a >= at:
                out += text[at:a] + f"<{'xy'[rank]}>"
            at = max(at, b)
        want.append(out + text[at:])
    frame = spark.createDataFrame(rows, f"k int, text string, spans {spans.SPAN}")
    got = frame.select("k", spans.redacted(F.col("text"), F.col("spans"), lambda kind: F.concat(F.lit("<"), kind, F.lit(">"))).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in got] == want


@pytest.mark.parametrize("step", [1, 3, 64])
def test_running_sums_and_maxima(spark, monkeypatch, step):
    monkeypatch.setattr(spans, "STEP", step)
    rng = random.Random(step)
    rows = [([rng.randrange(50) for _ in range(n)],) for n in (0, 1, 2, 3, 63, 64, 65, 200)]
    frame = spark.createDataFrame(rows, "v array<int>")
    got = frame.select("v", spans.running(F.col("v"), lambda a, b: a + b).alias("s"), spans.running(F.col("v"), F.greatest).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["v"][:k]) for k in range(len(r["v"]))]
        assert r["m"] == [max([0, *r["v"][:k]]) for k in range(len(r["v"]))]


def test_a_rare_name_beside_its_addresses_is_found(spark):
    """Nineteen texts of one name beside her address; a word as rare that also stands alone, and common words, stay."""
    rng = random.Random(4)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}ord" for k in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [f"{some(20)} Zanelemb writes from z{k}@mail.example {some(20)}" for k in range(19)]
    rows += [f"{some(20)} Occasional sends to q{k}@post.example {some(20)}" for k in range(5)] + [f"{some(20)} occasional {some(20)}" for _ in range(9)]
    rows += [f"{some(9)} Single at s@t.example {some(9)}"] + [some(60) for _ in range(400)] + [f"writes from {some(30)} sends to" for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = sanitize.sanitise(docs).select("doc_id", "added").collect()
    said = [rows[r["doc_id"]][s["start"]:s["end"]].lower() for r in found for s in r["added"]]
    assert said.count("zanelemb") == 19 and "occasional" not in said and "single" not in said and set(said) <= {"zanelemb"}


def test_the_plan_has_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "write to a@b.example")], "doc_id long, text string")
    plan = sanitize.sanitise(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "Arrow"))
