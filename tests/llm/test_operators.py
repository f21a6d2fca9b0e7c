"""Each operator against a brute-force version on small frames that hold the awkward cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellwright.llm import (
    catalog, ctw, fingerprints, fragment_join, itq, lattice, packing, quality, randomness, sanitize, spans, substring,
)
from cellwright.llm.components import components

RANDOM = random.Random(5)
VOCABULARY = ["the", "of", "Straße", "naïve", "alpha", "beta", "gamma", "delta", "x1", "???", "ein", "über"]


def sentence(n: int) -> str:
    return " ".join(RANDOM.choice(VOCABULARY) + str(RANDOM.randrange(9)) for _ in range(n))


def _texts() -> list[tuple]:
    base, passage = sentence(90), sentence(20)
    rows = [base, base, base.replace("the1", "the2", 1), passage + " " + sentence(30), sentence(12) + "\n\t " + passage, passage, None, "", " \n ", "one two",
            "one two", sentence(3000), "a" * 20000, "1." * 5000, "word " * 40, sentence(14), sentence(13), "   tricky​", base.upper()]
    return [(k * 7, t, "en", "s", k) for k, t in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    """Written, with further columns whose names the operators use inside."""
    path = str(tmp_path_factory.mktemp("docs") / "t")
    extra = spark.createDataFrame(texts, SCHEMA)
    for name in ("chunk", "bucket", "n", "key", "id", "base", "row_key", "length", "block"):
        extra = extra.withColumn(name, F.lit("x"))
    extra.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "t")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def test_fingerprints_follow_the_next_document(docs, texts):
    rows = sorted(((i, t or "") for i, t, *_ in texts), reverse=True)
    found = {r["doc_id"]: r for r in fingerprints.neighbours(docs).collect()}
    assert len(found) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        sets = [{tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(x)) else set() for x in (t, edited, after)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert found[i]["n_chars"] == len(t)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        tolerance = 1e-9 if len(sets[0] | sets[1] | sets[2]) <= fingerprints.K else 0.15
        assert abs(found[i]["near_edited"] - near[0]) <= tolerance
        assert abs(found[i]["near_next"] - near[1]) <= tolerance
    assert found[0]["fingerprint"] == found[7]["fingerprint"]


def test_sketches_merge_and_estimate(spark, docs, empty):
    a, b = (np.unique(np.random.default_rng(k).integers(0, 1 << 48, 3000, dtype=np.uint64)) for k in (1, 2))
    both = np.union1d(a, b)
    whole, parts = both[:256], fingerprints.merge(a[:256], b[:256])
    assert (whole == parts).all() and (fingerprints.from_text(fingerprints.to_text(whole)) == whole).all()
    assert abs(fingerprints.distinct_count(whole) / 6000 - 1) < 0.25
    assert abs(fingerprints.containment(a[:256], whole) - 1) < 0.3
    prints = fingerprints.fingerprint(docs).withColumn("all", F.lit("all"))
    merged = fingerprints.merge_groups(prints, "all").first()["hashes"]
    united = np.unique(np.concatenate([fingerprints.from_text(r["fingerprint"]) for r in prints.collect()]))[:256]
    assert merged == united.astype(np.int64).tolist()
    assert fingerprints.neighbours(empty).count() == 0


def test_repeats_are_removed_by_smaller_documents(docs, texts, empty, spark):
    first: dict[tuple, int] = {}
    for i, t, *_ in texts:
        w = words(t)
        for k in range(len(w) - 12):
            first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    found = {r["doc_id"]: r for r in substring.remove_repeats(docs, digest=True).collect()}
    plain = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs, carry=("lang", "bucket")).collect()}
    for i, t, *_ in texts:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (found[i]["n_words"], found[i]["n_removed"]) == (len(w), len(gone))
        assert found[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert plain[i] == (kept.decode() if gone else t)
    assert substring.remove_repeats(empty, digest=True).count() == 0
    assert substring.intervals(np.array([1, 1, 0, 1], bool)) == [(0, 2), (3, 4)]


PERSONAL = [
    "write to a.b+c@x-y.co.uk. or d@e, f@g.h_i@j.kk", "at 10.0.0.255 and 1.2.3.256 1.2.3.4.5.6.7.8 999.1.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112",
    "12345678901234567890 4111111111111111000", "+1 (650) 555-0100, +12 34, +49 30 1234567890123456", "é😀 mail ü@x.de a@b.c", "+1 4111 1111 1111 1111", None, "", "@" * 50, "a." * 3000 + "@",
]


def personal(t: str) -> list[tuple]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_personal_data_and_what_reveals_it(spark, empty):
    fuzz = ["".join(RANDOM.choice("ab1234.@+- ()") for _ in range(120)) for _ in range(150)]
    clean = [sentence(12) + " meadow river" for _ in range(400)]
    cues = [f"{sentence(3)} Telefonnummer erreichbar: +49 30 {k:07d} {sentence(3)}" for k in range(40)]
    rows = [(k, t) for k, t in enumerate(PERSONAL + fuzz + clean + cues)]
    rows.append(rows[0])
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("x"))
    found = sanitize.sanitise(frame).select("doc_id", "base", spans.written(F.col("added")).alias("added")).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == personal(text[r["doc_id"]] or "")
    added = {r["doc_id"]: r["added"] for r in found}
    for k, t in rows:
        words_added = {t[int(a):int(b)] for _, a, b in (s.split(":") for s in added[k].split(",") if s)}
        assert ("Telefonnummer" in words_added) == (t or "").__contains__("Telefonnummer"), (t, words_added)
        assert not words_added & {"meadow", "river"}
    hidden = {r["doc_id"]: r["text"] for r in sanitize.redact(frame).collect()}
    assert hidden[len(rows) - 2].count("<phone>") == 1 and "Telefonnummer" not in hidden[len(rows) - 2]
    assert sanitize.sanitise(empty).count() == 0


def secrets(t: str) -> list[tuple]:
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secrets_and_random_tokens(spark, empty):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = ["".join(RANDOM.choice(letters) for _ in range(40)) for _ in range(30)]
    ordinary = ["internationalization_of_things", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "path/to/some/nested/folder/name", "--------------------------", "0000000000000000000000001"]
    forms = ["Password = 'abcdefghijkl' Token:x api_key:\"AAAABBBBCCCC\"", "AKIA12345678901234 AKIAX", "0123456789abcdef0 deadbeef", "é token: " + "z" * 30, None, ""]
    rows = [(k, t) for k, t in enumerate(forms + [f"see {t} there" for t in tokens + ordinary * 6])]
    found = randomness.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("x"))).collect()
    assert len(found) == len(rows)
    text, added = dict(rows), Counter()
    for r in found:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == secrets(text[r["doc_id"]] or "")
        added.update(text[r["doc_id"]][s["start"]:s["end"]] for s in r["added"])
    assert sum(added[t] > 0 for t in tokens) >= 27
    assert not any(added[t] for t in ordinary)
    assert randomness.scan(empty).count() == 0


def test_packing_places_every_token_once(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t, *_ in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:])
        for r in own:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part.tobytes())
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(empty).count() == 0
    special = "a <|endoftext|> b"
    assert packing.document_ids(special, packing.vocabulary()).tolist()[:-1] == tokenizer.encode(special, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_is_tight_and_complete(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([2048, 1500, 1025, 1024, 700, 683, 682, 300, 17, 1], 4000, p=[.05, .05, .1, .1, .1, .1, .1, .2, .1, .1])
    lengths = np.concatenate([lengths, rng.integers(1, 2048, 500)])
    histogram = {int(k): int(v) for k, v in Counter(lengths.tolist()).items()}
    slots, used, places = packing.plan(histogram), Counter(), Counter()
    for length, first, end, sequence, _ in slots:
        places[length] += end - first
        for k in range(end - first):
            used[sequence + k] += length
    assert places == Counter(histogram) and max(used.values()) <= 2048
    assert len(used) <= 1.03 * math.ceil(lengths.sum() / 2048) + 1


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 48))
    rows = [(c + rng.normal(scale=0.12, size=48)).astype(np.float32).tolist() for c in centres for _ in range(12)]
    rows += [rows[0]] * 40 + [None, [0.0] * 48, [float("nan")] * 48, [None] * 48, [1.0], []]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("code", F.lit(1))
    found = {r["vec_id"]: r for r in itq.near_duplicates(frame).collect()}
    sound, sizes = list(range(400)), len(rows)
    unit = itq.unit(np.array([rows[k] for k in sound], float))
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    assert len(found) == sizes
    got, want = sum(found[k]["n_links"] for k in sound), int(linked.sum())
    assert 0.9 * want <= got <= want
    assert all(found[k]["n_links"] == 0 and found[k]["component_id"] == k and found[k]["kept"] for k in range(400, sizes))
    assert all(found[k]["component_id"] <= k for k in sound)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert itq.near_duplicates(none).count() == 0


def brute_classes(rows: list[tuple], rule: fragment_join.Rule) -> dict:
    sets = {}
    for i, t in rows:
        w = words(t.lower() if t and t.isascii() else t)
        w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in w]
        sets[i] = frozenset(tuple(w[k:k + rule.width]) for k in range(max(1, len(w) - rule.width + 1))) if w else frozenset()
    label = {i: i for i, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i, _ in rows}


@pytest.mark.parametrize("rule", [fragment_join.Rule(), fragment_join.Rule(5, 80, 100)])
def test_jaccard_classes_equal_brute_force(spark, tmp_path, rule):
    rng = random.Random(11)
    rows: list[tuple] = [(k, None if k == 3 else "") for k in range(3, 6)]
    for group in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 20, 60, 150]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(["X", "w1", f"u{rng.randrange(5)}"])
            if rng.random() < 0.3:
                del copy[rng.randrange(len(copy))]
            rows.append((1000 - len(rows) * 3, " ".join(copy)))
    rows.append(rows[-1])
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).repartition(3).write.parquet(str(tmp_path / "t"))
    found = fragment_join.classes(spark.read.parquet(str(tmp_path / "t")), rule).collect()
    want = brute_classes(list(dict(rows).items()), rule)
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_jaccard_blocks_split_large_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fragment_join, "BLOCK", 4)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:k] + ["X"] + base[k + 1:])) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    found = fragment_join.classes(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_classes(rows, fragment_join.Rule())


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)], "u long, v long")
    assert {r["id"]: r["component"] for r in components(path).collect()} == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


def test_quality_learns_and_scores_every_text(spark, empty):
    good = [(k, sentence(40), 1) for k in range(300)]
    bad = [(1000 + k, " ".join(w + "***" for w in sentence(40).split()), 0) for k in range(300)]
    rows = good + bad + [(5000, None, None), (5001, "", None), (5002, "word " * 20000, None)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None], "doc_id long, quality int, toxic int")
    weights = quality.fit(frame, labels, F.col("doc_id") % 5 != 0)
    found = {r["doc_id"]: r["score"] for r in quality.score(frame, weights).collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())
    held = [(found[i] >= 0.3) == bool(q) for i, _, q in rows if q is not None and i % 5 == 0]
    assert sum(held) / len(held) > 0.97
    kept = quality.accepted(frame, weights)
    assert kept.columns == frame.columns and {i for i, *_ in good} <= {r["doc_id"] for r in kept.collect()}
    nothing = quality.fit(empty, labels.limit(0), F.lit(True))
    assert not nothing.any() and quality.score(empty, nothing).count() == 0


def test_scores_of_the_context_tree(spark, docs, texts, empty):
    train = F.col("doc_id") % 2 == 0
    found = {r["doc_id"]: r for r in ctw.score(docs, train).collect()}
    lower = {i: [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words(t)] + [None] for i, t, *_ in texts}
    counts = Counter(w for i, ws in lower.items() if i % 2 == 0 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in lower.items():
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    assert ctw.score(empty, train).count() == 0


def test_context_tree_is_a_distribution_and_equals_the_recursion():
    data = np.frombuffer(b"abracadabra abracadabra banana", np.uint8)
    found, bounds = ctw.runs(data, np.array([0, 11, len(data)]))
    assert bounds.tolist() == [0, 12, len(data) + 2]
    assert found[0] & 0xFF == ord("a") and found[0] >> np.uint64(8) == (1 << 8 * ctw.DEPTH) - 1
    assert found[12] >> np.uint64(8) == (1 << 8 * ctw.DEPTH) - 1
    keys, many = np.unique(found, return_counts=True)
    zeros = np.array([0.0, 3, 5])
    ones = np.array([1.0, 0, 2])
    slow = [math.log(math.prod([(k + .5) for k in range(int(a))] + [(k + .5) for k in range(int(b))]) / math.factorial(int(a + b))) for a, b in zip(zeros, ones, strict=True)]
    assert np.allclose(ctw.block(zeros, ones), slow)
    nodes, _, _ = ctw.weigh(keys.astype(np.int64), many, 0)
    model = ctw.joined(nodes)
    context = int(found[5] >> np.uint64(8)) << 8
    every = np.sort(np.array([context | b for b in range(256)], np.uint64))
    assert (10 ** ctw.run_log10(every, model)).sum() == pytest.approx(1.0)


def test_pieces_equal_the_library_and_come_back(spark, docs, texts, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lattice.model_path())
    found = {r["doc_id"]: r for r in lattice.summary(docs).collect()}
    fuzz = ["".join(RANDOM.choice("abcdeé  \t\n.,!▁你🙂\x00") for _ in range(RANDOM.randrange(40))) for _ in range(400)]
    p = lattice.pieces(lattice.model_path())
    for t in fuzz + ["a" * 2000, " " * 300, "<s>"]:
        assert p.encode(t) == model.encode(t) and p.decode(p.encode(t)) == model.decode(model.encode(t))
    for i, t, *_ in texts:
        ids = model.encode(t or "")
        assert found[i]["ids"] == ids and found[i]["n_pieces"] == len(ids)
        assert found[i]["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert lattice.merged("thetionabc", p) == lattice.joined("thetionabc", p) if len("thetionabc") > lattice.SHORT else True
    assert lattice.decode(lattice.encode(docs)).count() == len(texts) and lattice.summary(empty).count() == 0


def test_distinct_words_are_folded_together(monkeypatch):
    import sentencepiece

    rng = random.Random(6)
    model = sentencepiece.SentencePieceProcessor(model_file=lattice.model_path())
    p = lattice.pieces(lattice.model_path())
    words = ["".join(rng.choice("aeinorst,.é你") for _ in range(rng.randrange(1, 20))) for _ in range(2000)]
    several = [None, "", " ", *(" ".join(rng.choices(words, k=50)) for _ in range(40)), "tion" * 100, "  a▁ b  "]
    expected = [model.encode(t or "") for t in several]
    monkeypatch.setattr(lattice, "BYTES", 300)
    assert sum(n for _, n in lattice.bounded(pa.array(several))) == len(several) and len(list(lattice.bounded(pa.array(several)))) > 10
    ids = p.encode_all(pa.array(several))
    assert ids.to_pylist() == expected and p.encode_all(pa.array([], pa.string())).to_pylist() == []
    assert p.decode_all(ids) == [model.decode(x) for x in expected]
    raw = [[p.byte_ids[b] for b in rng.choices(b"\xe4\xbd\xa0\xe2\x96\x81a", k=8)] for _ in range(200)]
    assert p.decode_all(pa.array(raw, pa.list_(pa.int32()))) == [p.decode(x) for x in raw]

    def alone(*_):
        raise AssertionError("a word was folded by itself")

    monkeypatch.setattr(lattice, "merged", alone)
    assert p.encode(" ".join(words)) == model.encode(" ".join(words))


def test_folding_together_equals_folding_alone():
    rng = random.Random(7)
    for _ in range(100):
        names = [rng.choice("▁ab") + "".join(rng.choices("abc", k=rng.randrange(5))) for _ in range(rng.randrange(15))]
        scores = {x: float(-rng.randrange(6)) for x in names}
        p = lattice.table({k: i for i, k in enumerate(scores)}, scores, list(range(100, 356)), [])
        words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 90))) for _ in range(20)]
        assert p.encode(" ".join(words)) == [i for w in words for i in lattice.joined("▁" + w, p)]


def test_unigram_path_is_the_best_of_all():
    scores = {"▁": -2.5, "a": -1.5, "b": -1.7, "ab": -2.1, "▁a": -2.2, "ba": -2.0, "aba": -5.5, "▁ab": -3.9}
    p = lattice.table({k: i for i, k in enumerate(scores)}, scores, list(range(100, 356)), [])
    assert not p.merges

    def splits(word):
        return [[]] if not word else [[word[:k], *r] for k in range(1, len(word) + 1) if word[:k] in scores for r in splits(word[k:])]

    for word in ("▁abab", "▁aba", "▁baab", "▁"):
        best = max(sum(scores[x] for x in s) for s in splits(word))
        got = [list(scores)[i] for i in lattice.best_path(word, p)]
        assert "".join(got) == word and sum(scores[x] for x in got) == pytest.approx(best)


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.QUERIES.items() if sql])
def test_queries_equal_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    query, sql = catalog.QUERIES[name]
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{sf_dir}/{name_}.parquet'")
    want = con.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


def test_pipeline_runs_and_each_stage_takes_effect(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.settle(stage(spark, docs, sf_dir), f"test{k}")
        assert docs.columns == columns
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert 0 < len(texts) < before
    assert not any(personal(t) for _, t in texts)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in texts}


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "\n" * 2_000_000, "\t " * 700_000 + "y"])
def test_packing_takes_long_blank_texts(spark, text):
    import tokenizers

    path = packing.vocabulary()
    want = tokenizers.Tokenizer.from_file(path.removesuffix("tiktoken") + "json").encode(text, add_special_tokens=False).ids
    assert packing.document_ids(text, path).tolist() == [*want, 0]
    pieces = packing.pack(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1) == len(want) + 1


def test_stages_keep_columns_with_the_names_they_use_inside(spark, tmp_path):
    import corpus_pipeline

    path = str(tmp_path / "t")
    rows = [(k, sentence(60) + (f" write to a{k}@b.example" if k % 2 else "")) for k in range(12)] + [(90, None), (91, "")]
    names = ["row_key", "spans", "n_words", "n_removed", "rest", "base", "kept", "chunk", "score", "component_id"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long"))
    for n in names:
        frame = frame.withColumn(n, F.concat(F.lit(n), "doc_id"))
    frame.coalesce(2).write.parquet(path)
    docs = spark.read.parquet(path)
    for stage in (corpus_pipeline.keep_one_copy, corpus_pipeline.cut_repeats, corpus_pipeline.hide_personal):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names], stage
