"""The queries of this subpackage, each over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import bond, ctw, fingerprints, fragment_join, itq, lattice, naming, packing, quality, randomness, sanitize, spans, substring, whitening
from cellwright.llm.tables import remainder, table

#: Words of a text, in SQL.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.sanitise(table(spark, sf_dir, "documents")).select(
        "doc_id", *_counts(sanitize.KINDS), spans.digest(F.col("base")).alias("base_sha256"),
        spans.written(F.concat("base", "added")).alias("spans"))


def _counts(kinds: list[str]) -> list[Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(k) for k in kinds]


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_join.classes(table(spark, sf_dir, "documents"))


def _held_out(modulus: int, value: int) -> Column:
    return remainder(F.col("doc_id"), modulus) == value


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), ~_held_out(5, 0))
    return quality.score(docs, weights).select(
        "doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(table(spark, sf_dir, "documents"), ~_held_out(7, 2))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *_counts(randomness.KINDS), spans.digest(F.col("base")).alias("base_sha256"),
        spans.written(spans.by_start(F.concat("base", "added"))).alias("spans"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.summary(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.cast("long").alias("label"), "embedding")
    return bond.mine(rows, F.col("vec_id") % 50 == 0)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.groups(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d)),
repeated AS (SELECT w.doc_id, w.pos FROM windows w JOIN (SELECT run, min(doc_id) AS least FROM windows GROUP BY run) m
  ON w.run = m.run AND m.least < w.doc_id),
gone AS (SELECT doc_id, list(DISTINCT pos) AS positions FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS pos FROM repeated) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(len(positions), 0) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda w, i: NOT list_contains(coalesce(positions, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""

OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 2], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) AS pos FROM d WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
counted AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM shingles a JOIN shingles b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM counted JOIN sizes su ON su.doc_id = u JOIN sizes sv ON sv.doc_id = v WHERE 100 * shared >= 90 * (su.n + sv.n - shared)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT r.id, l.v FROM reach r JOIN links l ON l.u = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 3
"""

OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_fingerprint": (op1_fingerprint, None),
    "op2_substring_dedup": (op2_substring_dedup, OP2_SQL),
    "op3_pii": (op3_pii, None),
    "op4_packing": (op4_packing, None),
    "op5_embedding_dedup": (op5_embedding_dedup, None),
    "op6_jaccard_join": (op6_jaccard_join, OP6_SQL),
    "op7_quality": (op7_quality, None),
    "op8_lm_score": (op8_lm_score, None),
    "op9_secrets": (op9_secrets, None),
    "op10_sentencepiece": (op10_sentencepiece, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_exact_dedup": (op12_exact_dedup, OP12_SQL),
    "op13_whitening": (op13_whitening, None),
}
