"""A corpus from raw documents to packed sequences: five stages, each written as a table and read again for the next.

All stages but the last return the columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import fragment_join, packing, quality, sanitize, substring
from cellwright.llm.tables import remainder, table
from cellwright.session import settle

#: Near copies: five-word shingles and a Jaccard likeness of 0.8.
NEAR = fragment_join.Rule(width=5, num=80, den=100)


def _measured(after: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of `before`, with n_chars of the new text."""
    size = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return after.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in before.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return quality.accepted(docs, weights)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    dropped = fragment_join.classes(docs, NEAR).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    # under names of their own, so that none meets a name of the operator
    own = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(carry)])
    kept = substring.remove_repeats(own, carry=tuple(own.columns[2:]))
    return _measured(kept.select("doc_id", "text", *[F.col(f"c{n}").alias(c) for n, c in enumerate(carry)]), docs)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the words that reveal it replaced."""
    return _measured(sanitize.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_copy),
    ("substring dedup", cut_repeats),
    ("PII", hide_personal),
    ("best-fit packing", pack),
]

#: Training a classifier and tokenizing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs, f"stage{number}")
    return docs
