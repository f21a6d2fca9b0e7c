"""Personal data, and information-theoretic sanitisation of the words that reveal it.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers (BASE). Around each of them, the
words of the neighbouring code points form its context. Over the whole corpus a word's disclosure of a kind of
entity is the pointwise mutual information of the two, PMI = log2(P(word | context of the kind) / P(word)), as a
share of the kind's own information, -log2 P(kind): 1 if the word occurs beside such entities only. Words that
disclose at least GENERALISE of a kind are generalised where they stand beside an entity of that kind; from REMOVE on they are
removed. The evidence must carry that: SUPPORT different contexts, or, for rarer words, such as the name that stands beside one
person's addresses, a share of the word's uses beside the kind that is above HALF even at the lower end of its 95 % (Wilson) interval, which takes four
contexts and no other use, or 19 of 26. Everything is built-in expressions.

P(word) is the chance that a context-sized piece of the corpus holds the word, from the counts of all words of
all texts; contexts that read the same count once, so that copies do not make evidence. Words are runs of three
or more letters, lower-cased. A null or empty text has no spans; rows alike in id and text have the same spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.spans import HIT, SPAN, as_spans, keyed, located, overlaps, redacted
from cellwright.session import settle

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["generalised", "removed"]
AROUND = 48
CONTEXT_WORDS = 10
GENERALISE, REMOVE, SUPPORT = 0.5, 0.8, 20
HALF, Z = 0.5, 1.96

# What counts as personal data.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_WORD = r"\p{L}{3,}+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Does the checksum of the digits hold?"""
    digits = F.reverse(_digits(value))
    each = F.transform(F.split(digits, ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0)))) % 10 == 0


def base_hits(text: Column, around: int = 0) -> dict[str, Column]:
    """The matches of each kind that pass its check."""
    def found(gate: Column, pattern: str) -> Column:
        return F.when(gate, located(text, pattern, around)).otherwise(F.array().cast(HIT))

    count = lambda h: F.char_length(_digits(h["value"]))
    return {
        "email": found(text.contains("@"), _EMAIL),
        "ip": F.filter(found(text.rlike(_IP), _IP), lambda h: h["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(found(text.rlike(_CARD), _CARD), lambda h: luhn(h["value"])),
        "phone": F.filter(found(text.contains("+"), _PHONE), lambda h: count(h).between(8, 15)),
    }


def find(docs: DataFrame, label: str = "personal") -> DataFrame:
    """row_key, doc_id, the hits of each kind with their surroundings, and `base`, the spans by kind and start."""
    hits = base_hits(F.col("text"), AROUND)
    frame = keyed(docs.select("doc_id", "text")).select("row_key", "doc_id", *[c.alias(k) for k, c in hits.items()])
    return settle(frame.withColumn("base", F.concat(*[as_spans(F.col(k), r, k) for r, k in enumerate(KINDS)])), label)


def contexts(found: DataFrame) -> DataFrame:
    """One row for each word beside a base span that is not itself in a base span."""
    sides = F.array(
        F.struct(F.col("hit.before").alias("side"), (F.col("hit.start") - F.char_length("hit.before")).alias("at"), (F.char_length("hit.before") < AROUND).alias("whole")),
        F.struct(F.col("hit.after").alias("side"), F.col("hit.end").alias("at"), F.lit(True).alias("whole")))
    def of_kind(kind: str) -> Column:
        return F.transform(F.col(kind), lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("hit")))

    hits = F.concat(*[of_kind(k) for k in KINDS])
    rows = found.where(F.size("base") > 0).select("row_key", "base", F.explode(hits).alias("h")).select("row_key", "base", "h.kind", "h.hit")
    rows = rows.select("row_key", "base", "kind", F.xxhash64("hit.before", "hit.after").alias("context"), F.explode(sides).alias("s"))
    words = rows.select("row_key", "base", "kind", "context", "s.at", "s.whole", F.explode(located(F.col("s.side"), _WORD)).alias("w"))
    # a word at the cut edge of the surroundings may be the end of a longer one
    words = words.where(F.col("whole") | (F.col("w.start") > 0))
    words = words.select("row_key", "base", "kind", "context", F.lower("w.value").alias("term"),
                         (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"))
    return words.where(~overlaps(F.col("base"), F.col("start"), F.col("end")))


def least_share(together: Column, uses: Column) -> Column:
    """The lower end of the Wilson interval of together / uses."""
    n = F.greatest(uses, together)
    p = together / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def disclosure(docs: DataFrame, words: DataFrame) -> DataFrame:
    """term, kind and the share of the kind's information that the term discloses, for terms with enough evidence."""
    once = words.select("term", "kind", "context").distinct()
    beside = once.groupBy("term", "kind").agg(F.count("*").alias("together"))
    kinds = words.select("kind", "context").distinct().groupBy("kind").agg(F.count("*").alias("contexts"))
    corpus = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("term"))
    counts = settle(corpus.groupBy("term").agg(F.count("*").alias("n")), "words")
    # `kinds` has one row for each kind
    table = beside.join(counts, "term").where((F.col("together") >= SUPPORT) | (least_share(F.col("together"), F.col("n")) >= HALF))
    table = table.join(F.broadcast(kinds), "kind").withColumn("total", counts.agg(F.sum("n")).scalar())
    pieces = F.greatest(F.col("total") / CONTEXT_WORDS, F.col("contexts") + 1)
    p_term = F.least(F.greatest(F.col("n"), F.col("together")) / pieces, F.lit(1.0))
    pmi = F.log2(F.col("together") / F.col("contexts") / p_term)
    return table.select("term", "kind", (pmi / -F.log2(F.col("contexts") / pieces)).alias("share"))


def sanitise(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, base and added spans of every row; both arrays are ordered by kind and start."""
    found = find(docs)
    words = settle(contexts(found), "beside")
    revealing = disclosure(docs, words).where(F.col("share") >= GENERALISE)
    flagged = words.join(revealing, ["term", "kind"]).groupBy("row_key", "start", "end").agg(F.max("share").alias("share"))
    strong = F.col("share") >= REMOVE
    span = F.struct(F.when(strong, len(KINDS) + 1).otherwise(len(KINDS)).alias("rank"),
                    F.when(strong, F.lit(ADDED[1])).otherwise(F.lit(ADDED[0])).alias("kind"), "start", "end")
    added = flagged.groupBy("row_key").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("added"))
    return found.select("row_key", "doc_id", "base").join(added, "row_key", "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN)))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data as <kind>, revealing words generalised to <term> or removed; all other columns stay.

    A null text becomes an empty one.
    """
    spans = sanitise(docs).select("row_key", F.concat("base", "added").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["row_key"])
    placeholder = lambda kind: F.when(kind == ADDED[1], "").when(kind == ADDED[0], "<term>").otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(rest)])  # no name of theirs meets one of ours
    joined = keyed(docs.select("doc_id", "text", held.alias("rest"))).join(spans, "row_key", "left")
    text = F.when(F.col("spans").isNotNull(), redacted(F.col("text"), F.col("spans"), placeholder)).otherwise(F.col("text"))
    back = {"doc_id": F.col("doc_id"), "text": text.alias("text"), **{c: F.col(f"rest.c{n}").alias(c) for n, c in enumerate(rest)}}
    return joined.select(*[back[c] for c in docs.columns])
