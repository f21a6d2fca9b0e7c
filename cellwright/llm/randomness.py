"""Secrets: fixed forms, and tokens that a battery of randomness tests cannot tell from random.

Base spans are assignments to secret-like names, access keys and long hexadecimal runs (BASE). Further candidates
are runs of at least LEAST base64-like characters outside them; '=' ends a run, and only padding at its end belongs to
it. A run that fits no alphabet, since it mixes signs, is tested in parts of at least LEAST: cut at the signs
of one pair, of the other, and of both, each part with its own place; spans of parts may overlap. The alphabet of each is inferred (decimal, hex,
base32, base62, base64); under it three tests ask whether the characters are random: chi-squared uniformity over
the alphabet, runs above and below its middle, and serial correlation. Their statistics are combined into one
p-value against randomness. A token is left out only if its p-value is below the floor of its length (BANDS),
whatever else the corpus holds: about twice the floor is the share of truly random tokens that is lost; all others become spans. Their kind is
a grade: within each alphabet and band of length the Benjamini-Hochberg rule rejects the ordinary tokens; what it
does not reject is `random`, what it rejects above the floor is `possible`.

The rule needs only how many p-values lie in each of BINS bins, so the table of limits is of fixed size. All steps
are built-in expressions. A null or empty text has no spans; rows alike in id and text have the same spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.llm.spans import HIT, SPAN, as_spans, by_start, keyed, located, overlaps
from cellwright.session import settle

KINDS = ["assign", "access", "hex"]
LEAST = 20
BINS = 160
#: Lengths from which a band begins, the level of the rule that grades in it, and the p-value below which a token is left out.
BANDS = [(0, 0.30, 0.01), (32, 0.20, 0.01), (48, 0.10, 0.005), (96, 0.05, 0.002)]
ADDED = ["random", "possible"]

# The base forms and the alphabets in the order of their codes.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
_ACCESS = r"AKIA[A-Z0-9]++"
_HEX = r"[0-9a-f]{16,}+"
def _run(signs: str) -> str:
    """Letters, digits and signs with padding; the lookahead passes by what is too short. Matches may be shorter than LEAST."""
    return r"(?=[A-Za-z0-9=%s]{%d})[A-Za-z0-9%s]++(?:=++(?![A-Za-z0-9%s]))?+" % (signs, LEAST, signs, signs)


_TOKEN, _PARTS = _run("+/_-"), [_run("+/"), _run("_-"), _run("")]
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "decimal": ("[0-9]", _DIGITS), "hex": ("[0-9a-f]", _DIGITS + "abcdef"), "hex_upper": ("[0-9A-F]", _DIGITS + "ABCDEF"),
    "base32": ("(?=.*[2-7])[A-Z2-7]", _UPPER + "234567"), "base62": ("[A-Za-z0-9]", _UPPER + _LOWER + _DIGITS),
    "base64": ("[A-Za-z0-9+/]", _UPPER + _LOWER + _DIGITS + "+/"), "base64_url": ("[A-Za-z0-9_-]", _UPPER + _LOWER + _DIGITS + "-_"),
}


def base_spans(text: Column) -> dict[str, Column]:
    def found(gate: Column, pattern: str) -> Column:
        return F.when(gate, located(text, pattern)).otherwise(F.array().cast(HIT))

    return {
        "assign": F.filter(found(text.rlike(_ASSIGN), _ASSIGN), lambda h: F.char_length(F.regexp_extract(h["value"], _ASSIGN, 1)) >= 12),
        "access": F.filter(found(text.contains("AKIA"), _ACCESS), lambda h: F.char_length(h["value"]) >= 18),
        "hex": found(text.rlike(_HEX), _HEX),
    }


def find(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, `base` spans by start and kind, and the runs of token characters."""
    text = F.col("text")
    spans = [as_spans(c, r, k) for r, (k, c) in enumerate(base_spans(text).items())]
    tokens = F.when(text.rlike(_TOKEN), located(text, _TOKEN)).otherwise(F.array().cast(HIT))
    long = F.filter(tokens, lambda t: F.char_length(t["value"]) >= LEAST)
    rows = keyed(docs.select("doc_id", "text")).select("row_key", "doc_id", by_start(F.concat(*spans)).alias("base"), long.alias("tokens"))
    return settle(rows.withColumn("tokens", F.transform("tokens", lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value")))), "secrets")


def candidates(found: DataFrame) -> DataFrame:
    """row_key, start, end and value of the runs, and of the parts of those that fit no alphabet, outside the base spans."""
    tokens = found.where(F.size("tokens") > 0).select("row_key", "base", F.explode("tokens").alias("t")).select("row_key", "base", "t.start", "t.end", "t.value")
    body, fits = F.regexp_replace("value", "=+$", ""), F.lit(False)
    for pattern, _ in ALPHABETS.values():
        fits = fits | body.rlike(f"^{pattern}+$")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length("value").alias("end"), F.col("value").alias("value")))
    parts = F.array_distinct(F.concat(*[F.transform(located(F.col("value"), p), lambda h: F.struct(h["start"], h["end"], h["value"])) for p in _PARTS]))
    rows = tokens.select("row_key", "base", F.col("start").alias("at"), F.explode(F.when(fits, whole).otherwise(parts)).alias("p"))
    rows = rows.select("row_key", "base", (F.col("at") + F.col("p.start")).alias("start"), (F.col("at") + F.col("p.end")).alias("end"), F.col("p.value").alias("value"))
    return rows.where((F.char_length("value") >= LEAST) & ~overlaps(F.col("base"), F.col("start"), F.col("end"))).drop("base")


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, as a logistic curve of a cubic."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.070565 * z * z * z, F.lit(700.0))))


def tested(tokens: DataFrame) -> DataFrame:
    """`value` with its alphabet, length, three statistics and combined p-value; tokens of no alphabet are left out."""
    body = F.regexp_replace("value", "=+$", "")
    name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, (pattern, alphabet) in reversed(ALPHABETS.items()):
        fits = body.rlike(f"^{pattern}+$")
        name, letters = F.when(fits, F.lit(key)).otherwise(name), F.when(fits, F.lit(alphabet)).otherwise(letters)
    rows = tokens.withColumn("body", body).withColumn("alphabet", name).withColumn("letters", letters).where(F.col("letters").isNotNull() & (F.char_length("body") >= 2))
    codes = F.transform(F.filter(F.split("body", ""), lambda c: c != ""), lambda c: F.instr(F.col("letters"), c) - 1)
    rows = rows.withColumn("codes", codes).withColumn("n", F.size("codes").cast("double")).withColumn("a", F.char_length("letters").cast("double"))
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda s, x: s + f(x))
    counts = F.transform(F.array_distinct("codes"), lambda c: F.size(F.filter("codes", lambda x: x == c)).cast("double"))
    rows = rows.withColumn("squares", total(counts, lambda x: x * x)).withColumn("mean", total(F.col("codes"), lambda x: x) / F.col("n"))
    n, a = F.col("n"), F.col("a")
    chi = (a / n * F.col("squares") - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    high = F.transform("codes", lambda c: (2 * c >= a).cast("int"))
    rows = rows.withColumn("high", high).withColumn("up", total(F.col("high"), lambda x: x))
    turns = total(F.transform(F.sequence(F.lit(1), F.size("high") - 1), lambda i: (F.get("high", i) != F.get("high", i - 1)).cast("int")), lambda x: x)
    two = 2 * F.col("up") * (n - F.col("up"))
    spread = two * (two - n) / (n * n * (n - 1))
    # all on one side of the middle: as unlikely as the same coin n times
    runs = F.when(spread > 0, (turns - two / n) / F.sqrt(spread)).otherwise(F.sqrt(n))
    away = F.transform("codes", lambda c: c - F.col("mean"))
    rows = rows.withColumn("turn", runs).withColumn("chi", chi).withColumn("away", away)
    power = total(F.col("away"), lambda x: x * x)
    lagged = total(F.transform(F.sequence(F.lit(1), F.size("away") - 1), lambda i: F.get("away", i) * F.get("away", i - 1)), lambda x: x)
    serial = F.when(power > 0, (lagged / power + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    rows = rows.withColumn("serial", serial)
    s = F.pow(F.greatest("chi", F.lit(0.0)), 2) + F.pow("turn", 2) + F.pow("serial", 2)
    p = _tail((F.cbrt(s / 3) - (1 - 2 / 27)) / (2 / 27) ** 0.5)  # cube-root form of chi-squared with three degrees
    return rows.withColumn("p", p).drop("body", "letters", "codes", "squares", "mean", "high", "up", "away", "a")


def _band(n: Column) -> tuple[Column, Column, Column]:
    band, level, floor = F.lit(0), F.lit(BANDS[0][1]), F.lit(BANDS[0][2])
    for k, (least, q, lowest) in enumerate(BANDS[1:], 1):
        band, level, floor = (F.when(n >= least, F.lit(x)).otherwise(y) for x, y in ((k, band), (q, level), (lowest, floor)))
    return band, level, floor


def random_tokens(tokens: DataFrame) -> DataFrame:
    """The tokens above the floor of their length, with `grade`: does the rule reject them as ordinary?"""
    # written, so that the limits and the filter read the p-values instead of working them out again
    rows = settle(tested(tokens).select(*tokens.columns, "alphabet", "n", "p"), "tested")
    band, level, floor = _band(F.col("n"))
    rows = rows.withColumn("band", band).withColumn("level", level).withColumn("floor", floor)
    rows = rows.withColumn("bin", F.least(F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-300)))), F.lit(BINS)).cast("int"))
    counts = rows.groupBy("alphabet", "band", "level", "bin").agg(F.count("*").alias("many"))
    # from here to the limits: at most len(ALPHABETS) * len(BANDS) * BINS rows
    group = Window.partitionBy("alphabet", "band")
    below = F.sum("many").over(group.orderBy(F.desc("bin")))  # p-values at most as large as the upper edge of the bin
    edge = F.pow(F.lit(10.0), -F.col("bin") / 10.0)
    limits = counts.select("alphabet", "band", "bin", (edge <= F.col("level") * below / F.sum("many").over(group)).alias("rejects"))
    limits = limits.groupBy("alphabet", "band").agg(F.min(F.when(F.col("rejects"), F.col("bin"))).alias("from_bin"))
    kept = rows.where(F.col("p") >= F.col("floor")).join(F.broadcast(limits), ["alphabet", "band"])
    rejected = F.col("bin") >= F.coalesce("from_bin", F.lit(BINS + 1))
    return kept.withColumn("grade", F.when(rejected, F.lit(ADDED[1])).otherwise(F.lit(ADDED[0])))


def scan(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, base spans and added spans of every row, each ordered by start and kind."""
    found = find(docs)
    span = F.struct(F.lit(len(KINDS)).alias("rank"), F.col("grade").alias("kind"), F.col("start"), F.col("end"))
    added = random_tokens(settle(candidates(found), "tokens")).groupBy("row_key").agg(by_start(F.collect_set(span)).cast(SPAN).alias("added"))
    return found.select("row_key", "doc_id", "base").join(added, "row_key", "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN)))
