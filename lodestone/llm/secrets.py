"""Secret scans: patterns, and a battery of randomness tests on long tokens.

Only DataFrame functions are used.  Base spans come from three patterns.  Other
spans are runs of key-like characters that look random:

* the encoding is inferred from the characters (hexadecimal, letters of one case,
  base32, base36, base64), which gives the alphabet;
* three tests ask whether the run could be uniform over that alphabet: chi-squared
  uniformity of the letters, the number of runs above and below the middle of the
  alphabet, and the serial correlation of neighbours; Fisher's rule combines them,
  and a run stays only if they do not reject it at `alpha`;
* how likely the run is as ordinary text is the other question.  Its likelihood
  ratio (uniform over the alphabet against the letter frequencies of text) is an
  e-value: it grows with the length of the run, so that short runs cannot pass by
  luck.  The e-Benjamini-Hochberg rule over all runs of the table keeps the
  expected share of false discoveries at `q` or less, whatever their dependence.

Defined cases: a null text has no spans; repeated rows each come out; an empty
table gives no rows; equal texts have equal spans within a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, materialise

# The patterns of the contract.  A longer minimum stands for the
# length filter where a match is a whole run of its class.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs of key-like characters; possessive, and not begun inside a run.
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, LONG)))
MIN_VALUE = 6

# Letters of English text in per cent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Shares of small letters, capitals, digits and signs in ordinary long tokens.
SMALL, CAPITAL, DIGIT, SIGN = 0.90, 0.05, 0.04, 0.01
#: Alphabets in the order that gives a letter its number.
ALPHABETS = {"hex": "0123456789abcdef", "letters": LOWER, "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
LEAST, MOST = -50, 400


def upper_normal(z: Column) -> Column:
    """Upper tail of the normal distribution, to 0.3 % at any z: a rational fit up to 4, the asymptotic series beyond."""
    a = F.least(F.abs(z), F.lit(37.0))
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + 0.2316419 * a)
    # The coefficients of the classical fit.
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    r = 1 / F.greatest(a * a, F.lit(1.0))
    far = density / F.greatest(a, F.lit(1.0)) * (1 - r * (1 - r * (3 - r * (15 - r * 105))))
    tail = F.when(a <= 4, near).otherwise(far)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _bound(value: Column, body) -> Column:
    """`body` of a value that is computed once: inside a lambda function nothing else keeps an expression from being evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encoding(run: Column) -> Column:
    """The name of the alphabet that a run's characters point to, null for digits only and for words in ordinary case."""
    return (
        F.when(run.rlike("^[0-9]+$") | ~run.rlike("[0-9]|[a-z][A-Z]|^[a-z]+$|^[A-Z]+$"), F.lit(None))
        .when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(run.rlike("^([a-z]+|[A-Z]+)$"), "letters")
        .when(run.rlike("^[A-Z2-7]+$"), "base32")
        .when(run.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .otherwise("base64")
    )


def battery(s: Column) -> Column:
    """Struct of the three statistics (uniform, runs, serial: each about standard normal for a random run) and Fisher's combined p-value.

    `s` holds text, alphabet, n and k (the lengths of both), and x, the letters' numbers.  Every pass is linear in the run.
    """
    text, alphabet, x, n, k = s["text"], s["alphabet"], s["x"], s["n"], s["k"]
    pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda t, v: t + f(v))
    # A pass over the run for each letter of the alphabet, 64 at most: the squares of the counts.
    squares = total(F.split(alphabet, ""), lambda c: F.pow((n - F.length(F.replace(text, c, F.lit("")))).cast("double"), F.lit(2.0)))
    df = k - 1
    uniform = (F.pow((k / n * squares - n) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    changes = total(pairs, lambda p: F.when((p["a"] >= k / 2) != (p["b"] >= k / 2), 1.0).otherwise(0.0))
    runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    mean = (k - 1) / 2
    serial = total(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)) / ((k * k - 1) / 12) / F.sqrt(n - 1)

    def fisher(z: Column) -> Column:
        p = [upper_normal(z["uniform"]), 2 * upper_normal(F.abs(z["runs"])), 2 * upper_normal(F.abs(z["serial"]))]
        half = -sum(F.log(F.greatest(F.least(v, F.lit(1.0)), F.lit(1e-300))) for v in p)
        joined = _bound(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))
        return F.struct(z["uniform"].alias("uniform"), z["runs"].alias("runs"), z["serial"].alias("serial"), joined.alias("p"))

    return _bound(F.struct(uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial")), fisher)


def tested(run: Column) -> Column:
    """Struct of name (the encoding), uniform, runs, serial, p, and e: the log of the e-value; null for a run without an encoding."""
    logs = [SMALL * f / 100 for f in LETTERS] + [CAPITAL * f / 100 for f in LETTERS] + [DIGIT / 10] * 10 + [SIGN / 2] * 2
    order = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    share = F.create_map(*[F.lit(v) for c, f in zip(order, logs) for v in (c, math.log(f))])
    alphabets = F.create_map(*[F.lit(v) for kv in ALPHABETS.items() for v in kv])

    def named(s: Column) -> Column:
        folded = F.when(s["name"].isin("hex", "letters", "base36"), F.lower(s["plain"])).otherwise(s["plain"])
        # Words in capitals are ordinary too: the case of a run of one case says nothing.
        judged = F.when(s["name"] == "letters", F.lower(s["plain"])).otherwise(s["plain"])
        return F.struct(s["name"].alias("name"), folded.alias("text"), judged.alias("judged"), alphabets[s["name"]].alias("alphabet"))

    def numbered(s: Column) -> Column:
        x = F.transform(F.split(s["text"], ""), lambda c: F.instr(s["alphabet"], c).cast("double") - 1)
        n, k = F.length(s["text"]).cast("double"), F.length(s["alphabet"]).cast("double")
        return F.struct(s["name"].alias("name"), s["text"].alias("text"), s["judged"].alias("judged"), s["alphabet"].alias("alphabet"), x.alias("x"), n.alias("n"), k.alias("k"))

    def scored(s: Column) -> Column:
        plain = F.aggregate(F.split(s["judged"], ""), F.lit(0.0), lambda t, c: t + share[c])
        return F.struct(s["name"].alias("name"), battery(s).alias("z"), (-plain - s["n"] * F.log(s["k"])).alias("e"))

    first = F.struct(encoding(run).alias("name"), F.translate(run, "-_", "+/").alias("plain"))
    return _bound(first, lambda s: F.when(s["name"].isNotNull(), _bound(_bound(_bound(s, named), numbered), scored)))


def evidence(run: Column, alpha: float) -> Column:
    """Log of the e-value of a run that may be random, null for one that is not."""
    return _bound(tested(run), lambda s: F.when(s["z"]["p"] >= alpha, s["e"]))


def hits(kind: str, text: Column) -> Column:
    """Matches of a kind in order: the code points before each since the last one, the match, and its value."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(1)) if kind == "assign" else found
    row = F.arrays_zip(F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(found)).alias("gap"), found.alias("hit"), value.alias("value"))
    rows = F.transform(row, lambda s: F.struct(F.lit(kind).alias("kind"), F.length(s["gap"]).alias("gap"), F.length(s["hit"]).alias("len"), s["value"].alias("value")))
    return F.when(text.rlike(PATTERNS[kind]), F.transform(rows, lambda s, i: F.struct(i.alias("i"), s.alias("s"))))


def candidates(docs: DataFrame, alpha: float = 1e-3) -> DataFrame:
    """(doc_id, row, kind, start, end, e): every base span and every run that passes the battery; one row with a null kind for other texts."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<i:int,s:struct<kind:string,gap:int,len:int,value:string>>>")
    spans = F.concat(*[F.coalesce(hits(k, F.col("text")), none) for k in KINDS])
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    rows = rows.select("doc_id", "row", F.explode_outer(spans).alias("h")).select("doc_id", "row", F.col("h.i").alias("i"), "h.s.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.withColumn("e", F.when(F.col("kind") == "random", evidence(F.col("value"), alpha)))
    good = F.when(F.col("kind") == "assign", F.length("value") >= MIN_VALUE).when(F.col("kind") == "random", F.col("e").isNotNull()).otherwise(F.lit(True))
    # A text keeps a row: its first hit stays, without its kind if it is not good.
    return rows.select("doc_id", "row", F.when(good, F.col("kind")).alias("kind"), "start", "end", F.when(good, F.col("e")).alias("e"), F.coalesce(F.col("kind") == "random", F.lit(False)).alias("tested"))


def threshold(found: DataFrame, q: float = 0.01) -> float:
    """The least log e-value that the e-Benjamini-Hochberg rule accepts (infinite: none).

    `found` has columns tested and e.  Steps of one in the logarithm make at most 451 rows of counts.
    """
    step = F.greatest(F.least(F.floor("e"), F.lit(MOST)), F.lit(LEAST)).alias("step")
    counts = found.where("tested").groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect()
    tests, passed, best = sum(r["n"] for r in counts), 0, math.inf
    for r in sorted((r for r in counts if r["step"] is not None), key=lambda r: -r["step"]):
        passed += r["n"]
        if r["step"] >= math.log(tests / (q * passed)):
            best = float(r["step"])
    return best


def spans(docs: DataFrame, alpha: float = 1e-3, q: float = 0.01) -> DataFrame:
    """(doc_id, row, spans): kind, start and end of all spans of a text, by start, then kind.

    A run that overlaps a base span adds nothing and is left out.
    """
    found = materialise(candidates(docs, alpha), "secrets")
    least = threshold(found, q)
    found = found.withColumn("kind", F.when((F.col("kind") != "random") | (F.col("e") >= least), F.col("kind")))
    base = F.col("kind") != "random"
    order = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), "end")
    ended = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = found.withColumn("over", F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False)))
    number = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull() & (base | ~F.col("over")), F.struct("start", number.alias("number"), "end", "kind"))
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans")).select("doc_id", "row", "spans")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and digests over whole `documents`."""
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), count("random"))


MASK = "<REDACTED>"


def redact(docs: DataFrame, alpha: float = 1e-3, q: float = 0.01) -> DataFrame:
    """`docs` with every secret of its texts replaced by a mask, and n_chars set anew where it is a column.

    A text is rewritten in its own row, kind after kind; no text moves.
    """
    least = threshold(candidates(docs, alpha), q)

    def masked(kind: str, text: Column) -> Column:
        pattern = F.lit(PATTERNS[kind])
        found = F.regexp_extract_all(text, pattern, F.lit(0))
        value = F.regexp_extract_all(text, pattern, F.lit(1)) if kind == "assign" else found
        good = {"assign": lambda v: F.length(v) >= MIN_VALUE, "random": lambda v: F.coalesce(evidence(v, alpha) >= least, F.lit(False))}.get(kind, lambda v: F.lit(True))
        new = F.zip_with(found, value, lambda h, v: F.when(good(v), F.concat(F.substr(h, F.lit(1), F.length(h) - F.length(v)), F.lit(MASK))).otherwise(h))
        parts = F.zip_with(F.split(text, PATTERNS[kind], -1), new, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
        return F.when(text.rlike(PATTERNS[kind]), F.array_join(parts, "")).otherwise(text)

    out = docs
    for kind in KINDS:
        out = out.withColumn("text", masked(kind, F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
