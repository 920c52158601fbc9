"""URL filters: a list of rules, and association rules mined by FP-growth for the urls that no rule fits.

Only DataFrame functions and Spark's own FP-growth are used.

* Listed rules have a host, the beginning of a path and a verdict.  A rule fits its
  host and all subdomains if the url's path starts with the rule's; the longest rule
  wins, of equally long ones the least.  Urls meet the rules by the suffixes of
  their hosts.
* Mined rules: tokens of labelled urls (scheme, host suffixes, host labels, path
  segments, their file ending, query fields, fragment) go through FP-growth together
  with the url's verdict as one more item.  Tokens that stand in the same urls are
  one item, so that a long shared path does not give a rule for each subset of it.
  A rule stays if its support and its confidence suffice and no rule with one
  condition less is as confident; what is dropped so could never win.
* An inverted index files each mined rule under its rarest item.  A url takes the
  rule of the highest confidence (then support, then the least text) of those whose
  items it has all; where none fits, the default.

In the query the labelled urls are those that the listed rules judge, so that the
method carries their verdicts over to urls that they do not reach.

Defined cases: a null url or one without `://` has an empty host and path, no
tokens but those it has, and takes the default unless a mined rule fits; repeated rows each
come out; without labelled urls no rule is mined; an empty table gives no rows;
of the pages only id and url are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

# The rules of the contract, as (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
VERDICTS = ("allow", "block")
MINED = "asked array<string>, item string, verdict string, confidence double, support double"
#: Marks the item that is a url's verdict; tokens begin with other letters.
VERDICT = "verdict "


def host_and_path(url: Column) -> list[Column]:
    """host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return [F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path")]


def suffixes(host: Column) -> Column:
    """The host and the domains that it is under."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What mined rules may ask of a url, each token once."""
    labels = F.split(host, r"\.", -1)
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    marked = lambda mark, values: F.transform(values, lambda x: F.concat(F.lit(mark), x))
    one = lambda mark, value: F.when(value != "", F.array(F.concat(F.lit(mark), value))).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        one("scheme ", F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), marked("domain ", suffixes(host)), marked("label ", labels), marked("path ", parts),
        one("ending ", F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), marked("field ", F.filter(F.split(query, "&", -1), lambda x: x != "")), one("part ", F.regexp_extract(url, r"#(.*)$", 1)),
    )
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def distinct_urls(rows: DataFrame) -> DataFrame:
    """(url, host, path, tokens), each url once."""
    url = rows.select("url").distinct()
    return url.select("url", *host_and_path(F.col("url"))).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))


def listed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the urls that a row (host, path, verdict) of `rules` fits."""
    at = urls.select("url", "path", F.explode(suffixes(F.col("host"))).alias("_host"))
    known = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "verdict")
    met = at.join(known, "_host").where(F.startswith("path", "_path")).withColumn("rule", F.concat("_host", "_path"))
    best = met.groupBy("url").agg(F.min(F.struct((-F.length("rule")).alias("least"), "rule", "verdict")).alias("best"))
    return best.select("url", "best.rule", "best.verdict")


def _items(labelled: DataFrame) -> DataFrame:
    """(token, item): tokens of rows (tokens, verdict); those that stand in the same rows share the item of the least of them.

    Rows are told apart by a hash of their tokens; two sums of hashes and a count stand for the set of a token's rows.
    """
    seed = lambda k: F.xxhash64("tokens", "verdict", F.lit(k)).bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(38,0)")
    rows = labelled.select(F.explode("tokens").alias("token"), seed(1).alias("a"), seed(2).alias("b"))
    sets = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    least = sets.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return sets.join(least, ["n", "a", "b"]).select("token", "item", "n")


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Items (token, item, n) of rows (tokens, verdict), and rules (asked, item, verdict, confidence, support): the items asked, the rarest of them, and figures."""
    spark = labelled.sparkSession
    # Written before it is read again, so the numbers of rows stay.
    labelled = materialise(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"), "labelled")
    total = labelled.count()
    # Items below the support are in no rule; there are at most tokens a url / support of the others.
    items = materialise(_items(labelled).where(F.col("n") >= F.ceil(F.lit(total) * min_support)), "items")
    kept = labelled.select("row", "verdict", F.explode("tokens").alias("token")).join(items.where("token = item").select("token"), "token")
    baskets = materialise(kept.groupBy("row", "verdict").agg(F.collect_set("token").alias("ts")).select(F.concat("ts", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items")), "baskets")
    n = baskets.count()
    if not n:
        return items, spark.createDataFrame([], MINED)
    # The support is that over all labelled rows; rows without any item left are in no basket.
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * total / n), minConfidence=min_confidence).fit(baskets).associationRules
    verdict = F.get("consequent", F.lit(0))
    rules = found.where(F.startswith(verdict, F.lit(VERDICT)) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(VERDICT))))
    rules = materialise(rules.select(F.array_sort("antecedent").alias("asked"), F.substr(verdict, F.lit(len(VERDICT) + 1)).alias("verdict"), F.round("confidence", 9).alias("confidence"), F.round(F.col("support") * n / total, 9).alias("support")), "mined")
    # A rule with one condition less that is as confident has at least its support: this one can never win.
    less = rules.where(F.size("asked") > 1).select("asked", "verdict", "confidence", F.explode("asked").alias("_x")).withColumn("_less", F.array_remove(F.col("asked"), F.col("_x")))
    wider = rules.select(F.col("asked").alias("_less"), "verdict", F.col("confidence").alias("_c"))
    beaten = less.join(wider, ["_less", "verdict"]).where("_c >= confidence").select("asked", "verdict").distinct()
    rules = rules.join(beaten, ["asked", "verdict"], "left_anti")
    counts = items.where("token = item").select("item", "n")
    rare = rules.select("*", F.explode("asked").alias("item")).join(counts, "item").groupBy("asked", "verdict", "confidence", "support").agg(F.min(F.struct("n", "item")).alias("r"))
    return items, materialise(rare.select("asked", "r.item", "verdict", "confidence", "support"), "rules")


def apply_mined(urls: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined, confidence, evidence): the verdict of the best mined rule whose items the url has all; evidence are its own tokens."""
    held = urls.select("url", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token").groupBy("url", "item").agg(F.min("token").alias("token"))
    own = held.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("held"))
    met = own.select("url", "held", F.explode(F.map_keys("held")).alias("item")).join(rules, "item").where(F.forall("asked", lambda x: F.map_contains_key(F.col("held"), x)))
    evidence = F.array_join(F.transform("asked", lambda x: F.col("held")[x]), " & ")
    best = met.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), evidence.alias("evidence"), "verdict")).alias("b"))
    return best.select("url", F.col("b.verdict").alias("mined"), (-F.col("b.c")).alias("confidence"), "b.evidence")


def judge(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, min_support: float = 0.01, min_confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict, mined, confidence, evidence), one row for each distinct url of `pages`.

    `rules` has rows (host, path, verdict), `labelled` rows (url, verdict); without
    it the urls judged by the rules are the labelled ones.
    """
    urls = materialise(distinct_urls(pages), "urls")
    ruled = materialise(listed(urls, rules), "ruled")
    # A null url has no rule; its row meets nothing in these joins and is filled up below.
    known = ruled if labelled is None else labelled
    examples = (urls if labelled is None else distinct_urls(labelled)).select("url", "tokens").join(known.select("url", "verdict"), "url")
    mined = apply_mined(urls, *mine(examples, min_support, min_confidence))
    out = urls.join(ruled, "url", "left").join(mined, "url", "left")
    return out.select("url", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit(default)).alias("verdict"), "mined", "confidence", "evidence")


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Rules as a table, out of literals."""
    row = F.explode(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]))
    return spark.range(1).select(row.alias("r")).select("r.*")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `pages` with its host, path, rule, verdict and the mined rule that stands behind it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, rule_table(spark)).withColumnRenamed("url", "_url")
    met = pages.join(judged, F.col("url").eqNullSafe(F.col("_url")))
    return met.select("page_id", "host", "path", "rule", "verdict", "mined", "confidence", "evidence")
