"""Spelling variant grouping by anagram hashing.

Words are the maximal runs of Latin letters of all texts, some of them damaged by
a rule (see `runs_damaged`), counted over the whole table.  Two words are near if
they differ by one inserted, deleted or replaced code point:

* the anagram key of a word is the sum of the fifth powers of its code points, so
  that words with the same letters share a key whatever their order;
* keys are joined that differ by the value of one letter (added or removed) or by
  the values of two (exchanged): the keys less each of their letters meet the keys,
  and each other.  At most one class of words stands at a key for each letter of
  the alphabet, so what meets at a key is bounded by the alphabet, not by the data;
* letter order is verified inside the classes that met, by a join on the word
  without the letter in question and its place; no two words of a class are paired
  with each other just because they share a key.

A word's form is its near word of the largest count, if that is at least twice its
own.  Counts double along forms, so chains are short; roots are found by jumping.

Defined cases: a null text has no words; a null doc_id counts as an empty one in
the rule that damages runs; repeated rows count each time; ties of counts go to the
least word in code-point order; an empty table gives no rows; other columns of the
table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

# The letters of words, after A-Z are lower-cased, and the modulus of damaged runs.
RUN = "[a-zÀ-ÿ]+"
DAMAGED = 97
#: Keys are sums modulo this prime, so that no length of a word overflows them.
MODULUS = (1 << 61) - 1


def runs_damaged(docs: DataFrame, min_chars: int = 5) -> DataFrame:
    """(word): every run of letters of every text, the code point h % length taken out where DAMAGED divides h, the crc32 of `doc_id:run`."""
    run = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    # Runs only get shorter.
    run = run.where(F.length("run") >= min_chars)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    rows = run.select("run", h.alias("h"))
    return rows.select(F.when(F.col("h") % DAMAGED == 0, without(F.col("run"), F.col("h") % F.length("run") + 1)).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_chars)


def without(word: Column, place: Column) -> Column:
    """The word without the code point at a place, from 1."""
    return F.concat(F.substr(word, F.lit(1), (place - 1).cast("int")), F.substr(word, (place + 1).cast("int")))


def power(letter: Column) -> Column:
    """What a letter adds to a key."""
    c = F.ascii(letter).cast("bigint")
    return c * c * c * c * c


def anagram_key(word: Column) -> Column:
    """The sum of the powers of a word's letters, modulo MODULUS."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda s, c: (s + power(c)) % MODULUS)


def places(word: Column, letter: Column) -> Column:
    """The places of a letter in a word, from 1."""
    return F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.lit(1)) == letter)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near), both ways: the words of the column `word`, all different, that are one code point apart."""
    keyed = materialise(words.select("word", anagram_key(F.col("word")).alias("key")), "anagrams")
    letters = keyed.select("key", F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    less = materialise(letters.select("key", "letter", F.pmod(F.col("key") - power(F.col("letter")), F.lit(MODULUS)).alias("rest")), "anagrams-less")

    removed = less.join(keyed.select(F.col("key").alias("rest")).distinct(), "rest").select("key", "letter")
    cut = lambda at: without(F.col("word"), at).alias("rest")
    shorter = keyed.join(removed, "key").select("word", F.explode(places(F.col("word"), F.col("letter"))).alias("at")).select("word", cut(F.col("at"))).distinct()
    by_removal = shorter.join(keyed.select(F.col("word").alias("rest")), "rest").select("word", F.col("rest").alias("near"))

    other = less.select(F.col("key").alias("key2"), F.col("letter").alias("letter2"), "rest")
    exchanged = materialise(less.join(other, "rest").where("key < key2").select("key", "letter", "key2", "letter2"), "anagrams-exchanged")

    def masked(key: str, letter: str, name: str) -> DataFrame:
        """The words of one side of the exchanges, without the letter that is exchanged."""
        met = exchanged.join(keyed.select(F.col("key").alias(key), F.col("word").alias(name)), key)
        placed = met.select("key", "key2", name, F.explode(places(F.col(name), F.col(letter))).alias("at"))
        return placed.select("key", "key2", name, "at", without(F.col(name), F.col("at")).alias("rest"))

    sides = masked("key", "letter", "word").join(masked("key2", "letter2", "near"), ["key", "key2", "at", "rest"])
    one_way = by_removal.unionByName(sides.select("word", "near"))
    return one_way.unionByName(one_way.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form), one form a word and no circles: forms followed to the last, each round twice as far."""
    up = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        far = materialise(up.join(over, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        up = far.select("word", "root")
        if far.where("moved").isEmpty():
            return up


def group_variants(counts: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of rows (word, n), each word once; a form has `times` the count of its word at least (2 or more)."""
    near = near_words(counts.select("word"))
    found = near.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The largest count, then the least word.
    best = found.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("form"))).alias("best"))
    rows = counts.select("word", "n").join(best, "word", "left")
    fits = -F.col("best.least") >= F.col("n") * times
    rows = materialise(rows.select("word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.least")).alias("form_n")), "variants")
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 5 code points and 3 occurrences in whole `documents`, with their near words, forms and roots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = runs_damaged(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return group_variants(materialise(counts, "words"))


OP12_SQL = """
WITH RECURSIVE tb AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL
), d AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r WHERE length(run) >= 5 GROUP BY ALL
), h AS (
  SELECT run, n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM d, tb
), w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), c AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM w)
), e AS MATERIALIZED (
  SELECT c.word AS a, w.word AS b FROM c JOIN w ON c.less = w.word UNION SELECT w.word, c.word FROM c JOIN w ON c.less = w.word
  UNION SELECT x.word, y.word FROM c x JOIN c y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
), b AS (
  SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS best, max(n) AS best_n FROM e JOIN w ON w.word = e.b GROUP BY a
), f AS MATERIALIZED (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM w LEFT JOIN b ON b.a = w.word
), p(word, root) AS (
  SELECT word, word FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM f JOIN p ON p.word = f.word JOIN f AS g ON g.word = p.root WHERE g.form IS NULL
"""
