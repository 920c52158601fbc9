"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import variants as V

SCHEMA = "doc_id long, text string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def one_apart(a, b):
    """Whether one inserted, deleted or replaced code point leads from a to b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, min_n):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-z\u00c0-\u00ff]+", lower(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 97 == 0 else run
            counts[word] += len(word) >= 5
    counts = {w: n for w, n in counts.items() if n >= min_n}
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_by_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(V.op12_spelling_variants(spark, "/root/testdata/sf0.001")) == expected(rows, 3)


def test_odd_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcàÀ×", k=rng.randrange(5, 8))) for _ in range(60)]
    rows = [(rng.choice([None, 1, 2]), " ".join(rng.choices(words, k=40)) + rng.choice(["", ".", "1ABCDEé", "\n"])) for _ in range(60)]
    rows += [(3, None), (None, None), (4, ""), (5, "abcde" * 1000), (5, "abcde" * 1000)]
    # Anagrams, runs of one letter, and chains of forms.
    rows += [(6, " ".join(["abcab", "bacab", "aabbc"] * 3 + ["aaaaa", "aaaaaa", "aaaaaaa"] * 3))]
    rows += [(7, " ".join(["chain"] * 16 + ["chainx"] * 8 + ["chainxy"] * 4 + ["chainxyz"] * 2))]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("word", "n", "key", "letter", "form")})
    counts = V.runs_damaged(table).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    out = got(V.group_variants(counts))
    assert out == expected(rows, 2)
    assert ("chainxyz", "chainxy", "chain", 2, 1, 4) in out
    assert V.group_variants(counts.limit(0)).isEmpty()


def test_keys(spark):
    row = spark.range(1).select(V.anagram_key(F.lit("abÿ")).alias("k"), V.anagram_key(F.lit("ÿba")).alias("r"), V.anagram_key(F.lit("")).alias("e"), V.places(F.lit("banana"), F.lit("a")).alias("p"), V.without(F.lit("abc"), F.lit(1)).alias("w"))
    assert tuple(row.first()) == (97**5 + 98**5 + 255**5, 97**5 + 98**5 + 255**5, 0, [2, 4, 6], "bc")


def test_anagrams_do_not_meet_each_other(spark):
    """Many words with the same letters: nothing pairs them but the letters' order."""
    rng = random.Random(5)
    words = sorted({"".join(rng.sample("abcdefghij", 10)) for _ in range(4000)})
    near = V.near_words(spark.createDataFrame([(w,) for w in [*words, words[0][:-1]]], "word string"))
    assert near.count() == 2
