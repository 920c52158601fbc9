"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and beginnings of words (`STEMS` code points).  They are counted
over every labelled training document, and those that go with the label by a
likelihood-ratio test are the vocabulary, however many pass.  The cosine over all
terms was measured and is no substitute: most of a text is function words and
names, so its nearest examples share its language and not its tone (figures in the
README).  The labelled examples (a bounded sample of rows, `max_examples`) make an
inverted index in blocks of documents: each block keeps the largest weight of each
term, so that the sum of largest weights bounds every cosine in it.  Blocks are
searched from the highest bound down until the k-th best cosine reaches the next
bound: the neighbours are exact.  Neighbours vote by one over their distance.  A
text that has no term of the vocabulary, or that is far from all examples, leans
on the rate of the label among examples without terms.  Every example is scored
without itself, on the executors, and a logistic fit of those votes to the labels
calibrates the score.

Defined cases: a null or empty text has no term and gets the score of such
texts; several labels of a document count as toxic if one does; labels without a
document are ignored; without any training label every score is one half;
repeated rows each come out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, materialise, small_batches, table

FOLDS, HELD_OUT = 4, 2
STEMS = (4, 5, 6)
WORD = re.compile(r"\w+")
CUT = 0.3
#: Votes, in units of one over the distance, for what texts without terms are.
PRIOR = 2.0


def terms(text: str | None) -> dict[str, int]:
    """How often each term occurs: words in lower case, and their beginnings."""
    words: dict[str, int] = {}
    for w in WORD.findall((text or "").lower()):
        words[w] = words.get(w, 0) + 1
    out: dict[str, int] = {}
    for w, n in words.items():
        out[w] = out.get(w, 0) + n
        for k in STEMS:
            if len(w) > k:
                stem = w[:k] + "*"
                out[stem] = out.get(stem, 0) + n
    return out


def select_terms(train: DataFrame, n: int, n_toxic: int, g2: float = 16.0, purity: float = 0.6) -> pd.DataFrame:
    """(term, df): the terms whose documents go with the label, by a likelihood-ratio test over all training rows.

    At least `purity` of the documents with the term are toxic.  The test is at
    least as strict as `g2` and stricter the more terms there are, so that about
    as many pass by luck at any size.
    """

    def count(batches):
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                for t in terms(text):
                    seen.setdefault(t, [0, 0])[toxic] += 1
            yield pd.DataFrame({"term": np.array(list(seen), object), "clean": [c for c, _ in seen.values()], "bad": [b for _, b in seen.values()]})

    df = train.select("text", "toxic").mapInPandas(count, "term string, clean long, bad long").groupBy("term").agg(F.sum("clean").cast("double").alias("clean"), F.sum("bad").cast("double").alias("bad"))
    n_clean = n - n_toxic
    # Twice the log-likelihood ratio of the two-by-two table of a term against the label; it holds for small counts too.
    with_term = F.col("bad") + F.col("clean")
    cell = lambda o, row, column: F.when(o > 0, o * F.log(o * n / (row * column))).otherwise(0.0)
    stat = 2 * (cell(F.col("bad"), with_term, F.lit(n_toxic)) + cell(F.col("clean"), with_term, F.lit(n_clean)) + cell(n_toxic - F.col("bad"), n - with_term, F.lit(n_toxic)) + cell(n_clean - F.col("clean"), n - with_term, F.lit(n_clean)))
    more = (F.col("bad") >= purity * with_term) & (F.col("bad") * n_clean > F.col("clean") * n_toxic)
    asked = materialise(df.where(more).select("term", with_term.alias("df"), stat.alias("g2")), "terms")
    least = max(g2, 2 * math.log(max(asked.count(), 1) / 10))
    return asked.where(F.col("g2") >= least).select("term", "df").orderBy("term").toPandas()


def vector(counts: dict[str, int], places: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the vocabulary's terms in a text, of length one."""
    own = sorted((places[t], n) for t, n in counts.items() if t in places)
    at = np.array([p for p, _ in own], np.int32)
    w = (1 + np.log(np.array([n for _, n in own], float))) * idf[at] if own else np.zeros(0)
    return at, w / np.linalg.norm(w) if len(w) else w


class BlockMaxIndex:
    """An inverted index over example vectors, in blocks with the largest weight of each term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int, block: int = 64):
        # Examples with like terms share blocks, which makes the bounds tight.
        self.order = sorted(range(len(vectors)), key=lambda i: tuple(vectors[i][0][np.argsort(-vectors[i][1], kind="stable")][:3].tolist()))
        self.block, self.n = block, len(vectors)
        n_blocks = -(-self.n // block)
        rows, cols, weights = [], [], []
        for row, i in enumerate(self.order):
            at, w = vectors[i]
            rows.append(np.full(len(at), row))
            cols.append(at)
            weights.append(w)
        row, col, weight = (np.concatenate(x) if x else np.zeros(0) for x in (rows, cols, weights))
        row, col = row.astype(np.int64), col.astype(np.int64)
        # For each term the blocks that have it, with its largest weight there: as many entries as terms stand in blocks.
        place = col * max(n_blocks, 1) + row // block
        by = np.argsort(place, kind="stable")
        place, starts = np.unique(place[by], return_index=True)
        self.top = np.maximum.reduceat(weight[by], starts) if len(starts) else np.zeros(0)
        self.top_block, self.top_first = place % max(n_blocks, 1), np.searchsorted(place // max(n_blocks, 1), np.arange(size + 1))
        self.dense = np.zeros(size)
        by = np.lexsort((row, col, row // block))
        self.row, self.col, self.weight = row[by], col[by], weight[by]
        self.first = np.searchsorted(self.row // block, np.arange(n_blocks + 1))

    def search(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest, exactly; only those with a cosine above zero; ties by example."""
        if not len(at) or not self.n:
            return np.zeros(0, int), np.zeros(0)
        begin, n = self.top_first[at], self.top_first[at + 1] - self.top_first[at]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        # A little more than the sum, so that it stays a bound in whatever order it is added.
        bound = np.bincount(self.top_block[entry], np.repeat(w, n) * self.top[entry], len(self.first) - 1) * (1 + 1e-9)
        dense = self.dense
        dense[at] = w
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0]:
                break
            lo, own = b * self.block, slice(self.first[b], self.first[b + 1])
            score = np.bincount(self.row[own] - lo, self.weight[own] * dense[self.col[own]])
            best += [(float(score[r]), self.order[lo + r]) for r in np.flatnonzero(score > 0) if self.order[lo + r] != skip]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        dense[at] = 0.0
        return np.array([i for _, i in best], int), np.array([c for c, _ in best])


class Model:
    """Vocabulary, index, labels and the calibration of the vote."""

    def __init__(self, vocabulary: pd.DataFrame, n: int, examples: pd.DataFrame, without: tuple[int, int], k: int = 31):
        """examples: rows with at least one term; without: counts of the others by label."""
        self.places = {t: i for i, t in enumerate(vocabulary["term"])}
        self.idf = np.log((n + 1) / (vocabulary["df"].to_numpy(float) + 1)) + 1
        self.ids, self.toxic, self.k = examples["doc_id"].tolist(), examples["toxic"].to_numpy(float), k
        self.index = BlockMaxIndex([self.vector(t, c) for t, c in zip(examples["terms"], examples["counts"])], len(self.places))
        n_none = without[0] + without[1]
        self.none = (without[1] + 0.5) / (n_none + 1) if n_none or len(examples) else 0.5
        self.fit = np.array([1.0, 0.0])

    def vector(self, own: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return vector(dict(zip(own, counts)), self.places, self.idf)

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """A logistic fit of slope and offset of the votes to the labels, by Newton steps; one example's worth of a prior at (1, 0) keeps it finite."""
        if not len(votes):
            return
        votes = np.clip(votes, 1e-3, 1 - 1e-3)
        x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], 1)
        loss = lambda f: np.logaddexp(0, x @ f).sum() - toxic @ (x @ f) + 0.5 * ((f - [1, 0]) ** 2).sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ self.fit, -500, 500)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), x.T @ (toxic - p) - (self.fit - [1, 0]))
            size = 1.0
            while size > 1e-6 and loss(self.fit + size * step) > loss(self.fit):
                size /= 2
            self.fit = self.fit + size * step
            if np.abs(size * step).max() < 1e-9:
                break
        if self.fit[0] <= 0:  # votes that say nothing of the labels keep their order
            self.fit = np.array([1.0, 0.0])

    def vote(self, v: tuple[np.ndarray, np.ndarray], skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of toxic weight among the neighbours, and who they are; `PRIOR` votes stand for texts without terms."""
        who, cosine = self.index.search(*v, self.k, skip)
        w = cosine / (1.001 - np.minimum(cosine, 1.0))
        return (float(w @ self.toxic[who]) + PRIOR * self.none) / (w.sum() + PRIOR), who, cosine

    def score(self, text: str | None) -> tuple[float, list, list]:
        """The calibrated score of a text, and the examples that voted with their cosines."""
        v = vector(terms(text), self.places, self.idf)
        if not len(v[0]):
            return float(self.none), [], []
        vote, who, cosine = self.vote(v)
        vote = min(max(vote, 1e-3), 1 - 1e-3)
        return float(1 / (1 + math.exp(-(self.fit[0] * math.log(vote / (1 - vote)) + self.fit[1])))), [self.ids[i] for i in who], cosine.tolist()


#: Labels that may be sent to every executor.
SENT = 2_000_000


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """(doc_id, text, toxic) of every labelled document outside the held-out fold, and their counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # Texts stay where they are while the labels are few enough to send: an id and a number each, 50 MB at most.
    known = materialise(known, "labels")
    side = F.broadcast(known) if known.count() <= SENT else known
    rows = materialise(docs.select("doc_id", "text").join(side, "doc_id"), "labelled")
    counts = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    return rows, int(counts[0]), int(counts[1] or 0)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 40_000, k: int = 31) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, toxic), by the rows outside the held-out fold.

    Terms and their document frequencies come from all of them, neighbours from
    `max_examples` of them, chosen by a hash of the id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train, n, n_toxic = training_rows(docs, labels)
    vocabulary = select_terms(train, n, n_toxic)
    places = set(vocabulary["term"])
    sample = train.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) if n > max_examples else None
    chosen = train if sample is None else train.join(F.broadcast(sample), "doc_id")  # max_examples numbers

    def keep(batches):
        for pdf in batches:
            own = [{t: c for t, c in terms(x).items() if t in places} for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "terms": [list(x) for x in own], "counts": [list(x.values()) for x in own]})

    found = materialise(chosen.mapInPandas(keep, "doc_id long, toxic int, terms array<string>, counts array<long>"), "examples")
    empty = {int(r["toxic"]): int(r["n"]) for r in found.where(F.size("terms") == 0).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    examples = found.where(F.size("terms") > 0).orderBy("doc_id", "toxic").toPandas()
    model = Model(vocabulary, n, examples, (empty.get(0, 0), empty.get(1, 0)), k)
    if len(examples):
        model.calibrate(*votes(spark, model, examples))
    return model


def votes(spark: SparkSession, model: Model, examples: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vote for every example without itself, and its label."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    rows = spark.createDataFrame(examples[["terms", "counts", "toxic"]].assign(at=range(len(examples))), "terms array<string>, counts array<long>, toxic int, at int")

    def run(batches):
        own = cloudpickle.loads(sent.value)
        for pdf in batches:
            yield pd.DataFrame({"vote": [own.vote(own.vector(t, c), i)[0] for t, c, i in zip(pdf["terms"], pdf["counts"], pdf["at"])], "toxic": pdf["toxic"].astype(float)})

    got = rows.repartition(max(1, min(64, len(examples) // 256))).mapInPandas(run, "vote double, toxic double").toPandas()
    return got["vote"].to_numpy(), got["toxic"].to_numpy()


def scorer(spark: SparkSession, model: Model) -> Column:
    """A column function of the text: struct of score, neighbours, cosines."""
    # Bounded by max_examples and the size of the vocabulary.
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("score double, neighbours array<long>, cosines array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = cloudpickle.loads(sent.value)
        for texts in batches:
            rows = [own.score(t) for t in texts]
            yield pd.DataFrame({"score": [r[0] for r in rows], "neighbours": [r[1] for r in rows], "cosines": [r[2] for r in rows]})

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, **params) -> DataFrame:
    """`docs` without the rows whose text scores `cut` or more."""
    run = scorer(docs.sparkSession, fit(docs, labels, **params))
    return docs.where(run(F.col("text"))["score"] < cut)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores over whole `documents`, with the neighbours as evidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    run = scorer(spark, fit(docs, table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), run(F.col("text")).alias("s"))
    return out.select("doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= CUT).cast("int").alias("predicted"), F.col("s.neighbours").alias("evidence"), F.col("s.cosines").alias("cosines"))
