"""Language-model scores by deleted interpolation of n-gram estimates.

The corpus is read once into blocks of a few thousand documents: token ids and
the hashes of the block's words, packed into arrays.  Each block sends its
distinct n-gram hashes with its counts to the bucket that owns them; a bucket
sums the counts over all blocks and answers every block with the totals of the
n-grams it asked for.  So a very common n-gram is one entry a block, however
often it occurs, and nothing that grows with the corpus is held in one place:
the number of buckets follows the number of blocks.

The score of a word w after a history h is

    P(w | h) = l2 * c(h w) / c(h .) + l1 * c(w) / N + l0 / (V + 1)

with weights chosen by the frequency bucket of h (the power of two of c(h .)).
The weights are learned by expectation-maximisation on a deleted part of the
training documents (one fold in seven), with that part taken out of the counts.
The held-out counts of all of that part are gathered in a grid over the ratios of the
three estimates, one for each frequency bucket: an eighth of a power of two a step,
no ratio left out, so a ratio is off by 4.4 % at most and the weights by under 0.01
(tested against expectation-maximisation on the estimates themselves).  Its size does
not grow with the corpus.  n-grams end at pairs: triples would take the shuffle beyond
its limit (README).

Defined cases: a null text is an empty text, one end token; a null doc_id has the
fold of an empty text; rows that share an id each come out and each count; an
empty table gives no rows; with no training text the counts are all zero.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, materialise, small_batches

FOLDS, HELD_OUT, DELETED = 7, 2, 5
END = np.uint64(xxhash.xxh64_intdigest(b"\n", seed=7))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The grid of held-out counts: frequency buckets (the powers of two of any 64-bit count), and steps of an eighth
#: of a power of two for the ratios to the uniform estimate, which cover every ratio of two such counts.
FREQUENCIES, FINE, MIDDLE = 65, 8, 520
STEPS = 2 * MIDDLE


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case; words end at blanks and the codes 9 to 13."""
    return (text or "").encode().lower().split()


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two words in a row, from theirs; odd factors keep their order apart."""
    x = (left * MIX) ^ (right + (left >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Block:
    """Documents on their way into a block."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.folds, self.sizes, self.found, self.total = [], [], [], [], 0

    def add(self, doc_id: int | None, fold: int, text: str | None) -> None:
        put, place = self.place.setdefault, self.place
        own = np.array([*(put(w, len(place) + 1) for w in words(text)), 0], np.uint32)
        self.ids.append(doc_id)
        self.folds.append(fold)
        self.sizes.append(len(own))
        self.found.append(own)
        self.total += len(own)

    def packed(self, name: int) -> pd.DataFrame:
        vocab = np.array([END, *(xxhash.xxh64_intdigest(w, seed=42) for w in self.place)], np.uint64)
        return pd.DataFrame([{"block": name, "ids": self.ids, "folds": self.folds, "sizes": self.sizes, "vocab": vocab.tobytes(), "tokens": _narrow(np.concatenate(self.found))}])


def blocks(docs: DataFrame, tokens: int = 1 << 19) -> DataFrame:
    """(block, ids, folds, sizes, vocab, tokens): documents packed to about `tokens` tokens a block.

    vocab: the hash of each distinct word, the end at 0; tokens: their places in
    vocab, document after document.  A document is never split, and the deleted
    part has blocks of its own.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        open_blocks = {True: _Block(), False: _Block()}
        for pdf in batches:
            for doc_id, fold, text in zip(pdf["doc_id"].astype("Int64"), pdf["fold"], pdf["text"]):
                block = open_blocks[fold == DELETED]
                block.add(None if doc_id is pd.NA else int(doc_id), int(fold), text)
                if block.total >= tokens:
                    yield block.packed((part << 32) + n)
                    open_blocks[fold == DELETED] = _Block()
                    n += 1
        for block in open_blocks.values():
            if block.ids:
                yield block.packed((part << 32) + n)
                n += 1

    folded = docs.select("doc_id", "text", crc_fold(F.col("doc_id"), FOLDS).alias("fold"))
    return folded.mapInPandas(run, "block long, ids array<long>, folds array<int>, sizes array<int>, vocab binary, tokens binary")


def _opened(row) -> tuple[np.ndarray, ...]:
    """(word hash, hash of the word before, pair hash, fold, document) of each token."""
    vocab, tokens = np.frombuffer(row.vocab, np.uint64), _wide(row.tokens)
    sizes = np.asarray(row.sizes)
    word = vocab[tokens]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = END  # a document begins after an end
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return word, before, pair_hash(before, word), np.asarray(row.folds)[doc], doc


def _keys(row) -> tuple[np.ndarray, ...]:
    """(distinct n-grams of a block, the places of its words and pairs among them, fold, document).

    The lowest bit tells a word (1) from a pair (0).
    """
    word, before, pair, fold, doc = _opened(row)
    one = np.uint64(1)
    keys, at = np.unique(np.concatenate([word | one, pair & ~one]), return_inverse=True)
    return keys, at, fold, doc


def _edges(buckets: int) -> np.ndarray:
    """Where the range of hash values of each bucket begins."""
    return np.array([b * (1 << 64) // buckets for b in range(buckets)], np.uint64)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, after a byte with their width, compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    packed = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + packed.tobytes())


def _wide(b: bytes) -> np.ndarray:
    """What `_narrow` packed."""
    raw = zstandard.ZstdDecompressor().decompress(b)
    packed = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, : raw[0]] = packed
    return out.view("<u8")[:, 0]


def answers(packed: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, train, deleted, v, v_left): for each block and bucket the totals of the n-grams that it asked for.

    train: the counts in all training documents, deleted: in the deleted part of
    them.  v, v_left: the bucket's distinct training words, and those that the
    deleted part leaves, in one row of each bucket and 0 in the others.
    """
    edges = _edges(buckets)

    def ask(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                keys, at, fold, _ = _keys(row)
                train = np.bincount(at, np.tile(fold != HELD_OUT, 2).astype(np.float64), len(keys)).astype(np.uint64)
                cut = np.append(np.searchsorted(keys, edges), len(keys))
                parts = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if lo < hi]
                yield pd.DataFrame({"bucket": [p[0] for p in parts], "block": row.block, "keys": [_narrow(np.diff(keys[lo:hi], prepend=edges[b])) for b, lo, hi in parts], "train": [_narrow(train[lo:hi]) for _, lo, hi in parts], "deleted": row.folds[0] == DELETED})

    def answer(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [edges[group[0]] + np.cumsum(_wide(k)) for k in pdf["keys"]]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = [_wide(x) for x in pdf["train"]]
        train = np.bincount(at, np.concatenate(counts), len(keys)).astype(np.uint64)
        gone = [c if d else np.zeros_like(c) for c, d in zip(counts, pdf["deleted"])]
        deleted = np.bincount(at, np.concatenate(gone), len(keys)).astype(np.uint64)
        cut = np.cumsum([len(x) for x in asked])[:-1]
        out = pd.DataFrame({"block": pdf["block"], "bucket": group[0], "train": [_narrow(train[i]) for i in np.split(at, cut)], "deleted": [_narrow(deleted[i]) for i in np.split(at, cut)], "v": 0, "v_left": 0})
        word = (keys & np.uint64(1)).astype(bool)
        out.loc[0, ["v", "v_left"]] = int((word & (train > 0)).sum()), int((word & (train > deleted)).sum())
        return out

    asked = packed.select("block", "folds", "sizes", "vocab", "tokens").mapInPandas(ask, "bucket int, block long, keys binary, train binary, deleted boolean")
    return asked.groupBy("bucket").applyInPandas(answer, "block long, bucket int, train binary, deleted binary, v long, v_left long")


def totals(packed: DataFrame, answered: DataFrame) -> tuple[int, int, int, int]:
    """(N, V, N of the deleted part, distinct words without it): tokens and distinct words of the training documents."""
    each = packed.select(F.explode(F.arrays_zip("folds", "sizes")).alias("d")).select("d.folds", "d.sizes")
    n = each.agg(F.sum(F.when(F.col("folds") != HELD_OUT, F.col("sizes"))), F.sum(F.when(F.col("folds") == DELETED, F.col("sizes")))).first()
    v = answered.agg(F.sum("v"), F.sum("v_left")).first()
    return int(n[0] or 0), int(v[0] or 0), int(n[1] or 0), int(v[1] or 0)


def _estimates(row, rows: list, n: int, v: int, without: bool) -> tuple[np.ndarray, ...]:
    """(document, fold, c(w), c(h), the three estimates) of each token of a block, from the answers to it."""
    keys, at, fold, doc = _keys(row)
    size, rows = len(doc), sorted(rows)
    total = np.concatenate([_wide(t) for _, t, _ in rows]).astype(np.float64)
    if without:
        total -= np.concatenate([_wide(d) for _, _, d in rows])
    c_word, c_pair = total[at[:size]], total[at[size:]]
    # c(h .) is c(h): every word has a follower, and a document begins after an end.
    c_before = np.empty_like(c_word)
    c_before[1:] = c_word[:-1]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    c_before[first] = total[np.searchsorted(keys, END | np.uint64(1))]
    p2 = np.divide(c_pair, c_before, out=np.zeros_like(c_pair), where=c_before > 0)
    return doc, fold, c_word, c_before, p2, c_word / max(n, 1), np.full(size, 1 / (v + 1))


def frequency(c: np.ndarray) -> np.ndarray:
    """The bucket of a history: 0 for unseen, else the power of two of its count, from 1."""
    return np.where(c > 0, 1 + np.log2(np.maximum(c, 1)).astype(np.int64), 0)


def _grid(row, rows: list, n: int, v: int) -> pd.DataFrame:
    """The held-out counts of a block's deleted documents: tokens by bucket and ratio step (0: an estimate of zero)."""
    doc, fold, _, c_before, p2, p1, p0 = _estimates(row, rows, n, v, True)
    own = fold == DELETED
    step = lambda p: np.where(p > 0, np.rint(FINE * np.log2(np.maximum(p, 1e-300) / p0)) + MIDDLE, 0).astype(np.int64)
    cell = ((frequency(c_before) * STEPS + step(p2)) * STEPS + step(p1))[own]
    cells, count = np.unique(cell, return_counts=True)
    return pd.DataFrame({"cell": cells, "n": count})


def learn(grid: pd.DataFrame, rounds: int = 40) -> np.ndarray:
    """Weights (frequency bucket, 3) by expectation-maximisation on the grid; buckets without counts mix evenly."""
    weights = np.full((FREQUENCIES, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    cell, n = grid["cell"].to_numpy(np.int64), grid["n"].to_numpy(np.float64)
    at, s2, s1 = cell // STEPS**2, cell // STEPS % STEPS, cell % STEPS
    ratio = lambda s: np.where(s > 0, 2.0 ** ((s - MIDDLE) / FINE), 0)
    p = np.stack([ratio(s2), ratio(s1), np.ones(len(cell))], 1)
    for _ in range(rounds):
        share = p * weights[at]
        share *= (n / share.sum(1))[:, None]
        gained = np.zeros_like(weights)
        np.add.at(gained, at, share)
        mass = gained.sum(1)
        # A token's worth of the uniform estimate keeps every text possible.
        gained[:, 2] += 1e-3 * np.maximum(mass, 1)
        weights = np.where(mass[:, None] > 0, gained / np.maximum(gained.sum(1), 1e-9)[:, None], weights)
    return weights


def _scores(row, rows: list, n: int, v: int, weights: np.ndarray) -> pd.DataFrame:
    doc, fold, c_word, c_before, p2, p1, p0 = _estimates(row, rows, n, v, False)
    w = weights[frequency(c_before)]
    base = np.log10((c_word + 1) / (n + v + 1))
    model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
    add = lambda x: np.bincount(doc, x, len(row.sizes))
    return pd.DataFrame({"doc_id": pd.array(list(row.ids), "Int64"), "held_out": np.asarray(row.folds) == HELD_OUT, "n_tokens": np.asarray(row.sizes, np.int64), "n_known": add(c_word > 0).astype(np.int64), "train_tokens": n, "base_score": add(base), "score": add(model)})


def _met(packed: DataFrame, answered: DataFrame, columns: list[str], schema: str, run) -> DataFrame:
    """`run(row, answers)` for every block with the answers to it."""

    def together(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(right["bucket"], right["train"], right["deleted"] if "deleted" in right else right["train"]))
        got = [run(row, rows) for row in left.itertuples()]
        return pd.concat(got) if got else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return packed.select("block", *columns).groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(together, schema)


def score_documents(docs: DataFrame, tokens: int = 1 << 19, share: int = 1 << 19) -> DataFrame:
    """Scores of every document; `tokens` in a block, `share` the n-grams that a bucket may get, on average."""
    packed = materialise(blocks(docs, tokens), "blocks")
    size = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda t, n: t + n)), F.sum(F.length("vocab") / 8)).first()
    buckets = max(1, math.ceil(((size[0] or 0) + (size[1] or 0)) / share))
    answered = materialise(answers(packed, buckets), "answers")
    n, v, n_deleted, v_left = totals(packed, answered)
    columns = ["ids", "folds", "sizes", "vocab", "tokens"]
    with_deleted = packed.where(F.array_contains("folds", DELETED))
    cells = _met(with_deleted, answered.join(with_deleted.select("block"), "block", "left_semi").select("block", "bucket", "train", "deleted"), columns, "cell long, n long", lambda row, rows: _grid(row, rows, n - n_deleted, v_left))
    weights = learn(cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    return _met(packed, answered.select("block", "bucket", "train"), columns, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", lambda row, rows: _scores(row, rows, n, v, weights))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores over whole `documents`."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
