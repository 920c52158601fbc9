"""Edit-aware token counts.

A document keeps its pre-tokens (runs that byte-pair merges never cross) as the
leaves of a segment tree: blocks of leaves with the sums of their code points and
tokens, and sums over blocks above them.  An edit replaces a range of code points.
The tree finds the blocks that it touches; pre-tokens are cut again from the start
of the one before the edit (its context) until a cut behind the edit falls on an
old cut, and only pre-tokens that are new are encoded.  The sums of the changed
blocks and of the nodes above them are set anew; the rest of the document is not
read.

`keep_trees` writes the leaves of every document as columns and `apply_edits` takes a
table of edits (doc_id, seq, start, end, new) to them: the edits of a document follow
one another by seq, each on the text that the one before it left, and the result is
the trees to keep, so that edits can come in batches.

Defined cases: a null or empty text has no tokens; an edit may lie at either end,
delete everything, or reach past the end, where it is cut off; repeated rows each
come out, and edits go to every row with their doc_id; an edit without a document or
with a null doc_id does nothing; a null start or end is the end of the text, a null
new text is empty; a null seq comes first and ties go by start, end and new; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
import regex
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: The vocabulary of the query: a setting of the environment, or where the public files usually are.
RANKS = os.environ.get("LODESTONE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the vocabulary's texts are cut before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, REMEMBER = 128, 1 << 18


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self._ready()

    def _ready(self) -> None:
        self.cut = regex.compile(self.pattern)
        self.known: dict[str, int] = {}
        self.encoded = 0
        self.encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.ranks, self.pattern = state
        self._ready()

    @classmethod
    def load(cls, path: str = RANKS) -> Counter:
        """Read a file of ranks, on the driver."""
        if not os.path.exists(path):
            raise FileNotFoundError(f"no ranks at {path}: give the path or set LODESTONE_BPE_RANKS")
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def tokens(self, part: str) -> int:
        found = self.known.get(part)
        if found is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            found = len(self.encoding.encode_ordinary(part))
            if len(part) <= 64:
                self.known[part] = found
        return found


class Block:
    """Some pre-tokens in a row: their lengths, their tokens, and both sums."""

    __slots__ = ("lengths", "tokens", "n_chars", "n_tokens")

    def __init__(self, lengths: list[int], tokens: list[int]):
        self.lengths, self.tokens = lengths, tokens
        self.n_chars, self.n_tokens = sum(lengths), sum(tokens)


class Document:
    """A text whose token count follows edits."""

    def __init__(self, text: str | None, counter: Counter):
        self.text, self.counter, self.encoded = text or "", counter, 0
        parts = counter.cut.findall(self.text)
        self.blocks = self._blocks([len(p) for p in parts], [self._count(p) for p in parts])
        self.encoded = 0  # by edits
        self._build()

    @classmethod
    def of(cls, text: str, lengths: list[int], tokens: list[int], counter: Counter) -> Document:
        """A kept document: nothing is cut or encoded."""
        own = cls.__new__(cls)
        own.text, own.counter, own.encoded = text, counter, 0
        own.blocks = cls._blocks(lengths, tokens)
        own._build()
        return own

    def leaves(self) -> tuple[list[int], list[int]]:
        """The lengths and the tokens of all pre-tokens in order."""
        return [n for b in self.blocks for n in b.lengths], [n for b in self.blocks for n in b.tokens]

    def _count(self, part: str) -> int:
        self.encoded += 1
        return self.counter.known.get(part) or self.counter.tokens(part)

    @staticmethod
    def _blocks(lengths: list[int], tokens: list[int]) -> list[Block]:
        return [Block(lengths[k : k + BLOCK], tokens[k : k + BLOCK]) for k in range(0, len(lengths), BLOCK)]

    def _build(self) -> None:
        """The tree over the blocks: node i has the sums of 2 i and 2 i + 1, the leaves are at the end."""
        self.size = 1 << max(0, len(self.blocks) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, b in enumerate(self.blocks):
            self.chars[self.size + i], self.sums[self.size + i] = b.n_chars, b.n_tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds a code point (the last one at the end), and where it begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def _set(self, i: int, block: Block) -> None:
        """Put a block in place and set the sums above it anew."""
        self.blocks[i] = block
        node = self.size + i
        self.chars[node], self.sums[node] = block.n_chars, block.n_tokens
        while node > 1:
            node //= 2
            self.chars[node], self.sums[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.sums[2 * node] + self.sums[2 * node + 1]

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` for the code points from `start` up to `end`."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        text = self.text[:start] + new + self.text[end:]
        if not self.blocks:
            self.text = text
            parts = self.counter.cut.findall(text)
            self.blocks = self._blocks([len(p) for p in parts], [self._count(p) for p in parts])
            self._build()
            return
        # A pre-token depends on two code points behind it at most: the first to be cut again ends one before the edit or later.
        first, begin = self._find(max(start - 2, 0))
        kept = 0
        for length in self.blocks[first].lengths:
            if begin + length >= start - 1:
                break
            begin += length
            kept += 1
        # Cuts behind the edit, block by block; `shift` takes old places to new ones.
        shift = len(new) - (end - start)
        last, at = self._find(end) if end < n else (len(self.blocks) - 1, n - self.blocks[-1].n_chars)
        old, ends, rest = iter(range(last, len(self.blocks))), [], None
        block, k = next(old), 0
        lengths, tokens = self.blocks[first].lengths[:kept], self.blocks[first].tokens[:kept]
        for m in self.counter.cut.finditer(text, begin):
            # The old cut at or behind this one.
            place = m.start() - shift
            while block is not None and at < place:
                if k == len(self.blocks[block].lengths):
                    block, k = next(old, None), 0
                    continue
                at += self.blocks[block].lengths[k]
                k += 1
            if m.start() >= start + len(new) and place >= end and at == place and block is not None and m.start() > begin:
                rest = (block, k)
                break
            lengths.append(m.end() - m.start())
            tokens.append(self._count(m.group()))
        if rest:
            after = rest[0]
            lengths += self.blocks[after].lengths[rest[1] :]
            tokens += self.blocks[after].tokens[rest[1] :]
        else:
            after = len(self.blocks) - 1
        self.text = text
        if after == first and len(lengths) <= 2 * BLOCK:
            self._set(first, Block(lengths, tokens))
        else:  # blocks came or went: the tree over them is laid out again, from sums that are known
            self.blocks[first : after + 1] = self._blocks(lengths, tokens)
            self._build()


def edits(doc_id: int | None, text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: a word in the middle, a deletion in the first quarter, a copied passage in the third, words at the end."""
    n = len(text)
    return [(n // 2, n // 2, f" edit {doc_id or 0} "), (n // 4, n // 4 + 40, ""), (3 * n // 4, 3 * n // 4 + 20, text[:60]), (1 << 60, 1 << 60, " The end.")]


def count_with_edits(docs: DataFrame, counter: Counter) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_tokens_edited, n_recounted): counts before and after the edits, and how many pre-tokens the edits made it encode."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(counter))  # one vocabulary: bounded

    def run(batches):
        own = cloudpickle.loads(sent.value)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                doc_id = None if doc_id is pd.NA else int(doc_id)
                doc = Document(text, own)
                row = [doc_id, doc.n_tokens, sum(len(b.lengths) for b in doc.blocks)]
                for edit in edits(doc_id, doc.text):
                    doc.replace(*edit)
                out.append((*row, doc.n_tokens, doc.encoded))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_recounted"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, n_pretokens long, n_tokens_edited long, n_recounted long")


TREES = "doc_id long, text string, lengths array<int>, tokens array<int>"


def _tree(doc_id, doc: Document) -> tuple:
    return (doc_id, doc.text, *doc.leaves())


def keep_trees(docs: DataFrame, counter: Counter) -> DataFrame:
    """(doc_id, text, lengths, tokens): the leaves of every document, to be written."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(counter))

    def run(batches):
        own = cloudpickle.loads(sent.value)
        for pdf in batches:
            rows = [_tree(i, Document(t, own)) for i, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"])]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "lengths", "tokens"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, TREES)


def apply_edits(trees: DataFrame, edits: DataFrame, counter: Counter) -> DataFrame:
    """The kept trees after a table of edits, with n_tokens and n_recounted (pre-tokens that the edits made it encode)."""
    small_batches(trees.sparkSession)
    sent = trees.sparkSession.sparkContext.broadcast(cloudpickle.dumps(counter))
    # The edits of a document are applied one after another: its own log is one row.
    log = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", *[F.coalesce(F.col(c).cast("long"), F.lit(1 << 60)).alias(c) for c in ("start", "end")], F.coalesce("new", F.lit("")).alias("new")))).alias("log"))
    rows = trees.select("doc_id", "text", "lengths", "tokens").join(log, "doc_id", "left")

    def run(batches):
        own = cloudpickle.loads(sent.value)
        for pdf in batches:
            out = []
            for i, text, lengths, tokens, log in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["lengths"], pdf["tokens"], pdf["log"]):
                doc = Document.of(text, list(lengths), list(tokens), own)
                for edit in log if log is not None else ():
                    doc.replace(int(edit["start"]), int(edit["end"]), edit["new"])
                out.append((*_tree(i, doc), doc.n_tokens, doc.encoded))
            yield pd.DataFrame(out, columns=["doc_id", "text", "lengths", "tokens", "n_tokens", "n_recounted"]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, TREES + ", n_tokens long, n_recounted long")


def op9_token_counts(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """Token counts of whole `documents` before and after the edits."""
    return count_with_edits(table(spark, sf_dir, "documents"), Counter.load(ranks))
