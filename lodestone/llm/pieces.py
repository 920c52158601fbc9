"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text runs through a lattice of its code points.  At every boundary the search
keeps the best last piece and a backpointer to where that piece begins.  Only
boundaries less than the longest piece back can still begin a piece: they are the
window.  Whenever the backpointer paths of the whole window meet in one boundary
the ids before it are committed, and what lies before it is forgotten (`stream`,
which takes its code points one by one and keeps only those behind the last commit).
A boundary that no piece can cross (before a run of blanks) is one where all paths
meet, so the ids of a segment between two of them are committed at its end; only a
segment longer than the window can commit earlier, and all of those go through
`stream`.  Shorter ones run through the same recurrence in `learn`, where sorted
segments share the boundaries of their common beginnings.  The test for a meeting is
made after a window of code points, and after twice the backlog if the paths have
not met, so that its cost stays in proportion to the text.

Two kinds of models give the best last piece in two ways:

* unigram: the piece with the largest sum of scores;
* bpe: the merges of such a model encode every beginning of a text to a beginning
  of its ids, and a row of pieces is what the merges give if and only if each two
  neighbours are what the merges give for the two alone.  So the last piece at a
  boundary is the only one that goes with the last piece where it begins.

Both give the ids of the reference library, byte fallback and dummy prefix
included; models with a normalising map are refused.

Defined cases: a null or empty text has no ids; an unknown code point becomes its
bytes, or the unknown id in a model without bytes; ids that are not pieces of
text decode to nothing, broken bytes to the replacement mark; repeated rows each
come out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

BLANK = "▁"
#: The model of the query: a setting of the environment, or where the public files usually are.
MODEL = os.environ.get("LODESTONE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
# Fixed values of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Segments whose ids a worker remembers, and pairs of pieces.
REMEMBER, REMEMBER_PAIRS = 1 << 19, 1 << 19
#: Code points that are encoded together.
TOGETHER = 1 << 21


class Pieces:
    """The pieces of a model and the search over them."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"no search for model type {kind}")
        self.kind, self.prefix = kind, BLANK if dummy_prefix else ""
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.score = [s for _, s, _ in pieces]
        self.text = [p if t in (NORMAL, USER) else "" for p, _, t in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [byte_of.get(i, t.replace(BLANK, " ").encode()) for i, t in enumerate(self.text)]
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        # No piece holds a blank behind another code point, nor any of the breaks that are in no piece at all.
        breaks = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        inner = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.segment = re.compile("(?s:.+)" if inner else f"{BLANK}*[^{BLANK}{breaks}]+|{BLANK}+" + (f"|[{breaks}]" if breaks else ""))
        self.odd = re.compile("(?s:.)" if inner or "\n" not in breaks or not dummy_prefix else f"^ |  |[{BLANK}\0\r\t]")
        # The longest piece that ends in two code points (or is the one).
        self.reach: dict[str, int] = {}
        for p in self.ids:
            self.reach[p[-2:]] = max(self.reach.get(p[-2:], 1), len(p))
        self.worst = min((self.score[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, model_file: str = MODEL) -> Pieces:
        """Read a model file, on the driver."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        if not os.path.exists(model_file):
            raise FileNotFoundError(f"no piece model at {model_file}: give model_file or set LODESTONE_PIECE_MODEL")
        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("models that normalise their texts are not supported")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type, n.add_dummy_prefix)

    def merges(self, text: str) -> list[str]:
        """What the merges of a bpe model make of a short text: the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def together(self, a: int, b: int) -> bool:
        """Whether two pieces are what the merges give for the two alone."""
        if len(self.pairs) >= REMEMBER_PAIRS:
            self.pairs.clear()
        left, right = self.text[a], self.text[b]
        found = self.pairs[a << 32 | b] = self.merges(left + right) == [left, right]
        return found

    def stream(self, text: Iterable[str]) -> Iterator[tuple[str, int]]:
        """(piece, id or -1) in order, each as soon as it is certain; `text` gives code points one by one."""
        ids, longest, bpe, pairs = self.ids, self.longest, self.kind == BPE, self.pairs
        # held: the code points behind the last commit; begin[k], last[k] (the id, or -1) and best[k] belong
        # to the boundary after k of them; the window is the last `longest` boundaries.
        held, end, begin, last, best, test_at = "", 0, [0], [-1], [0.0], 2 * longest
        for c in text:
            held += c
            end += 1
            # Without a piece of its own a code point stands alone; it is never merged.
            at, own, top = end - 1, -1, best[-1] + self.worst
            for start in range(max(0, end - longest), end):
                i = ids.get(held[start:end])
                if i is None:
                    continue
                if bpe:
                    before = last[start]
                    if before < 0 or (pairs[key] if (key := before << 32 | i) in pairs else self.together(before, i)):
                        at, own = start, i
                        break
                elif (total := best[start] + self.score[i]) > top or own < 0:
                    at, own, top = start, i, total
            begin.append(at)
            last.append(own)
            best.append(top)
            if end >= test_at:
                meet = self._meeting(begin, end)
                if meet:
                    yield from self._path(held, begin, last, meet)
                    held, end = held[meet:], end - meet
                    begin, last, best = [max(b - meet, 0) for b in begin[meet:]], last[meet:], best[meet:]
                test_at = max(2 * longest, end + longest if meet else 2 * end)
        yield from self._path(held, begin, last, end)

    def _meeting(self, begin: list[int], end: int) -> int:
        """The last boundary that the paths from all boundaries of the window share; 0 if there is none behind the last commit."""
        live = set(range(max(0, end - self.longest + 1), end + 1))
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(begin[far])
        return live.pop()

    @staticmethod
    def _path(text: str, begin: list[int], last: list[int], end: int) -> list[tuple[str, int]]:
        out = []
        while end > 0:
            start = begin[end]
            out.append((text[start:end], last[end]))
            end = start
        return out[::-1]

    def learn(self, texts: list[str]) -> None:
        """Remember the ids of many segments.

        In order of the alphabet a segment begins like the one before it, and so
        does its lattice: the search goes on from where the two part.
        """
        find, known, together, reach = self.ids.get, self.pairs.get, self.together, self.reach
        begin, last, before = [0], [-1], ""
        for text in sorted(texts):
            if self.kind != BPE or len(text) > self.longest:
                path = self.stream(text)
            else:
                common, most = 0, min(len(text), len(before))
                while common < most and text[common] == before[common]:
                    common += 1
                del begin[common + 1 :], last[common + 1 :]
                for end in range(common + 1, len(text) + 1):
                    at, own = end - 1, -1
                    far = end - reach.get(text[end - 2 : end] if end > 1 else text[0], 1)
                    for start in range(far if far > 0 else 0, end):
                        if (i := find(text[start:end])) is not None:
                            left = last[start]
                            if left >= 0:
                                go = known(left << 32 | i)
                                if not (together(left, i) if go is None else go):
                                    continue
                            at, own = start, i
                            break
                    begin.append(at)
                    last.append(own)
                before, end, out = text, len(text), []
                while end > 0 and (i := last[end]) >= 0:
                    out.append(i)
                    end = begin[end]
                if not end:
                    out.reverse()
                    self.known[text] = tuple(out)
                    continue
                path = self._path(text, begin, last, len(text))
            self.known[text] = self._with_bytes(path)

    def _with_bytes(self, path) -> tuple[int, ...]:
        """The ids of a path, with bytes or the unknown id for what is no piece."""
        out: list[int] = []
        for p, i in path:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def cut(self, text: str) -> list[str]:
        """A text in segments that no piece crosses the ends of."""
        if not self.odd.search(text):  # single blanks between words: the same cuts, found faster
            return (self.prefix + text.replace(" ", "\0" + BLANK).replace("\n", "\0\n\0")).split("\0")
        return self.segment.findall(self.prefix + text.replace(" ", BLANK))

    def encode_many(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text.

        What the texts share is searched once, a bounded amount of text at a time.
        """
        done = 0
        while done < len(texts):
            cut, size = [], 0
            while done < len(texts) and size < TOGETHER:
                text = texts[done]
                cut.append(self.cut(text) if text else [])
                size += len(text or "")
                done += 1
            new = set(chain.from_iterable(cut)).difference(self.known)
            for s in new.intersection(self.older):
                self.known[s] = self.older[s]
            self.learn(list(new.difference(self.older)))
            get = self.known.__getitem__
            for own in cut:
                yield list(chain.from_iterable(map(get, own)))
            if len(self.known) >= REMEMBER:
                self.older, self.known = {s: i for s, i in self.known.items() if len(s) <= 64}, {}

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_many([text]))

    def decode(self, ids: list[int]) -> str:
        return self.text_of([i for i in ids if 0 <= i < len(self.raw)])

    def text_of(self, ids: list[int]) -> str:
        """What ids of the model decode to."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: Pieces) -> DataFrame:
    """(doc_id, ids) of every row."""
    return _over(docs.select("doc_id", "text"), model, "doc_id long, ids array<int>", lambda own, texts: ((ids,) for ids in own.encode_many(texts)))


def decode_documents(encoded: DataFrame, model: Pieces) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    return _over(encoded.select("doc_id", "ids"), model, "doc_id long, text string", lambda own, rows: ((own.decode([] if x is None else x),) for x in rows))


def _over(rows: DataFrame, model: Pieces, schema: str, f) -> DataFrame:
    spark = rows.sparkSession
    small_batches(spark, 512)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))  # one model: bounded
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        own = cloudpickle.loads(sent.value)
        for pdf in batches:
            out = pd.DataFrame(list(f(own, pdf.iloc[:, 1].tolist())), columns=names[1:])
            out.insert(0, "doc_id", pdf.iloc[:, 0].astype("Int64").array)
            yield out

    return rows.mapInPandas(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL) -> DataFrame:
    """Ids of whole `documents` and what they decode to, as digests: (doc_id, n_ids, ids_sha256, text_sha256, decoded_sha256).

    ids_sha256 is over the ids as little-endian 32-bit numbers.
    """
    digest = lambda b: hashlib.sha256(b).hexdigest()
    raw = lambda t: (t or "").encode("utf-8", "surrogatepass")

    def numbers(ids: list[int]) -> bytes:
        packed = array("i", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def both(own: Pieces, texts: list) -> Iterator[tuple]:
        for text, ids in zip(texts, own.encode_many(texts)):
            yield len(ids), digest(numbers(ids)), digest(raw(text)), digest(raw(own.text_of(ids)))

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _over(docs, Pieces.load(model_file), "doc_id long, n_ids long, ids_sha256 string, text_sha256 string, decoded_sha256 string", both)
