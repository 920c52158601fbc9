"""Conversation repair against a plain forward search that carries every text along."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations as C
from lodestone.llm.common import SPACES

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def damage(conv, rows):
    """Rows (turn, role, text) of one conversation in their order after damage."""
    blank = lambda x: " " if x is None else x
    rows = sorted(((t is not None, t or 0, blank(r), hashlib.md5(blank(x).encode()).hexdigest(), t, blank(x)) for t, r, x in rows), key=lambda r: r[:4])
    out = []
    for _, _, role, _, turn, text in rows:
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        out.append(C.BLANK if not body else C.DUPLICATE if (role, text) in seen else C.CUT if body[-1] not in ".!?" else C.SOUND)
        seen.add((role, text))
    return out


def forward(rows, faults):
    """(cost, audit, lines) by going through the rows one by one."""
    best = {"": (0, "", ())}

    def put(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def inserted(b):
        for _ in range(3):
            for state, (c, a, o) in list(b.items()):
                n = "a" if state == "u" else "u"
                put(b, n, (c + 5, a + "I", (*o, f"{NAMES[n]}:")))
        return b

    inserted(best)
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (c, a, o) in best.items():
            put(after, state, (c + 2, a + "D", o))
            if fault in (C.BLANK, C.DUPLICATE):
                continue
            extra, n = 5 * (fault == C.CUT), "a" if state == "u" else "u"
            if role[:1] == n or (role[:1] == "s" and state == ""):
                put(after, role[:1], (c + extra, a + "K", (*o, f"{role}:{text}")))
            put(after, n, (c + extra + 1, a + "R", (*o, f"{NAMES[n]}:{text}")))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def expected(conv, rows):
    rows = damage(conv, rows)
    faults = faults_of(rows)
    cost, audit, lines = forward(rows, faults)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    counts = [faults.count(f) for f in (C.BLANK, C.DUPLICATE, C.CUT)]
    return conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def check(spark, rows):
    """Every conversation of rows (conv_id, turn, role, text) beside `expected`; other columns are there and null."""
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(None).cast("string") for c in ("kind", "again", "ways", "digest", "first")})
    got = sorted(C.repair(table, C.damaged(table)).collect(), key=repr)
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(row)
    assert [tuple(r) for r in got] == sorted((expected(c, r) for c, r in by.items()), key=repr)
    return got


def drawn(rng, n, convs):
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "a.b", "Why?", None, "x. \n", "é!"]
    return [(rng.choice(convs), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.6 else f"text {k}.") for k in range(n)]


def test_odd_rows(spark):
    rng = random.Random(3)
    got = check(spark, drawn(rng, 900, [None, *range(-3, 60), 1 << 60]))
    # At these costs one deletion is always cheaper than an insertion.
    assert {x for r in got for x in r.audit} == set("DKR")


@pytest.mark.parametrize("block", [1, 7, 256])
def test_long_conversation_in_blocks(spark, monkeypatch, block):
    """One conversation holds nearly all rows: blocks of any size in several tasks give the same edits."""
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"text {t}."])) for t in range(1500)]
    check(spark, rows + drawn(rng, 20, [1, 9]))


def test_insertions(spark, monkeypatch):
    """With cheap insertions they are taken, and put into the hash."""
    monkeypatch.setattr(C, "INSERT", 1)
    rows = spark.createDataFrame([(1, t, r, f"t{t}.") for t, r in enumerate(["system", "assistant", "user", "user", "assistant", "user"])], SCHEMA)
    whole = rows.select("conv_id", F.lit(True).alias("has_turn"), "turn", F.col("role").alias("role0"), F.lit("").alias("digest0"), F.lit(0).alias("again"), "role", "text")
    (row,) = C.repair(rows, whole).collect()
    text = "system:t0.\nuser:\nassistant:t1.\nuser:t2.\nassistant:\nuser:t3.\nassistant:t4.\nuser:t5.\nassistant:"
    assert (row.cost, row.audit, row.repaired_sha256) == (3, "KIKKIKKKI", hashlib.sha256(text.encode()).hexdigest())


def test_search_by_every_sequence_of_edits():
    """All edits of short conversations, one by one."""
    rng = random.Random(1)

    def ways(rows, state, inserts):
        if not rows:
            if state in C.ACCEPTING:
                yield 0, ""
        else:
            for letter, to, cost in C.edits(*rows[0], state):
                for c, a in ways(rows[1:], to, inserts):
                    yield c + cost, letter + a
        if inserts:
            for c, a in ways(rows, C.AFTER[C.NEXT[state]], inserts - 1):
                yield c + C.INSERT, "I" + a

    for _ in range(150):
        rows = [(rng.choice("uasx"), rng.randrange(4)) for _ in range(rng.randrange(5))]
        assert next(iter(C.search(rows, 0, True).values())) == min(ways(rows, 0, 2))
        # Never more than the least cost that is left.
        assert sum(C.unavoidable(f) for _, f in rows) <= min(ways(rows, 0, 2))[0]


def test_empty_table_and_all_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(empty, C.damaged(empty)).isEmpty()
    gone = next(t for t in range(99) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = check(spark, [(5, gone, "user", "x.")])
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_many_repeated_rows(spark):
    check(spark, [(1, t // 2, "user", "same.") for t in range(400)] + [(2, 1, "user", "same.")] * 50)
