"""Conversation structure repair: A* on the lattice of edits.

A conversation's rows, in order of their turns, are kept, given another role or
deleted, and empty turns are inserted, so that the roles read `(s?(ua)+)?` by their
initials.  A node of the lattice is a number of rows taken and one of four states
(nothing out yet, after a system turn, after a user, after an assistant).

* The heuristic is admissible: it sums over the rows still to take what they cost
  whatever is done, the deletion of a blank or repeated row and the cheaper of
  deleting a truncated one and keeping it.  It drops along an edge by no more
  than the edge costs, so that a node is done when it first comes out of the queue.
* The queue is keyed by cost plus heuristic, then by the initials of the edits so far.
  Of two cheapest ways to one node neither text begins the other (what it has more
  would be inserts that lead back to the node and cost nothing), so the first to come
  out is also the least.
* A conversation of any length: rows are dealt by ranges of conversation and turn
  and cut into blocks.  A block is searched from each state that may enter it, and gives the
  cheapest edits from state to state; a second pass, sorted by conversation,
  chains the blocks in their order and then streams the rows past the edits into
  the hash.  No task holds more than a block of rows and the edits.

Repeated rows are found by a partial aggregation over (conversation, digest).

Defined cases: null ids, turns, roles and texts count as one blank in the rule that
damages rows and as role or text; a null turn comes first and is no turn for the
gaps; rows of one turn go by role, then by the digest of their text, a repetition right
after its row; a role without a letter has no initial and breaks the order; an
empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialise, table

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, CUT = range(4)
NAMES = {"u": "user", "a": "assistant"}
#: States: nothing out yet, after s, after u, after a.  The turn that may come next in each, and the state that it leads to.
NEXT = ("u", "u", "a", "u")
AFTER = {"u": 2, "a": 3}
ACCEPTING = (0, 3)
#: Rows of a block.  Costs nothing in results: blocks are chained exactly.
BLOCK = 256
ORDER = ["has_turn", "turn", "role0", "digest0", "again"]


def damaged(rows: DataFrame, folds: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, and the columns of ORDER): rows as the contract damages them, by crc32(`conv_id:turn`)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = blank("role"), blank("text")
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % folds
    out = rows.select("conv_id", "turn", role.alias("role0"), text.alias("text0"), kind.alias("kind")).where("kind <> 0")
    return out.select(
        "conv_id", F.col("turn").isNotNull().alias("has_turn"), "turn", "role0", F.md5("text0").alias("digest0"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role0")).alias("role"), F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text0", ".!?", "")).otherwise(F.col("text0")).alias("text"),
    )


def faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, ORDER, initial, fault) of rows (conv_id, ORDER, role, text): the first fault of each.

    Only digests move: the first place of each (conversation, role and text) comes out of
    a partial aggregation, and only those with more than one row are joined back.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    light = rows.select("conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"), F.substring(body, -1, 1).isin(".", "!", "?").alias("whole"), F.md5(F.concat(F.hex(F.encode("role", "UTF-8")), F.lit(":"), "text")).alias("digest"))
    light = materialise(light, "turns")
    first = light.groupBy("conv_id", "digest").agg(F.min(F.struct(*ORDER)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = light.join(first.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.coalesce(~F.col("first").eqNullSafe(F.struct(*ORDER)), F.lit(False)) & F.col("first").isNotNull()
    return met.select("conv_id", *ORDER, "initial", F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(~F.col("whole"), CUT).otherwise(SOUND).cast("int").alias("fault"))


def unavoidable(fault: int) -> int:
    """What a row costs at least."""
    return DELETE if fault in (BLANK, DUPLICATE) else min(DELETE, TRUNCATED) if fault == CUT else 0


def edits(initial: str, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial of the edit, state after it, cost) for a row in a state."""
    yield "D", state, DELETE
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == CUT else 0
    if initial == NEXT[state]:
        yield "K", AFTER[initial], extra
    elif initial == "s" and state == 0:
        yield "K", 1, extra
    yield "R", AFTER[NEXT[state]], REROLE + extra


def search(rows: list[tuple[str, int]], start: int, last: bool = False) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} behind the rows (initial, fault) for every state that `start` can reach: cheapest, then least.

    Behind the `last` rows the first accepting state ends the search.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + unavoidable(rows[i][1])
    queue, done, found = [(rest[0], "", 0, start)], set(), {}
    # Rows can all be deleted and turns inserted; only a system row that stays leads to the state behind it.
    reached = {start, 2, 3} | ({1} if start == 0 and any(c == "s" and f not in (BLANK, DUPLICATE) for c, f in rows) else set())
    while queue and len(found) < len(reached):
        bound, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == n:
            found[state] = (bound, audit)
            if last and state in ACCEPTING:
                return {state: found[state]}
        else:
            for letter, to, cost in edits(*rows[at], state):
                if (at + 1, to) not in done:
                    heapq.heappush(queue, (bound - rest[at] + cost + rest[at + 1], audit + letter, at + 1, to))
        to = AFTER[NEXT[state]]
        if (at, to) not in done:
            heapq.heappush(queue, (bound + INSERT, audit + "I", at, to))
    return found


def chain(ways: dict[int, tuple[int, str]], block: dict[int, dict[int, tuple[int, str]]]) -> dict[int, tuple[int, str]]:
    """The cheapest, then least ways through one more block."""
    out: dict[int, tuple[int, str]] = {}
    for state, (cost, audit) in ways.items():
        for to, (c, more) in block.get(state, {}).items():
            if to not in out or (cost + c, audit + more) < out[to]:
                out[to] = (cost + c, audit + more)
    return out


def legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


#: What a block gives beside its conversation and first row: counts of faults, of neighbours that break the order and of turns; first and last turn and initial; edits.
WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
BLOCKS = [pa.field("kind", pa.int32()), pa.field("counts", pa.list_(pa.int64())), pa.field("turns", pa.list_(pa.int64())), pa.field("ends", pa.list_(pa.string())), pa.field("ways", WAYS)]
BLOCKS_DDL = "kind int, counts array<bigint>, turns array<bigint>, ends array<string>, ways array<struct<entry: int, state: int, cost: bigint, audit: string>>"
ORDER_DDL = "has_turn boolean, turn {turn}, role0 string, digest0 string, again int"


def _block(rows: list[tuple], entries: Iterable[int], last: bool) -> tuple:
    """The columns of BLOCKS for rows (turn, initial, fault)."""
    initials, faults = [r[1] for r in rows], [r[2] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    steps = sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns)
    counts = [*(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), sum(not legal(a + b) for a, b in zip(initials, initials[1:])), steps]
    flat = list(zip(initials, faults))
    ways = [{"entry": s, "state": t, "cost": cost, "audit": audit} for s in entries for t, (cost, audit) in search(flat, s, last).items()]
    return 0, counts, turns[:1] + turns[-1:], [initials[0], initials[-1]], ways


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, ORDER, initial, fault) as blocks; one that may go on from an earlier task is searched from every state, one that may go on in a later one to every state."""
    rows, first, out, entries, schema, key = [], None, [], range(4), None, None

    def table_of(out):
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)

    for batch in batches:
        schema = schema or pa.schema([batch.schema.field(c) for c in ["conv_id", *ORDER]] + BLOCKS)
        for conv, *order, initial, fault in zip(*(batch.column(c).to_pylist() for c in ["conv_id", *ORDER, "initial", "fault"])):
            # Rows that repeat each other with their turn have one place in ORDER, and come to one task.
            before, key = key, (conv, *order)
            fault = DUPLICATE if key == before and fault != BLANK else fault
            other = first is None or conv != first[0]
            if first is not None and (other or len(rows) == BLOCK):
                out.append((*first, *_block(rows, entries, other)))
                entries, first = (0,) if other else range(4), None
            if first is None:
                first, rows = (conv, *order), []
            rows.append((order[1], initial, fault))
        yield table_of(out)
        out = []
    if first is not None:
        yield table_of([(*first, *_block(rows, entries, False))])


class _Repair:
    """One conversation in the second pass: blocks are chained as they come, then rows stream past the edits."""

    def __init__(self, conv):
        self.conv, self.ways, self.counts, self.turns, self.end = conv, {0: (0, "")}, [0] * 5, [], None
        self.cost, self.audit = 0, None
        self.hash, self.lines, self.at, self.state = hashlib.sha256(), 0, 0, 0

    def block(self, counts: list[int], turns: list[int], ends: list[str], ways: list[dict]) -> None:
        now: dict[int, dict[int, tuple[int, str]]] = {}
        for w in ways:
            now.setdefault(w["entry"], {})[w["state"]] = (w["cost"], w["audit"])
        self.ways = chain(self.ways, now)
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.counts[3] += self.end is not None and not legal(self.end + ends[0])
        self.end = ends[1]
        if turns:
            self.counts[4] -= bool(self.turns) and self.turns[-1] == turns[0]
            self.turns = [*self.turns[:1], *turns][:1] + turns[-1:]

    def settle(self) -> None:
        """Take the best of the ways that may end here."""
        if self.audit is None:
            self.cost, self.audit = min(self.ways[s] for s in ACCEPTING if s in self.ways)

    def line(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def put(self) -> None:
        """The inserted turns that come next."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.out(None, "")

    def out(self, role: str | None, text: str) -> None:
        """One turn; without a role it takes the one that may come next."""
        initial = NEXT[self.state] if role is None else role[:1]
        self.line(NAMES[initial] if role is None else role, text)
        self.state = AFTER.get(initial, 1)
        self.at += 1

    def row(self, role: str, text: str) -> None:
        self.settle()
        self.put()
        letter = self.audit[self.at]
        if letter == "D":
            self.at += 1
        else:
            self.out(role if letter == "K" else None, text)

    def result(self) -> tuple:
        self.settle()
        self.put()
        gaps = self.turns[-1] - self.turns[0] + 1 - self.counts[4] if self.turns else 0
        return self.conv, gaps, *self.counts[:4], self.cost, self.audit, self.hash.hexdigest()


RESULT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
RESULT_DDL = ", ".join(f"{c} {'string' if t == pa.string() else 'bigint'}" for c, t in RESULT.items())


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and kind (-1: it exists, 0: a block, 1: a row) as one result a conversation."""
    now, schema = None, None

    def table_of(out):
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)

    for batch in batches:
        schema, out = schema or pa.schema([batch.schema.field("conv_id"), *(pa.field(*x) for x in RESULT.items())]), []
        for conv, kind, counts, turns, ends, ways, role, text in zip(*(batch.column(c).to_pylist() for c in ["conv_id", "kind", "counts", "turns", "ends", "ways", "role", "text"])):
            if kind == -1:
                if now is not None:
                    out.append(now.result())
                now = _Repair(conv)
            elif kind == 0:
                now.block(counts, turns, ends, ways)
            else:
                now.row(role, text)
        yield table_of(out)
    if now is not None:
        yield table_of([now.result()])


def repair(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `original`: the counts of faults in `rows` (as `damaged` gives them), the cheapest edits and the hash of the repaired turns."""
    kinds = dict(original.dtypes)
    conv = f"conv_id {kinds['conv_id']}"
    dealt = faulty(rows).repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    blocks = materialise(dealt.mapInArrow(_blocks, f"{conv}, {ORDER_DDL.format(**kinds)}, {BLOCKS_DDL}"), "blocks")
    keys = original.select("conv_id").distinct().withColumn("kind", F.lit(-1))
    turns = rows.select("conv_id", F.lit(1).alias("kind"), *ORDER, "role", "text")
    every = keys.unionByName(blocks, True).unionByName(turns, True)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER).mapInArrow(_repaired, f"{conv}, {RESULT_DDL}")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of whole `conversations`, damaged by the contract's rule and repaired."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(rows, damaged(rows))


def _sql() -> str:
    """The same by a plain recursion over the rows of all conversations, every state's best (cost, audit, lines) at once."""
    way = lambda w, cost, letter, line: f"{{'c': {w}.c + {cost}, 'a': {w}.a || '{letter}', 'o': {f'list_append({w}.o, {line})' if line else f'{w}.o'}}}"
    best = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x.c IS NOT NULL))"
    on = lambda test, w: f"CASE WHEN {test} THEN {w} END"
    drop = lambda w: way(w, DELETE, "D", "")
    keep = lambda w, initial: on(f"NOT gone AND initial = '{initial}'", way(w, "extra", "K", "line"))
    turn = lambda w, name: on("NOT gone", way(w, f"{REROLE} + extra", "R", f"'{name}:' || text"))
    put = lambda w, name: way(w, INSERT, "I", f"'{name}:'")
    users = [x for w in ("w0", "w1", "w3") for x in (keep(w, "u"), turn(w, "user"))]
    steps = {"w0": drop("w0"), "w1": best(drop("w1"), keep("w0", "s")), "w2": best(drop("w2"), *users), "w3": best(drop("w3"), keep("w2", "a"), turn("w2", "assistant"))}
    empty = "{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}"
    grown = lambda source: f"SELECT g, i, w0, w1, w2, {best('w3', put('w2', 'assistant'))} AS w3 FROM (SELECT g, i, w0, w1, {best('w2', put('w0', 'user'), put('w1', 'user'), put('w3', 'user'))} AS w2, w3 FROM ({source}))"
    return f"""
WITH RECURSIVE tb AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))
), r AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations
), k AS (
  SELECT r.*, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM r, tb
), d AS (
  SELECT g, turn, role AS role0, text AS text0, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role0, md5(text0), again) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d
), q AS (
  SELECT *, substr(role, 1, 1) AS initial, lead(substr(role, 1, 1)) OVER (PARTITION BY g ORDER BY i) AS follows, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again_seen, role || ':' || text AS line FROM o
), f AS MATERIALIZED (
  SELECT *, blank OR again_seen AS gone, NOT blank AND NOT again_seen AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, CASE WHEN NOT blank AND NOT again_seen AND right(body, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE 0 END AS extra FROM q
), w AS (
  {grown(f"SELECT DISTINCT g, 0::BIGINT AS i, {empty} AS w0, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]) AS w1, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]) AS w2, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]) AS w3 FROM r")}
  UNION ALL
  {grown(f"SELECT w.g, w.i + 1 AS i, {', '.join(f'{x} AS {name}' for name, x in steps.items())} FROM w JOIN f ON f.g = w.g AND f.i = w.i + 1")}
), e AS (
  SELECT g, {best('w0', 'w3')} AS x FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1
), s AS (
  SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again_seen) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE follows IS NOT NULL AND initial || follows NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, x.c AS cost, x.a AS audit, sha256(array_to_string(x.o, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM r) JOIN e USING (g) LEFT JOIN s USING (g)
"""


OP11_SQL = _sql()
