"""Conversation structure repair: an error-correcting Earley parser over role initials.

A conversation is legal if its role initials are ``(s?(ua)+)?``. Edits make it legal: Keep
costs nothing, Rerole (to user or assistant) and Insert (an empty user or assistant turn)
3, Delete 4; blank and duplicate turns must be deleted, and a truncated turn that stays
adds 3. The repair is the cheapest list of edits; of equally cheap ones, that whose
initials (K, R, I, D), in the order of the conversation, are least in ASCII.

The grammar is read from the last turn to the first, so its strings are ``((au)+s?)?``: an
edit is then put before edits already chosen, and the lesser of two lists stays the lesser.
Every rule is left-recursive, so nonterminals are predicted at the beginning only, each
item begins there, and a set of the chart holds a few items, whatever the length. An item
keeps the least cost and the rank of its edits among those of its set; a scan that keeps,
reroles or deletes a turn moves on to the next set, an insertion and a completion stay in
one. Sets that differ by a constant cost are one, and what a turn makes of a set is kept, so
a turn costs two lookups, and the chart of a conversation four bytes a turn.

Two jobs: rows without their texts are sorted by conversation and parsed; then the edits,
one row a conversation, and the rows with their texts are sorted together, and the repaired
turns stream by. Duplicates are found by a window over equal turns, on all tasks. A
conversation goes through one task, as its audit is one string and its digest one hash, but
none of its texts is held.

Defined cases: a null role or text is one space; turns go by number, nulls first, then by
role and by the digest of the turn; repeated rows are repeated turns, so duplicates; a null
conv_id is a conversation of its own; a role whose initial is none of s, u and a can only be
reroled or deleted; very long texts are not looked into but for their marks; other columns
are not looked at, whatever their names; an empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lectern.llm.arrow import bound_batches
from lectern.runtime import ship

REROLE, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
#: (nonterminal, what it is made of), for conversations read backwards.
RULES = (("S", ""), ("S", "P"), ("S", "Ps"), ("P", "au"), ("P", "Pau"))
ROLES = {"u": "user", "a": "assistant"}
SYMBOLS = "sua"
#: Faults of a turn, the first that holds.
SOUND, CUT_SHORT, REPEATED, BLANK = range(4)
#: Bytes of texts in one batch of repaired turns.
FLUSH = 4_000_000

#: (rule, place of the dot).
Item = tuple[int, int]
#: Items that can go on as others can, which go if they cost more: after whole pairs, what has made nothing yet, has ended or
#: has just ended a pair; between the two of a pair, the other rule's.
_ABLE = (((1, 1), ((0, 0), (3, 0), (2, 2), (3, 2), (4, 3))), ((3, 1), ((4, 2),)), ((4, 2), ((3, 1),)))


def _next(item: Item) -> str:
    return RULES[item[0]][1][item[1] : item[1] + 1]


class Parser:
    """A chart whose sets are shared by conversations."""

    def __init__(self) -> None:
        self.sets: list[tuple[tuple[Item, int, int], ...]] = []
        self.numbers: dict[tuple, int] = {}
        #: By set * 12 + code of the turn: the number of a move.
        self.moves: dict[int, int] = {}
        #: (next set, cost that all its items have, by item the edits of the turn and the item before them).
        self.made: list[tuple[int, int, dict]] = []
        predicted = [(0, (), (rule, 0), ("", None)) for rule in range(len(RULES))]
        self.waiting = [item for *_, item, _ in predicted if _next(item) == "P"]
        self.first, base, self.begin = self._set(predicted)
        assert base == 0

    def _set(self, scanned: list[tuple]) -> tuple[int, int, dict]:
        """The set of all that follows from (cost, edits, item, (initials, item before)) without a further turn."""
        heapify(scanned)
        done: dict[Item, tuple] = {}
        while scanned:
            cost, edits, item, back = heappop(scanned)
            if item in done:
                continue
            done[item] = (cost, edits, back)
            symbol = _next(item)
            if symbol in ROLES:
                heappush(scanned, (cost + INSERT, ("I", edits), (item[0], item[1] + 1), ("I" + back[0], back[1])))
            elif not symbol and RULES[item[0]][0] == "P":
                for rule, dot in self.waiting:
                    heappush(scanned, (cost, edits, (rule, dot + 1), back))
        for better, worse in _ABLE:
            for item in worse:
                if better in done and item in done and done[item][0] > done[better][0]:
                    del done[item]
        base = min(cost for cost, *_ in done.values())
        rank = {e: k for k, e in enumerate(sorted({e for _, e, _ in done.values()}))}
        own = tuple(sorted((item, cost - base, rank[e]) for item, (cost, e, _) in done.items()))
        number = self.numbers.setdefault(own, len(self.sets))
        if number == len(self.sets):
            self.sets.append(own)
        return number, base, {item: back for item, (*_, back) in done.items()}

    def _scan(self, number: int, code: int) -> tuple[int, int, dict]:
        symbol, fault = (SYMBOLS + "x")[code // 3], code % 3
        out = []
        for item, cost, rank in self.sets[number]:
            wanted = _next(item)
            if wanted == "P":
                continue
            out.append((cost + DELETE, ("D", rank), item, ("D", item)))
            if wanted and fault < 2:
                after, cost = (item[0], item[1] + 1), cost + TRUNCATED * fault
                if wanted == symbol:
                    out.append((cost, ("K", rank), after, ("K", item)))
                elif wanted in ROLES:
                    out.append((cost + REROLE, ("R", rank), after, ("R", item)))
        return self._set(out)

    def parse(self, codes: bytes | bytearray) -> tuple[int, str]:
        """Cost and audit of a conversation; a code is 3 * place of the symbol + 0, 1 if truncated, 2 if it must go."""
        at, total, path = self.first, 0, array("I")
        for code in reversed(codes):
            key = at * 12 + code
            move = self.moves.get(key)
            if move is None:
                move = self.moves[key] = len(self.made)
                self.made.append(self._scan(at, code))
            path.append(move)
            at, base, _ = self.made[move]
            total += base
        cost, _, item = min((cost, rank, item) for item, cost, rank in self.sets[at] if RULES[item[0]][0] == "S" and not _next(item))
        audit = []
        for move in reversed(path):
            edits, item = self.made[move][2][item]
            audit.append(edits)
        return total + cost, "".join(audit) + self.begin[item][0]


def code_of(role: str, fault: int) -> int:
    """The parser's code of a turn."""
    return 3 * (SYMBOLS.find(role[:1]) if role[:1] else 3) % 12 + min(fault, 2)


def applied(audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn of the repaired conversation, from its turns in order."""
    turns, wanted, begun = iter(turns), "u", False
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K" and not begun and role.startswith("s"):
            yield edit, role, text
        else:
            yield edit, role if edit == "K" else ROLES[wanted], text
            wanted = "a" if wanted == "u" else "u"
        begun = True


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the digest of role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


_ORDER = ("turn", "role", "digest")


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest and fault of each turn."""
    blank, last = ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    marked = rows.select("conv_id", *_ORDER, blank.alias("blank"), (~last.isin(".", "!", "?")).alias("short"))
    alike = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    fault: Column = F.when(F.col("blank"), BLANK).when(F.row_number().over(alike) > 1, REPEATED).when(F.col("short"), CUT_SHORT).otherwise(SOUND)
    return marked.select("conv_id", *_ORDER, fault.alias("fault"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its other columns row by row) of batches sorted by conv_id."""
    from itertools import groupby

    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    yield from groupby(rows, key=lambda row: row[0])


def _batched(rows: Iterable[tuple], schema: pa.Schema, size=lambda row: 200) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan(turns: DataFrame) -> DataFrame:
    """One row a conversation: gaps in its numbers, first faults, illegal neighbours, cost and audit of its repair."""
    return _plan(_turns(turns))


def _plan(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    bound_batches(spark)
    schema = to_arrow_schema(_parse_datatype_string(PLAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()

        def one(conv: int | None, group: Iterator[tuple]) -> tuple:
            codes, faults, illegal, before = bytearray(), [0] * 4, 0, None
            distinct, least, most = 0, None, None
            for _, turn, role, fault in group:
                codes.append(code_of(role, fault))
                faults[fault] += 1
                illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
                before = role[:1]
                if turn is not None and turn != most:
                    distinct, least, most = distinct + 1, turn if least is None else least, turn
            cost, audit = parser.parse(codes)
            gaps = most - least + 1 - distinct if distinct else 0
            return conv, gaps, faults[BLANK], faults[REPEATED], faults[CUT_SHORT], illegal, cost, audit

        yield from _batched((one(conv, group) for conv, group in _groups(batches)), schema, lambda row: 200 + len(row[-1]))

    sorted_ = _faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return sorted_.select("conv_id", "turn", "role", "fault").mapInArrow(run, PLAN)


def _with_edits(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The audit of each conversation, then its turns in order, sorted in one partition."""
    head = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), *_ORDER, "text")
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER).select("conv_id", "role", "text")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of every turn of the repaired conversations."""
    rows = _turns(turns)
    kind = "conv_id long, place long, edit string, role string, text string"
    schema = to_arrow_schema(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            for conv, group in _groups(batches):
                for place, turn in enumerate(applied(next(group)[2], (row[1:] for row in group))):
                    yield conv, place, *turn

        yield from _batched(every(), schema, lambda row: 100 + len(row[-1]))

    return _with_edits(rows, _plan(rows)).mapInArrow(run, kind)


def repaired(turns: DataFrame) -> DataFrame:
    """plan() and repaired_sha256, the digest of the repaired ``role:text`` lines, of every conversation."""
    rows = _turns(turns)
    plans = _plan(rows).persist()
    kind = "conv_id long, repaired_sha256 string"
    schema = to_arrow_schema(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(conv: int | None, group: Iterator[tuple]) -> tuple:
            digest, between = hashlib.sha256(), ""
            for _, role, text in applied(next(group)[2], (row[1:] for row in group)):
                digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
            return conv, digest.hexdigest()

        yield from _batched((one(conv, group) for conv, group in _groups(batches)), schema)

    digests = _with_edits(rows, plans).mapInArrow(run, kind).withColumnRenamed("conv_id", "digest_of")
    return plans.join(digests, F.col("conv_id").eqNullSafe(F.col("digest_of"))).drop("digest_of")
