"""Conversation structure repair by Wagner-Fischer target alignment.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``.  For
each length there is one such string at most, so a repair is an alignment of
the turns to the string of some length.  All strings end alike, so one table
of the costs from each turn and each number of letters left serves every
length: the last column of each alignment is a cell of its first row.  Only a
band of the table is filled, as wide as the cost of the best repair known can
pay for in deletions and insertions.  Of the lengths with the least cost, the
backtraced audits are compared.

A conversation of any number of turns is repaired.  Longer ones are cut in
blocks of turns in order; each block is aligned from every state of the
grammar to every other, a fold over these small matrices picks the states at
the borders, and the blocks are backtraced between them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import arrow_type, bounded_broadcast, kept, map_slices, plain, require
from spendlens.operators.skew import heavy_keys, salted_left_join

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Turns and bytes of a conversation that is repaired in one piece, and of a block of a longer one.
LONGEST, LONGEST_BYTES = 2048, 32_000_000
BLOCK, BLOCK_BYTES = 1024, 8_000_000
#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's; what closes each.
START, SYSTEM, USER, ASSISTANT = range(4)
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": b"user", "a": b"assistant"}
LEGAL = {b"su", b"ua", b"au"}
SPACE = b" \t\n\x0b\x0c\r"
FAR = 1 << 28


# --- alignment ------------------------------------------------------------------------


class Turns:
    """A pattern, one character for each turn: x (must go), s, u, a, - (other role), in capitals or _ if truncated."""

    def __init__(self, pattern: str):
        self.live = [p for p in pattern if p != "x"]
        self.gone = [0]  # turns to delete before each of the others, and behind the last
        for p in pattern:
            if p == "x":
                self.gone[-1] += 1
            else:
                self.gone.append(0)
        self.letters = [p.lower() for p in self.live]
        self.extra = [TRUNCATED if p in "SUA_" else 0 for p in self.live]
        self.tables: dict[tuple[str, bool], np.ndarray] = {}

    def incumbent(self) -> int:
        """What a repair in one pass costs: every turn gets the next role; truncated ones all stay, or all go."""
        costs = []
        for drop in (False, True):
            cost, wanted = 0, "u"
            for letter, extra in zip(self.letters, self.extra):
                if drop and extra:
                    cost += DELETE
                else:
                    cost += extra + (letter != wanted) * REROLE
                    wanted = "a" if wanted == "u" else "u"
            costs.append(cost + INSERT * (wanted == "a"))
        return min(*costs, DELETE * len(self.live) + INSERT)

    def table(self, end: str, last: bool) -> np.ndarray:
        """Least cost from each turn on with so many letters left of a string that ends in ``end``.

        Without ``last`` no insertion follows the last turn.  The band: a cell
        more than the incumbent's worth of deletions or insertions from the
        diagonal is on no better way.  Other borders than those of a whole
        conversation change the incumbent by a few edits.
        """
        if (end, last) not in self.tables:
            m, most = len(self.live), self.incumbent() + (0 if last else 4 * INSERT)
            below, above = most // DELETE + 1, most // INSERT + 1
            width = m + above + 1
            steps = INSERT * np.arange(width, dtype=np.int64)
            found = np.full((m + 1, width), FAR, np.int32)
            found[m, : above + 1] = steps[: above + 1] if last else FAR
            found[m, 0] = 0
            other = "a" if end == "u" else "u"
            wanted = np.array([ord(end if r % 2 else other) for r in range(width)])
            price = {c: np.where(wanted == ord(c), 0, REROLE) for c in "sua-"} | {"_": np.full(width, REROLE)}
            for i in range(m - 1, -1, -1):
                low, high = max(0, m - i - below), min(width, m - i + above + 1)
                best = found[i + 1, low:high].astype(np.int64) + DELETE
                begin = max(low, 1)
                kept_ = found[i + 1, begin - 1 : high - 1] + price[self.letters[i]][begin:high] + self.extra[i]
                best[begin - low :] = np.minimum(best[begin - low :], kept_)
                best = np.minimum.accumulate(best - steps[low:high]) + steps[low:high]
                found[i, low:high] = np.minimum(best, FAR)
            self.tables[end, last] = found
        return self.tables[end, last]

    def backtrace(self, end: str, last: bool, i: int, left: int) -> str:
        """The first of the cheapest audits in ASCII order, from a turn and a number of letters left."""
        found, out, m = self.table(end, last), ["D" * self.gone[i]], len(self.live)
        other = "a" if end == "u" else "u"
        while i < m or left:
            cost = found[i, left]
            if i < m and found[i + 1, left] + DELETE == cost:
                i, letter = i + 1, "D"
            elif left and (i < m or last) and found[i, left - 1] + INSERT == cost:
                left, letter = left - 1, "I"
            else:
                letter = "K" if self.letters[i] == (end if left % 2 else other) else "R"
                i, left = i + 1, left - 1
            out.append(letter)
            if letter != "I":
                out.append("D" * self.gone[i])
        return "".join(out)

    def deleted(self, begin: int, end: int) -> str:
        """The audit of deleting the turns from one of the live ones to before another."""
        return "D" * (sum(self.gone[begin:end]) + end - begin)

    def best(self, entry: int, exit: int, last: bool = False) -> tuple[int, str] | None:
        """Least cost and first audit between two states of the grammar, over every feasible length."""
        m, found = len(self.live), []
        always = DELETE * sum(self.gone)
        if entry == exit:
            found.append((DELETE * m, lambda: [self.deleted(0, m) + "D" * self.gone[m]]))
        systems = [i for i in range(m) if self.letters[i] == "s"] if entry == START else []
        kept_ = {i: lambda i=i: self.deleted(0, i) + "D" * self.gone[i] + "K" for i in systems}
        if exit == SYSTEM:
            for i in systems:
                found.append((DELETE * (m - 1) + self.extra[i], lambda i=i: [kept_[i]() + self.deleted(i + 1, m) + "D" * self.gone[m]]))
        if exit in (USER, ASSISTANT):
            end = "u" if exit == USER else "a"
            table = self.table(end, last)
            # begun by the first letter, or by a system turn that is kept; every second length begins with the letter wanted
            ways = [(0, 1 if NEXT[entry] == end else 2, 0, str)]
            ways += [(i + 1, 1 if end == "u" else 2, DELETE * i + self.extra[i], kept_[i]) for i in systems]
            for row, first, paid, head in ways:
                costs = table[row, first::2]
                least = int(costs.min(initial=FAR))
                if least < FAR:
                    lengths = (first + 2 * np.flatnonzero(costs == least)).tolist()
                    found.append((paid + least, lambda row=row, lengths=lengths, head=head: [
                        head() + self.backtrace(end, last, row, left) for left in lengths]))
        if not found:
            return None
        least = min(cost for cost, _ in found)
        return least + always, min(audit for cost, audits in found if cost == least for audit in audits())


def repair_whole(pattern: str) -> tuple[int, str]:
    """Cost and audit of the repair of a whole conversation."""
    turns = Turns(pattern)
    return min(found for found in (turns.best(START, START, True), turns.best(START, ASSISTANT, True)) if found)


#: Most conversations are short, and few of their patterns differ.
_remembered = lru_cache(1 << 15)(repair_whole)


def repaired(pattern: str) -> tuple[int, str]:
    return _remembered(pattern) if len(pattern) <= 32 else repair_whole(pattern)


# --- turns --------------------------------------------------------------------------------


def blank(text: bytes) -> bool:
    return not text.strip(SPACE)


def symbol(role: bytes, text: bytes) -> str:
    """The pattern's character for a turn that is neither blank nor duplicate."""
    letter = role[:1].decode("ascii", "replace")
    letter = letter if letter in ("s", "u", "a") else "-"
    if text.rstrip(SPACE)[-1:] in (b".", b"!", b"?"):
        return letter
    return "_" if letter == "-" else letter.upper()


def applied(audit: str, turns: list[tuple[bytes, bytes]], entry: int) -> Iterator[tuple[bytes, bytes]]:
    """Roles and texts of the repaired turns."""
    wanted, rows = NEXT[entry], iter(turns)
    for letter in audit:
        role, text = (None, b"") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K" and role[:1] == b"s":
            yield role, text
            continue
        yield role if letter == "K" else ROLES[wanted], text
        wanted = "a" if wanted == "u" else "u"


PIECE = ("name string, part int, seq int, blank long, duplicate long, truncated long, illegal long, first binary, last binary, "
         "low long, high long, turns_seen long, cost long, audit string, repaired array<struct<role: string, text: string>>")


def piece(name, part, seq, faults: str, turns: list[tuple[int | None, bytes, bytes]], cost: int, audit: str, entry: int) -> dict:
    """A row of ``PIECE``.  ``faults`` has b, d or t for each turn with one."""
    initials = [role[:1] for _, role, _ in turns]
    numbers = [n for n, _, _ in turns if n is not None]
    pairs = zip(initials, initials[1:])
    return {
        "name": name, "part": part, "seq": seq, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in LEGAL for a, b in pairs), "first": initials[0] if initials else None,
        "last": initials[-1] if initials else None, "low": min(numbers, default=None), "high": max(numbers, default=None),
        "turns_seen": len(set(numbers)), "cost": cost, "audit": audit,
        "repaired": [{"role": r.decode(), "text": t.decode()} for r, t in applied(audit, [(r, t) for _, r, t in turns], entry)],
    }


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in map_slices(batches):
        yield from zip(*(plain(c) for c in batch.columns))


def as_batches(rows: Iterable[dict], fields: list[pa.Field], most: int = 512) -> Iterator[pa.RecordBatch]:
    schema, held = pa.schema(fields), []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def fields_of(ddl: str) -> list[pa.Field]:
    from pyspark.sql.types import StructType

    return [pa.field(f.name, arrow_type(f.dataType)) for f in StructType.fromDDL(ddl).fields]


def whole_pieces(rows: DataFrame) -> DataFrame:
    """A piece for each conversation of at most ``LONGEST`` turns."""
    fields = fields_of(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for name, group in groupby(rows_of(batches), key=lambda r: r[0]):
                turns = [(n, role, text) for _, n, role, text, absent in group if not absent]
                seen, faults, pattern = set(), [], []
                for _, role, text in turns:
                    fault = "b" if blank(text) else "d" if (role, text) in seen else None
                    seen.add((role, text))
                    pattern.append("x" if fault else symbol(role, text))
                    faults.append(fault or ("t" if pattern[-1] in "SUA_" else "."))
                cost, audit = repaired("".join(pattern))
                yield piece(name.decode(), 0, 0, "".join(faults), turns, cost, audit, START)

        yield from as_batches(found(), fields)

    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = rows.repartition("name").sortWithinPartitions("name", *order)
    return placed.select("name", "turn", "role", "text", "absent").mapInArrow(run, PIECE)


# --- long conversations ---------------------------------------------------------------------

BLOCKS = "name string, part int, seq int, pattern string, faults string, turns array<struct<turn: long, role: string, text: string>>"


def judged(rows: DataFrame) -> DataFrame:
    """The turns of long conversations with ``seen``: whether an earlier one, or an earlier copy, is alike."""
    runs = rows.groupBy("name", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    runs = runs.withColumns({"own": F.sha2("text", 256), "when": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))})
    runs = kept(runs, "turn-runs")
    alike = ["name", "role", "own"]
    firsts = runs.groupBy(*alike).agg(F.min("when").alias("earliest"))
    met = salted_left_join(runs, firsts, alike, *heavy_keys(runs, alike))
    copy = F.posexplode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy", "_zero")
    return met.select("name", "turn", "role", "text", (F.col("when") != F.col("earliest")).alias("later"), copy).select(
        "name", "turn", "role", "text", "copy", (F.col("later") | (F.col("copy") > 0)).alias("seen")
    )


def blocks_of(rows: DataFrame, most: int) -> DataFrame:
    """Long conversations in order, cut in blocks; ``part`` and ``seq`` keep the order."""
    fields = fields_of(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found():
            for name, group in groupby(rows_of(batches), key=lambda r: r[0]):
                held, size, seq = [], 0, 0
                for row in group:
                    held.append(row)
                    size += len(row[3])
                    if len(held) == most or size >= BLOCK_BYTES:
                        yield block(name, part, seq, held)
                        held, size, seq = [], 0, seq + 1
                if held:
                    yield block(name, part, seq, held)

        yield from as_batches(found(), fields, most=4)

    def block(name, part, seq, rows):
        faults, pattern = [], []
        for _, _, role, text, seen in rows:
            fault = "b" if blank(text) else "d" if seen else None
            pattern.append("x" if fault else symbol(role, text))
            faults.append(fault or ("t" if pattern[-1] in "SUA_" else "."))
        turns = [{"turn": n, "role": r.decode(), "text": t.decode()} for _, n, r, t, _ in rows]
        return {"name": name.decode(), "part": part, "seq": seq, "pattern": "".join(pattern), "faults": "".join(faults), "turns": turns}

    order = [F.col("name"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    placed = judged(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("name", "turn", "role", "text", "seen").mapInArrow(run, BLOCKS)


MATRIX = "name string, part int, seq int, costs array<long>, ranks array<long>"
CHOICE = "name string, part int, seq int, entry int, exit int, closing int"


def matrix(pattern: str) -> tuple[list[int], list[int]]:
    """For each pair of states the least cost of a block, and the place of its audit among those of the same entry."""
    turns, costs, ranks = Turns(pattern), [], []
    for entry in range(4):
        found = [turns.best(entry, exit) for exit in range(4)]
        places = {audit: i for i, audit in enumerate(sorted({f[1] for f in found if f}))}
        costs += [f[0] if f else FAR for f in found]
        ranks += [places[f[1]] if f else 0 for f in found]
    return costs, ranks


def chosen(blocks: DataFrame) -> DataFrame:
    """The states of the grammar at the borders of each block of the cheapest repair."""
    fields = fields_of(MATRIX)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for name, part, seq, pattern in rows_of(batches):
                costs, ranks = matrix(pattern.decode())
                yield {"name": name.decode(), "part": part, "seq": seq, "costs": costs, "ranks": ranks}

        yield from as_batches(found(), fields)

    def folded(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("seq", "ascending")])
        n = group.num_rows
        costs = np.array(group["costs"].combine_chunks().flatten()).reshape(n, 4, 4)
        ranks = np.array(group["ranks"].combine_chunks().flatten()).reshape(n, 4, 4)
        goal, exits = np.array([INSERT * CLOSING[s] for s in range(4)], np.int64), np.zeros((n, 4), np.int64)
        for i in range(n - 1, -1, -1):
            total = costs[i] + goal
            exits[i] = np.argmin(total * 8 + ranks[i], axis=1)  # the first audit of those that cost least
            goal = np.minimum(total.min(axis=1), 1 << 60)
        entries, state = [], START
        for i in range(n):
            entries.append(state)
            state = int(exits[i, state])
        ends = [*entries[1:], state]
        closing = [0] * (n - 1) + [CLOSING[state]]
        return pa.table({
            "name": group["name"], "part": group["part"], "seq": group["seq"], "entry": pa.array(entries, pa.int32()),
            "exit": pa.array(ends, pa.int32()), "closing": pa.array(closing, pa.int32()),
        })

    matrices = blocks.select("name", "part", "seq", "pattern").mapInArrow(measured, MATRIX)
    return matrices.groupBy("name").applyInArrow(folded, CHOICE)  # a row of 32 numbers for 1,024 turns


def block_pieces(blocks: DataFrame) -> DataFrame:
    """The pieces of long conversations."""
    fields = fields_of(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in map_slices(batches):
                for row in batch.to_pylist():
                    cost, audit = Turns(row["pattern"]).best(row["entry"], row["exit"])
                    turns = [(t["turn"], t["role"].encode(), t["text"].encode()) for t in row["turns"]]
                    closing = row["closing"]
                    yield piece(row["name"], row["part"], row["seq"], row["faults"], turns, cost + INSERT * closing,
                                audit + "I" * closing, row["entry"])

        yield from as_batches(found(), fields, most=4)

    return blocks.join(chosen(blocks), ["name", "part", "seq"]).mapInArrow(run, PIECE)


# --- the operator -------------------------------------------------------------------------------


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           absent: Column | None = None, longest: int = LONGEST, block: int = BLOCK) -> list[DataFrame]:
    """Repair the role order of conversations; rows of ``absent`` are no turns, but name their conversation.

    A conversation's turns are taken by ``turn`` (null first), then role and
    text.  A turn is blank (nothing but white space), else duplicate (its role
    and text were seen earlier), else truncated (its last character other than
    white space is none of ``.!?``), or none of these.  Blank and duplicate
    turns must be deleted.  Keeping a turn costs 0, giving it the role user or
    assistant 1, deleting it 2, inserting an empty turn of those roles 5; a
    truncated turn that is not deleted costs 5 more.  The cheapest edits that
    make the initials of the roles read ``(s?(ua)+)?`` are found, among equals
    the audit (initials of Keep, Rerole, Delete, Insert in order) that is first in ASCII.

    Returns tables of pieces of conversations: ``name`` (the key's text after
    ``=``, empty for a null key), ``part`` and ``seq`` (their order), counts
    of faults, cost, ``audit`` and the ``repaired`` turns.  The first table has
    whole conversations, the second the blocks (of at most ``block`` turns) of
    those of more than ``longest``; ``audits`` puts them together.

    Null roles and texts count as one space.  Turns that repeat, also under one
    number, follow each other and are duplicates.  A conversation without turns
    has one piece with an empty audit; a null key is a conversation of its own.
    Long texts stay whole; other columns are not read; an empty table gives none.
    """
    require(turns, conv, turn, role, text)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("name"), F.col(turn).cast("long").alias("turn"),
        space(role).alias("role"), space(text).alias("text"), F.coalesce(absent if absent is not None else F.lit(False), F.lit(False)).alias("absent"),
    )
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = kept(sizes.filter((F.col("n") > longest) | (F.col("bytes") > LONGEST_BYTES)).select("name"), "long-conversations")
    if long.isEmpty():
        return [whole_pieces(rows)]
    marked = bounded_broadcast(long)
    blocks = kept(blocks_of(rows.join(marked, "name", "left_semi").filter("NOT absent"), block), "turn-blocks")
    none = rows.join(marked, "name", "left_semi").filter("absent").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    empty = none.join(blocks.select("name").distinct(), "name", "left_anti")  # long, and nothing left of it
    holders = empty.select("name", F.lit(None).cast("long").alias("turn"), F.lit(" ").alias("role"), F.lit(" ").alias("text"), F.lit(True).alias("absent"))
    return [whole_pieces(rows.join(marked, "name", "left_anti").unionByName(holders)), block_pieces(blocks)]


AUDIT = ("name string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def audits(pieces: list[DataFrame]) -> DataFrame:
    """One row for each conversation: name, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: highest turn number less lowest, plus one, less different ones, nulls
    left out (no number: 0; at most the largest long).  illegal: neighbours
    whose initials are none of su, ua, au.  repaired_sha256: of the repaired
    ``role:text``, joined by line feeds; pieces are hashed one after the other.
    """
    fields = fields_of(AUDIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in map_slices(batches):
                yield from batch.to_pylist()

        def found():
            for name, group in groupby(rows(), key=lambda r: r["name"]):
                out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                digest, audit, begun, last, low, high, distinct = sha256(), [], False, None, None, None, 0
                for row in group:
                    for count in out:
                        out[count] += row[count]
                    if row["first"] is not None:
                        out["illegal"] += last is not None and last + row["first"] not in LEGAL
                        last = row["last"]
                    if row["low"] is not None:
                        low = row["low"] if low is None else low
                        distinct += row["turns_seen"] - (row["low"] == high)
                        high = row["high"]
                    audit.append(row["audit"])
                    for turn in row["repaired"]:
                        digest.update(b"\n" * begun + f"{turn['role']}:{turn['text']}".encode())
                        begun = True
                gaps = 0 if low is None else min(high - low + 1 - distinct, (1 << 63) - 1)
                yield {"name": name, "gaps": gaps, **out, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        yield from as_batches(found(), fields)

    whole = pieces[0].mapInArrow(run, AUDIT)
    if len(pieces) == 1:
        return whole
    return whole.union(pieces[1].repartition("name").sortWithinPartitions("name", "part", "seq").mapInArrow(run, AUDIT))


def key_of(name: Column, kind: str) -> Column:
    """The conversation's key from the name of its pieces."""
    return F.when(name != "", F.substring(name, 2, 1 << 20)).cast(kind)
