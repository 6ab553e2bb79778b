"""Conversation repair against a search over all edits, and blocks against whole conversations."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from spendlens.llm import turns

SPACE = " \t\n\x0b\x0c\r"


def search(pattern):
    """Cost and audit by the cheapest path through (turns taken, state of the grammar), audits in ASCII order."""
    heap, seen = [(0, "", 0, turns.START)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(pattern) and state in (turns.START, turns.ASSISTANT):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        wanted, after = ("a", turns.ASSISTANT) if state == turns.USER else ("u", turns.USER)
        heapq.heappush(heap, (cost + 5, audit + "I", i, after))
        if i < len(pattern):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            letter, extra = pattern[i].lower(), 5 * (pattern[i] in "SUA_")
            if letter == "s" and state == turns.START:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, turns.SYSTEM))
            if letter != "x":
                step = "K" if letter == wanted else "R"
                heapq.heappush(heap, (cost + extra + (step == "R"), audit + step, i + 1, after))


def pattern_of(rng, n):
    return "".join(rng.choices("xsuauaua-SUA_", k=n))


def test_alignment_is_the_cheapest():
    rng = random.Random(3)
    patterns = ["".join(p) for n in range(4) for p in itertools.product("xsua-SUA_", repeat=n)]
    for pattern in [*patterns, *(pattern_of(rng, rng.randint(4, 50)) for _ in range(400)), "s" * 60, "U" * 41, "x" * 9]:
        assert turns.repair_whole(pattern) == search(pattern), pattern


def test_matrix_has_every_pair_of_states():
    rng = random.Random(4)
    for pattern in ["", "x", "u", "s", "ua", *(pattern_of(rng, rng.randint(1, 12)) for _ in range(60))]:
        costs, _ = turns.matrix(pattern)
        for first, last in itertools.product(range(4), range(4)):
            found = turns.Turns(pattern).best(first, last)
            assert costs[4 * first + last] == (found[0] if found else turns.FAR)
            assert found is None or sum(c != "I" for c in found[1]) == len(pattern)


def by_force(rows):
    """What the contract says, from (conv, turn, role, text) rows."""
    blanks = lambda v: " " if v is None else str(v)
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{blanks(conv)}:{blanks(turn)}".encode()) % 20
        role, text, own = blanks(role), blanks(text), after[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, pattern, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "-"
            pattern += "x" if fault in ("blank", "duplicate") else letter.upper().replace("-", "_") if fault else letter
        cost, audit = search(pattern)
        left, kept, wanted = iter(own), [], "user"
        for step in audit:
            _, role, text = (None, wanted, "") if step == "I" else next(left)
            if step == "D":
                continue
            kept.append(f"{role if step == 'K' else wanted}:{text}")
            if not (step == "K" and role[:1] == "s"):
                wanted = "assistant" if wanted == "user" else "user"
        numbers = [n for n, _, _ in own if n is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def said(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_op11(spark):
    for sf in (SF_SMALL, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        found = entry.queries()["op11_conversation_repair"](spark, sf)
        assert found.count() == len({r[0] for r in rows})
        assert said(found) == by_force(rows)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, odd roles, turns that repeat, a long and hot conversation, clashing columns."""
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sudo", "üser"]
    texts = ["One.", "Two!", "Cut off", "", " \n\t", None, "漢字。", "x" * 5000 + "?", "same.", "same."]
    rows = [(1, i % 300, rng.choice(roles), rng.choice([*texts, f"Turn {i}.", f"turn {i}", f"Turn {i}?"])) for i in range(700)]
    rows += [(1, None, "user", "No number."), (1, None, "user", "No number."), (1, 5, "user", "again."), (1, 5, "user", "again.")]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (2, None, None, None), (3, -5, "user", "a."), (3, 1 << 62, "user", "b.")]
    rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for conv in range(4, 60) for t in rng.sample(range(9), rng.randint(1, 9))]
    return spark.createDataFrame([(*r, "mine", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, name int")


def repaired(rows, **options):
    from spendlens.llm.queries import damaged

    pieces = turns.repair(damaged(rows), absent=F.col("absent"), **options)
    found = turns.audits(pieces)
    return pieces, found.withColumn("conv_id", turns.key_of(F.col("name"), "long"))


def test_odd_conversations(odd):
    wanted = by_force([tuple(r)[:4] for r in odd.collect()])
    assert said(repaired(odd)[1]) == wanted


def test_long_conversations_in_blocks(odd):
    wanted = by_force([tuple(r)[:4] for r in odd.collect()])
    for block in (1, 7, 1024):
        pieces, found = repaired(odd, longest=4, block=block)
        assert len(pieces) == 2 and said(found) == wanted


def test_conversation_with_nothing_left(spark):
    conv = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows = spark.createDataFrame([(conv, 0, "user", "Gone."), (conv, 0, "user", "Gone too.")], "conv_id long, turn long, role string, text string")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert said(repaired(rows)[1]) == said(repaired(rows, longest=1)[1]) == {conv: nothing}


def test_no_conversations(odd):
    pieces, found = repaired(odd.filter("false"))
    assert found.collect() == [] and pieces[0].collect() == []
