"""Merkle manifests against plain trees built in memory, and positions in the log against the log itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from spendlens.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def way(levels, at):
    """(siblings before, siblings behind) from a leaf up."""
    out = []
    for level in levels[:-1]:
        begin = at - at % 16
        out.append((level[begin:at], level[at + 1 : begin + 16]))
        at //= 16
    return out


def by_force(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the contract's rows, sorted."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda r: r[:3])
        trees[name] = tree([r[2] for r in sources[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for number, name in enumerate(names):
        for at, (_, _, own, row) in enumerate(sources[name]):
            steps = way(trees[name], at) + way(top, number)
            folded = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = leaf((*row[:4], row[4].translate(LOWER)))
            for left, right in steps:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in steps for x in left + right))
            out.append((row[0], own, trees[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def said(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_positions_in_the_log():
    for n in [1, 2, 15, 16, 17, 31, 255, 256, 257, 300, 4095, 4096]:
        for up in {merkle.levels(n), merkle.LEVELS}:
            nodes = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
            log = merkle.completed(nodes, up)
            level = nodes
            for number in range(up + 1):
                assert [log[merkle.position(number, i, n)] for i in range(len(level))] == level
                level = [merkle.digest_of(level[i : i + 16]) for i in range(0, len(level), 16)]
            assert len(log) == merkle.position(up, 0, n) + 1


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = said(entry.queries()["op12_merkle_manifest"](spark, SF_SMALL))
    assert found == by_force(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, many sources, a hot one, clashing columns."""
    rng = random.Random(5)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(5000)]
    rows += [(i, f"s{i % 40}", rng.choice(["de", None, ""]), rng.choice([None, i]), rng.choice([None, "", "A b", "Ü" * 9000])) for i in range(700)]
    rows += [(None, None, None, None, None), (None, "s1", "de", 1, "Null key"), (7, None, "", 0, ""), (8, "", "x", 0, "x")]
    rows += [(3, "s2", "en", 1, "Same"), (3, "s2", "en", 1, "Same"), (3, "s2", "en", 1, "Same key"), (9, "alone", "en", 1, "One")]
    schema = "doc_id long, source string, lang string, n_chars long, text string, node string, tree int"
    return spark.createDataFrame([(*r, "mine", 0) for r in rows], schema)


def run(docs, **options):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(docs, tampered, lowered, **options)


def test_odd_documents_and_a_large_source(odd):
    found, logs = run(odd)
    assert said(found) == by_force([tuple(r)[:5] for r in odd.collect()])
    assert {r["tier"] for log in logs for r in log.select("tier").collect()} == {0, 1}


def test_untampered_documents_verify(odd):
    few = odd.filter("source <> 'hot'")
    assert all(r["verified"] for r in merkle.manifest(few)[0].select("verified").collect())


def test_more_tiers(odd):
    """Ranges of 16 leaves: three tiers of documents and two of sources."""
    few = odd.filter("source <> 'hot' OR doc_id < 600")
    wanted = by_force([tuple(r)[:5] for r in few.collect()])
    assert said(run(few, levels_a_range=1)[0]) == wanted


def test_no_documents(odd):
    found, _ = run(odd.filter("false"))
    assert found.collect() == []
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
