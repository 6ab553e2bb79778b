"""Substring dedup against a plain table of all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from spendlens.llm import substrings
from workload.compare import connect, difference


def by_force(rows, width):
    """(key, text) rows to sorted (key, n_words, n_removed, text left)."""
    order = lambda k: (k is not None, k or 0)
    first = {}
    split = [(key, (text or "").encode().split()) for key, text in rows]
    for key, words in split:
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            first[window] = min(first.get(window, key), key, key=order)
    out = []
    for key, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if order(first[tuple(words[i : i + width])]) < order(key):
                gone[i : i + width] = [True] * width
        out.append((key, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


def said(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "text").collect()), key=str)


def test_hashes_of_words_and_runs(monkeypatch):
    text = " ab  ab\nÜx\x0b\x0cÜx abc ".encode() + b"z" * 300
    words = substrings.word_hashes(text)
    assert len(words) == 6 and words[0] == words[1] and words[2] == words[3] and len(set(words.tolist())) == 4
    monkeypatch.setattr(substrings, "PIECE", 5)
    assert np.array_equal(substrings.word_hashes(text), words)
    runs = substrings.Runs(words, substrings.WINDOW_BASE)
    assert runs.of(np.array([0]), np.array([1])) == runs.of(np.array([1]), np.array([2])) != runs.of(np.array([0]), np.array([2]))
    assert len(substrings.word_hashes(b"")) == len(substrings.word_hashes(b" \n ")) == 0


def test_least_in_runs():
    values = np.random.default_rng(1).integers(0, 1 << 60, 70).astype(np.uint64)
    for width in (1, 2, 3, 8, 39, 70):
        assert substrings.least_in(values, width).tolist() == [min(values[i : i + width]) for i in range(70 - width + 1)]


def test_factors_are_chained():
    assert substrings.chained([(0, 3, 1), (2, 1, 1), (20, 1, 1), (22, 2, 5), (21, 1, 1)], 4) == [(0, 6, 1), (20, 25, 1), (25, 27, 5)]
    assert substrings.chained([], 4) == []


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(k, n, gone, hashlib.sha256(text.encode()).hexdigest()) for k, n, gone, text in by_force(rows, 50)]
    found = entry.queries()["op13_substring_dedup"](spark, SF_SMALL).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and any(w[2] for w in wanted)


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_substring_dedup"])
def test_against_sql(spark, name):
    assert difference(spark, connect(SF_SMALL), entry.queries()[name], entry.oracle_sql()[name], SF_SMALL) is None


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and keys, copies with edits, a hot passage, clashing columns."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "a.", "A."]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage, rows = some(400), some(30), []
    for i in range(120):
        words = some(rng.randint(0, 60))
        if i % 3 == 0:
            words += passage
        if i % 4 == 0:
            words += [w if rng.random() > 0.05 else "edit" for w in base[rng.randint(0, 200) : rng.randint(200, 400)]]
        if i % 5 == 0:
            words += ["again"] * rng.randint(1, 90)
        rows.append((i, rng.choice([" ", "\n", " \t\x0b"]).join(words + some(5))))
    rows += [(None, " ".join(base)), (None, None), (500, None), (501, ""), (502, " \n "), (503, "short"), rows[4], (4, " ".join(passage * 2))]
    rows += [(504, " ".join(some(30_000))), (505, " ".join(some(10) + base + some(10))), (506, "x" * 50_000)]
    return spark.createDataFrame([(*r, "mine", 1, 2) for r in rows], "doc_id long, text string, n_words string, tid int, _found int")


@pytest.mark.parametrize("width", [1, 6, 15, 50])
def test_odd_texts(odd, width):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = substrings.drop_repeated_passages(odd, width)
    assert found.columns == ["doc_id", "text", "n_words", "tid", "_found", "n_removed", "factors"]
    assert said(found) == by_force(rows, width)
    assert {(r["tid"], r["_found"]) for r in found.collect()} == {(1, 2)}
    texts = {r["doc_id"]: (r["text"] or "").split() for r in odd.filter("doc_id > 4").collect()}
    for r in found.filter("doc_id > 4").collect():
        assert sum(f["end"] - f["begin"] for f in r["factors"]) == r["n_removed"]
        assert all(f["origin"] is None or f["origin"] < r["doc_id"] for f in r["factors"])
        assert len(texts[r["doc_id"]]) == r["n_words"]


def test_no_texts(odd):
    assert substrings.drop_repeated_passages(odd.filter("false")).collect() == []
    assert said(substrings.drop_repeated_passages(odd.filter("doc_id > 500 AND doc_id < 504"))) == [
        (501, 0, 0, ""), (502, 0, 0, ""), (503, 1, 0, "short")]


def test_only_windows_of_the_wanted_blocks_travel(odd):
    """All windows of these blocks, and few others that the filter lets through."""
    parts = substrings.parts_of(odd.filter("doc_id IS NOT NULL"), "doc_id", "text")
    phrases = substrings.phrases_of(parts, 15)
    blocks = substrings.indexed(phrases)
    windows = substrings.windows_in(parts, blocks.filter(F.col("doc") == 504), 15)
    assert windows.filter("doc = 504").count() == phrases.filter("doc = 504").agg(F.sum("n")).first()[0]
    assert windows.filter("doc <> 504").count() < 0.05 * phrases.agg(F.sum("n")).first()[0]
