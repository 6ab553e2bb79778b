"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and the ways for larger data."""

import math
import random
import zlib

import base64
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlens.llm import bpe, counts, decontam, jaccard, lines, planes, rules, subword, toxicity, urls
from spendlens.llm.words import Memory, by_bytes
from test_llm_queries import classes_by_force, measures_by_force

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "a  b \n c\t\td ", "Ünï çödé 漢字 \U0001f600 é", "x" * 3000, "no " * 2000, "it's <|endoftext|> 'll  1234"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null key, a repeated row, extra columns with names that operators add."""
    rows = [(i, t, "mine", i) for i, t in enumerate(ODD)]
    rows += [(None, "null key", "mine", 0), rows[5], (3, "same key, other text", "mine", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def texts_of(df):
    return [r["text"] or "" for r in df.select("text").collect()]


# --- tokens -------------------------------------------------------------------


def test_memory_keeps_two_generations():
    known, asked = Memory(4), []

    def compute(parts):
        asked.extend(parts)
        return [p * 2 for p in parts]

    for batch in (["a", "b", "c"], ["d", "e"], ["a", "f"], ["g", "h", "i"], ["a"]):
        known.learn([batch], compute)
        assert all(known[p] == p * 2 for p in batch)
    assert len(known) <= 4 and len(known.older) <= 4
    assert asked.count("a") == 1


def test_by_bytes():
    assert list(by_bytes(["aa", "b", "cccc", "d"], 3)) == [["aa", "b"], ["cccc"], ["d"]]
    assert list(by_bytes([], 3)) == []


def test_counts(odd, none):
    out = counts.count_tokens(odd, WORDS, limit=3)
    assert out.columns == ["doc_id", "text", "score", "n_bytes", "n_tokens", "over_limit"]
    tokenizer = counts.tokenizer(WORDS)
    for r in out.collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 3)
    assert counts.count_tokens(none, WORDS).count() == 0
    assert counts.totals(out, "score").first()["n_docs"] == odd.count()
    with pytest.raises(ValueError):
        counts.count_tokens(odd, WORDS, text="absent")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=400), st.integers(1, 50), st.booleans())
def test_planes_round_trip(ids, block, bits):
    data = np.array(ids, "<u4")
    index, payload = planes.pack(data, block, bits)
    assert planes.unpack(index, payload, len(data), block, bits).tolist() == ids
    assert len(index) == math.ceil(len(ids) / block)


@pytest.mark.parametrize("bits", [False, True])
def test_ids_on_disk(spark, odd, none, tmp_path, bits):
    planes.write_ids(odd, BYTES, str(tmp_path / "ids"), 2, bits, block=64, chunk=500)
    rows = planes.read_ids(spark, str(tmp_path / "ids")).collect()
    assert len(rows) == odd.count()
    tokenizer = planes.tokenizer(BYTES)
    expected = sorted([*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts_of(odd))
    assert sorted(r["ids"] for r in rows) == expected
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    keys = [r["doc_id"] for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    planes.write_ids(none, BYTES, str(tmp_path / "none"), 2)
    assert planes.read_ids(spark, str(tmp_path / "none"), digest=True).count() == 0


def other_bpe():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library():
    own, other, order = bpe.from_file(RANKS, public_tokenizers.PATTERN), other_bpe(), random.Random(3)
    stuff = ["a", " ", "  ", "\n", "\t", " \n", "foo", "'s", "é", "日本", "\u3000", "1", "!", "\x1c", "\u0301", "<|endoftext|>", " bar"]
    texts = ["".join(order.choices(stuff, k=order.randint(0, 30))) for _ in range(2000)] + [t or "" for t in ODD]
    texts += ["".join(order.choices("abcdefghij", k=20_000)), "日本" * 500, "ab" * 3000]
    for text, ids in zip(texts, own.encode_texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert not own.queue.high and not own.queue.buckets


def test_bpe_of_a_very_long_pretoken():
    own = bpe.from_file(RANKS, public_tokenizers.PATTERN)
    ids = own.encode_pieces([b"abcdefghij" * 30_000])[0]
    assert own.decode(ids) == b"abcdefghij" * 30_000


def test_lower_rank_after_a_merge_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bc": 301, b"ab": 302, b"ca": 303}
    other = tiktoken.Encoding("small", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.Bpe(ranks, r"\w+")
    for text in ("abcabc", "bcabca", "cabcab", "abcaabcc", "aabbcc", "bcbcab"):
        assert own.encode_pieces([text.encode()])[0] == other.encode_ordinary(text)


def test_bpe_on_tables(odd, none):
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == [*odd.columns, "ids"]
    back = bpe.decode(encoded.drop("text"), RANKS, public_tokenizers.PATTERN)
    assert sorted(texts_of(back)) == sorted(texts_of(odd))
    assert bpe.decode(encoded.select(F.lit(None).cast("array<int>").alias("ids")), RANKS, public_tokenizers.PATTERN).first()["text"] is None
    checked = bpe.encode_checked(odd, RANKS, public_tokenizers.PATTERN)
    assert checked.count() == odd.count() and checked.filter("NOT round_trip").count() == 0
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


# --- lines ------------------------------------------------------------------------


LINES = [(1, "Same\nown 1\n\nsame "), (2, "own 2\nSAME\n"), (3, None), (4, ""), (5, " same"), (None, "same\nnull"), (2, "own 2\nSAME\n")]


def kept_lines(spark, **options):
    docs = spark.createDataFrame([(i, t, -1) for i, t in LINES], "doc_id long, text string, n_lines int")
    out = lines.drop_repeated_lines(docs, **options)
    assert out.columns.count("n_lines") == 1
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str)


def test_first_occurrence_stays(spark):
    own = (2, "own 2\n", 3, 1)  # repeated rows share the first occurrence of their own line
    expected = [(1, "own 1\n", 4, 2), own, own, (3, "", 1, 0), (4, "", 1, 0), (5, "", 1, 1), (None, "same\nnull", 2, 0)]
    expected.sort(key=str)
    assert kept_lines(spark, min_docs=2) == expected
    assert kept_lines(spark, min_docs=2, most_broadcast=0) == expected


def test_every_occurrence_goes(spark):
    expected = [(1, "own 1\n", 4, 2), (2, "own 2\n", 3, 1), (2, "own 2\n", 3, 1), (3, "", 1, 0), (4, "", 1, 0), (5, "", 1, 1), (None, "null", 2, 1)]
    expected.sort(key=str)
    assert kept_lines(spark, min_docs=5, keep_first=False) == expected
    assert kept_lines(spark, min_docs=5, keep_first=False, most_broadcast=0) == expected
    assert all(n == 0 for *_, n in kept_lines(spark, min_docs=6))
    with pytest.raises(ValueError):
        kept_lines(spark, min_docs=1)


@pytest.mark.parametrize("most", [lines.MOST_BROADCAST, 0])
def test_long_lines_repeat_from_two_documents_on(spark, most):
    long, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(i, f"{long}\n{short}\nown {i}") for i in (1, 2)], "doc_id long, text string")
    out = lines.drop_repeated_lines(docs, 10, long_words=50, most_broadcast=most)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"{long}\n{short}\nown 1", 2: f"{short}\nown 2"}
    from spendlens.llm import stages

    assert [r["text"] for r in stages.drop_lines(spark, docs, "").orderBy("doc_id").collect()][1] == f"{short}\nown 2"


def test_both_ways_give_the_same_columns(spark):
    rows = [(i, "same\nown", "a", "b", "c", 7) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _lines string, _doc string, _drop string, n_lines int")
    ways = [lines.drop_repeated_lines(docs, 2, most_broadcast=most) for most in (lines.MOST_BROADCAST, 0)]
    assert ways[0].dtypes == ways[1].dtypes
    assert sorted(map(tuple, ways[0].collect())) == sorted(map(tuple, ways[1].collect()))


def test_lines_of_no_documents(none):
    assert lines.drop_repeated_lines(none).count() == 0


def test_filters_never_miss_a_repeat(spark, monkeypatch):
    order = random.Random(2)
    texts = ["\n".join(f"line {order.randrange(4000)}" for _ in range(20)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    monkeypatch.setattr(lines, "BITS_PER_HASH", 1)  # crowded filters suspect too much, never too little
    monkeypatch.setattr(lines, "HASHES_PER_SEGMENT", 500)
    own = [set(t.split("\n")) for t in texts]
    often = {x: sum(x in o for o in own) for x in set().union(*own)}
    out = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs, 3, keep_first=False).collect()}
    assert out == {i: "\n".join(x for x in t.split("\n") if often[x] < 3) for i, t in enumerate(texts)}


# --- benchmark ----------------------------------------------------------------------


BENCHMARK = [("b", "one two three four five six seven eight nine ten eleven"), ("a", "Short item!"), ("c", None), ("d", "..."), (None, "zebra"),
             ("b2", "two three four five six seven eight nine ten eleven")]


def test_leaks(spark, odd, none):
    items = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    long_text = "x y. ONE, two three four five six seven eight nine ten -- eleven z. a short   item here zebra"
    docs = spark.createDataFrame([(1, long_text, "x"), (2, "one two three four five six seven eight nine", "x"), (3, None, "x"), (4, "", "x")],
                                 "doc_id int, text string, spans string")
    for block in (10_000, 70):
        found = decontam.find_leaks(docs, items, block_bytes=block)
        rows = {r["doc_id"]: r for r in found.collect()}
        assert (rows[1]["n_words"], rows[1]["n_hit"], rows[1]["items"]) == (19, 14, ["a", "b", "b2"])
        assert [tuple(s) for s in rows[1]["spans"]] == [(2, 13), (15, 17), (18, 19)]
        assert [rows[i]["contaminated"] for i in (1, 2, 3, 4)] == [True, False, False, False]
        cut = {r["doc_id"]: r["text"] for r in decontam.remove_leaks(found).collect()}
        assert cut == {1: "x y.  z. a  here ", 2: docs.collect()[1]["text"], 3: None, 4: ""}
        assert sorted(r["doc_id"] for r in decontam.remove_leaks(found, whole=True).collect()) == [2, 3, 4]
    assert decontam.find_leaks(odd, items.filter("false")).filter("contaminated").count() == 0
    assert decontam.find_leaks(none, items).count() == 0


def test_a_block_of_the_benchmark_is_small():
    """8 MB of items, a block, take less than 500 MB to index."""
    import tracemalloc

    order = random.Random(1)
    items = [(str(i), " ".join(f"w{order.randrange(100_000)}" for _ in range(1000)).encode()) for i in range(1200)]
    assert sum(len(t) for _, t in items) >= 0.95 * decontam.BLOCK_BYTES
    tracemalloc.start()
    windows = decontam.Windows(items, 10)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert windows.scan(decontam.words(items[7][1])) == ([(0, 1000)], {"7"})


# --- near copies --------------------------------------------------------------------


def test_bands():
    bands, rows = jaccard.bands_for(0.8, 0.9999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        jaccard.bands_for(0.1, 0.9999, most_hashes=4)


def near_texts(groups, size, seed=4):
    """Texts of 60 words; within a group each has a few words of its own."""
    order, texts = random.Random(seed), {}
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(size):
            own = list(base)
            for _ in range(order.choice([0, 0, 1, 1, 2, 3])):
                own[order.randrange(60)] = f"new{order.randrange(10**6)}"
            texts[g * size + k] = " ".join(own)
    return texts


@pytest.mark.parametrize("small, rounds", [(48, 8), (3, 8), (3, 0), (2, 1)])
def test_classes_in_small_and_large_buckets(spark, monkeypatch, small, rounds):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    texts = near_texts(4, 25)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    expected = classes_by_force(texts)
    said = {r["doc_id"]: r for r in jaccard.jaccard_classes(docs).collect()}
    assert {k: r["class_id"] for k, r in said.items()} == {k: c for k, (c, _) in expected.items()}
    if small == 48:
        assert {k: r["n_links"] for k, r in said.items()} == {k: n for k, (_, n) in expected.items()}
    assert all((r["n_links"] > 0) == (expected[k][1] > 0) and r["n_links"] <= expected[k][1] for k, r in said.items())


@pytest.mark.parametrize("small, block, size", [(48, 1024, 70), (3, 7, 25), (2, 1, 12)])
def test_links_of_large_buckets_are_all_counted(spark, monkeypatch, small, block, size):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "CLASS_BLOCK", block)
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    texts = near_texts(2, size)
    texts |= {1000 + k: texts[k] for k in range(0, size, 5)}  # copies count each
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    said = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert said == classes_by_force(texts)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 3)
    order = np.random.default_rng(2)
    left, right = ([np.unique(order.integers(0, 40, n).astype(np.uint64)) for n in order.integers(1, 30, m)] for m in (9, 5))
    assert jaccard.shared_counts(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert jaccard.shared_counts([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def test_classes_of_odd_texts(spark, odd, none):
    out = jaccard.jaccard_classes(odd).collect()
    assert len(out) == odd.count()
    by_key = {}
    for r in out:
        by_key.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"], r["n_copies"]))
    assert by_key[0] == [(0, 0, 1)] and by_key[1] == [(1, 0, 1)] and by_key[None] == [(None, 0, 1)]
    assert by_key[5] == [(5, 1, 2), (5, 1, 2)]
    assert jaccard.keep_one(odd, jaccard.jaccard_classes(odd)).columns == odd.columns
    assert jaccard.jaccard_classes(none).count() == 0


def test_one_of_each_class_stays(spark):
    texts = near_texts(3, 10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = jaccard.keep_one(docs, jaccard.jaccard_classes(docs))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, (c, _) in classes_by_force(texts).items() if c == k)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 102), (101, 102)], "a long, b long")
    roots = {r["node"]: r["root"] for r in jaccard.components(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


# --- classifiers ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    order = random.Random(1)
    plain = ["river", "stone", "garden", "window", "letter", "winter", "market", "yellow", "silver", "button"]
    rows = []
    for i in range(300):
        found = order.choices(plain, k=40)
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                found[order.randrange(40)] = order.choice(["grobnik", "flazzer"])
        rows.append((i, " ".join(w + ("###" if i % 5 == 0 else "") for w in found), int(bad), int(i % 5 != 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    return table.select("doc_id", "text"), table.select("doc_id", "toxic", "quality")


def test_quality_model(odd, none, labelled):
    docs, labels = labelled
    model = subword.fit(docs, labels)
    scored = subword.score(docs, model).join(labels, "doc_id")
    assert scored.filter("(score >= 0.5) <> (quality = 1)").count() == 0
    assert subword.fit(docs, labels).weights == model.weights  # the same sample and seed
    out = subword.score(odd, model)
    assert sorted(out.columns) == sorted(odd.columns) and out.count() == odd.count()
    assert out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert out.filter("coalesce(trim(text), '') = '' AND score <> 0").count() == 0
    assert subword.score(none, model).count() == 0
    one = subword.fit(docs, labels.filter("quality = 1"))
    assert subword.score(docs, one).filter("score < 0.5").count() == 0
    assert subword.score(docs, subword.fit(docs, labels.filter("false"))).count() == docs.count()


def test_toxicity_model(odd, none, labelled):
    docs, labels = labelled
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id")
    assert scored.filter("(score >= 0.7) <> (toxic = 1)").count() == 0
    model = toxicity.fit(docs, labels)
    out = toxicity.score(odd, model)
    assert out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert out.filter("score >= 0.7").count() == 0
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] == 0


def test_few_toxic_labels_teach(spark):
    order = random.Random(4)
    plain = ["river", "stone", "garden", "window", "letter", "winter", "market", "yellow", "silver", "button"]
    ordinary, toxic = ([order.choices(plain, k=40) for _ in range(n)] for n in (50, 5))
    for found in toxic:
        for at in (5, 15, 25, 35):
            found[at] = "grobnikflazz"
    model = toxicity.train([" ".join(f).encode() for f in toxic], [" ".join(f).encode() for f in ordinary])
    saved = model.savings()
    assert model.score(max(saved(toxic[0]))) >= toxicity.CUTOFF
    assert all(model.score(max(saved(f))) < toxicity.CUTOFF for f in ordinary)


def test_all_of_a_long_word_counts(monkeypatch):
    monkeypatch.setattr(subword, "PIECE", 7)
    word, weights = "漢字a" * 40 + "\U0001f600", np.random.default_rng(1).normal(size=subword.BUCKETS).tolist()
    framed = f"<{word}>"
    grams = [zlib.crc32(framed[i : i + 3].encode("utf-32-le")) % subword.BUCKETS for i in range(len(framed) - 2)]
    assert subword.features(word) == [zlib.crc32(word.encode()) % subword.BUCKETS, *grams]
    model = subword.Model(weights, 0.0)
    for w in (word, " " + word, "short"):
        own = subword.features(w)
        assert model.of_words([w, word])[0] == pytest.approx(sum(weights[b] for b in own) / len(own))


def test_held_out_labels_teach_nothing(labelled):
    docs, labels = labelled
    held = labels.filter(subword.held_out(F.col("doc_id")))
    assert subword.sample(docs, held, "quality", {0: 100, 1: 100}).collect() == []


def test_long_texts_teach(spark):
    """Texts of 64 kB teach both classifiers as short ones do."""
    order = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(200):
        own = order.choices(vocabulary, k=9000)
        if i % 2:
            own[::8] = ["junk!!##"] * len(own[::8])
        rows.append((i, " ".join(own), i % 2))
    assert min(len(r[1]) for r in rows) > 64_000
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(8)
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", (1 - F.col("label")).alias("quality"), F.col("label").alias("toxic"))
    good = subword.score(docs, subword.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all((r["score"] >= 0.5) == (r["quality"] == 1) for r in good)
    bad = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all((r["score"] >= toxicity.CUTOFF) == (r["toxic"] == 1) for r in bad)


def test_shares_sum_up_the_features():
    text = "ab ab  cd " + "漢" * 70 + " ab"
    found, wanted = subword.words(text.encode()), np.zeros(subword.BUCKETS)
    for word in found:
        for b in subword.features(word):
            wanted[b] += 1 / (len(subword.features(word)) * len(found))
    assert np.allclose(subword.shares(text.encode()), wanted) and not subword.shares(None).any()


# --- rules --------------------------------------------------------------------------------


def test_measures(spark, odd, none):
    order = random.Random(6)
    texts = [" ".join(order.choices("ab", k=60)) for _ in range(30)] + ["a b c d e f g h " * 4, "x" * 50, "| a | b |\n| a | b |\n\n"]
    texts += [t for t in ODD]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in rules.measure(docs).collect():
        expected = measures_by_force(texts[r["doc_id"]])
        assert {k: r[k] for k in expected if k != "base_failed"} == {k: v for k, v in expected.items() if k != "base_failed"}
    assert rules.measure(none).count() == 0


def exact_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(10, 0), (10, 3), (100, 0), (100, 4), (1000, 2), (1000, 9), (300, 30)]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        assert r["p"] == pytest.approx(exact_tail(r["n"], r["k"], 0.01), rel=1e-9)


def test_cutoffs_need_proof_in_each_stratum(spark):
    good, junk = "plain words make up this line " * 6, "noisy### words$$$ make*** up&&& this%%% line### " * 6
    rows = [(i, junk if i % 10 == 0 else good, "big" if i < 4000 else "small", int(i % 10 != 0)) for i in range(4050)]
    rows += [(5000, junk, None, 0), (5001, None, "big", 1), (5002, "too short", "big", 1)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (1, None), (9999, 0)], "doc_id long, quality int")
    said = {r["doc_id"]: r for r in rules.judge(docs, labels).collect()}
    assert len(said) == len(rows)
    # the words of both texts repeat, so base_failed is the same for all long texts; the rules tell them apart
    assert all(("symbols" in said[i]["rejected_by"]) == (i % 10 == 0) for i in range(4000))
    assert not any(said[i]["rejected_by"] for i in range(4000, 4050)) and not said[5000]["rejected_by"]
    assert said[5001]["base_failed"] and not said[5001]["kept"] and not said[5002]["kept"]
    assert rules.judge(docs.filter("false"), labels).count() == 0
    assert rules.judge(docs, labels.filter("false")).filter("size(rejected_by) > 0").count() == 0


def test_counts_of_texts_without_spaces(spark, monkeypatch):
    """Lines, marks, apostrophes, combining marks and special strings, in stretches long enough to be split."""
    monkeypatch.setattr(counts, "LONG", 3)
    monkeypatch.setattr(counts, "BATCH_BYTES", 100)
    draw = random.Random(9)
    pieces = ["a", "Bc", "漢", "字。", "。", "、", ".", "...", ",x", "!", "?", "'s", "'", "'re", "é", "e\u0301", "\u0301", "1", "23", "\n", "\r\n",
              "\t", " ", "\x0b", "\x0c", "\u00a0", "\u3000", "\u2028", "<|startoftext|>", "<|endoftext|>", "<|", "|>", "…", "Σ", "ς", "한", "ᄒ", "ᅡ", "🙂"]
    texts = ["".join(draw.choices(pieces, k=draw.randrange(60))) for _ in range(4_000)]
    library = counts.tokenizer(WORDS)
    for text in texts:
        parts = counts.stretches(text.encode())
        assert sum(counts.lengths(WORDS, parts)) == len(library.encode(text, add_special_tokens=False)), text
    assert max(map(len, counts.stretches(("漢字" * 2 + "。") .encode() * 5_000))) == 5
    assert counts.stretches(None) == counts.stretches(b"") == [""]


# --- urls ------------------------------------------------------------------------------------


RULES = [("bad.test/spam/", "block"), ("bad.test/news/", "allow")]


def judged_urls(spark, found, rules_=RULES):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(found)], "page_id long, url string, host string")
    return {r["page_id"]: r for r in urls.filter_urls(df, rules_).collect()}


def test_url_parts_and_rules(spark):
    found = [None, "", "no scheme", "http://Bad.TEST/spam/1?x#y", "https://a.bad.test/news/x", "http://notbad.test/spam/1", "http://bad.test?q=/spam/",
             "http://bad.test", "x://bad.test/spam/a://b/", "http://bad.test/spam/1"]
    said = judged_urls(spark, found)
    assert [(said[i]["host"], said[i]["path"]) for i in range(10)] == [
        ("", ""), ("", ""), ("", ""), ("bad.test", "/spam/1"), ("a.bad.test", "/news/x"), ("notbad.test", "/spam/1"), ("bad.test", ""),
        ("bad.test", ""), ("bad.test", "/spam/a://b/"), ("bad.test", "/spam/1"),
    ]
    assert [said[i]["rule"] for i in range(10)] == [None, None, None, "bad.test/spam/", "bad.test/news/", None, None, None, "bad.test/spam/", "bad.test/spam/"]
    assert said[0]["verdict"] == "allow" and said[3]["verdict"] == "block" and said[4]["verdict"] == "allow"
    assert judged_urls(spark, [None], [])[0]["verdict"] == "allow"


def test_templates_and_rejection(spark):
    found = [f"http://h.bad.test/spam/{i}.html" for i in range(300)]  # all blocked: so is what looks like it
    found += [f"http://h.bad.test/offers/{i}" for i in range(50)]
    found += [f"http://ok.bad.test/news/{i}" for i in range(300)] + [f"http://ok.bad.test/more/story-{i}" for i in range(60)]
    said = judged_urls(spark, found)
    assert {said[i]["template"] for i in range(300)} == {"/spam/*"}
    assert {said[i]["template"] for i in range(300, 350)} == {"/offers/*"}
    assert {said[i]["verdict"] for i in range(350)} == {"block"}
    assert {said[i]["template"] for i in range(650, 710)} == {"/more/*"}
    assert {said[i]["verdict"] for i in range(350, 710)} == {"allow"}


def test_branches_that_differ_are_kept_apart(spark):
    found = [f"http://h.bad.test/spam/{i}" for i in range(100)] + [f"http://h.bad.test/news/{i}" for i in range(900)]
    rows = spark.createDataFrame([(u,) for u in found], "url string").select(*[c.alias(n) for c, n in zip(urls.parts(F.col("url")), ("host", "path"))])
    ruled = rows.withColumn("verdict", urls.rule_of(F.col("host"), F.col("path"), RULES)[1])
    judged = {r["template"]: r for r in urls.judged_templates(urls.templates(ruled)).collect()}
    assert judged["/spam/*"]["rejected"] and not judged["/news/*"]["rejected"]
    assert judged["/spam/*"]["merged"] != judged["/news/*"]["merged"]


@pytest.mark.parametrize("above", ["/a/b/c/d", "/a/b/c/d/7/e/f/g/h/i/j"])
def test_deep_paths_keep_their_levels(spark, above):
    rules_ = [(f"h.test{above}/bad/1", "block"), (f"h.test{above}/good/1", "allow")]
    found = [f"http://h.test{above}/{kind}/{i}" for kind in ("good", "bad") for i in range(200)] + ["http://h.test/x"]
    said = judged_urls(spark, found, rules_)
    shown = above.replace("7", "*")
    assert {said[i]["template"] for i in range(200)} == {f"{shown}/good/*"} and said[400]["template"] == "/x"
    assert {said[i]["template"] for i in range(200, 400)} == {f"{shown}/bad/*"}
    assert [said[2]["verdict"], said[202]["verdict"]] == ["allow", "block"]


def test_levels_cost_no_rounds(spark, monkeypatch):
    """Paths of 2,000 levels, alike or not, take the rounds of their nested wildcards."""
    rounds = []
    varied = urls.varied_nodes
    monkeypatch.setattr(urls, "varied_nodes", lambda nodes: rounds.append(1) or varied(nodes))
    deep = "/s" * 2000
    found = [f"http://h.test{deep[: 2 * i]}" for i in range(1950, 2000)] + [f"http://h.test{deep}/w{i}/x/v{i}" for i in range(30)]
    found += [f"http://big.test/only/p{i}" for i in range(3000)]  # one host with most of the pages
    said = judged_urls(spark, found)
    assert len(rounds) == 3
    assert {said[i]["template"] for i in range(50, 80)} == {f"{deep}/*/x/*"} and said[7]["template"] == deep[: 2 * 1957]
    assert {said[i]["template"] for i in range(80, 3080)} == {"/only/*"}


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(df, RULES).count() == 0


# --- stages ---------------------------------------------------------------------------------


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Each stage gives the columns of documents back, and does not fail on odd rows or none."""
    from spendlens.llm import stages

    rows = [(i, t, "en", "s", i) for i, t in enumerate(ODD)] + [(None, "null key", None, None, None), (5, ODD[5], "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (stages.quality, stages.drop_lines, stages.near_duplicates, stages.decontaminate):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= len(rows)
        assert stage(spark, docs.filter("false"), str(tmp_path)).collect() == []
    done = stages.tokenize(spark, docs, str(tmp_path)).collect()
    assert len(done) == len(rows) and all(r["round_trip"] for r in done)
    assert stages.tokenize(spark, docs.filter("false"), str(tmp_path)).collect() == []
