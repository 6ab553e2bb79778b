"""The operators' queries over whole tables, against DuckDB, the libraries or brute force."""

import collections
import hashlib
import re
import zlib
from functools import cache

import base64
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry
from conftest import SF_SMALL
from workload.compare import connect, difference

SF_LABELS = "/root/testdata/sf0.01"


def run(spark, name, sf=SF_SMALL):
    return [r.asDict() for r in entry.queries()[name](spark, sf).collect()]


def read(spark, name, sf=SF_SMALL):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_url_filters", "op8_decontamination", "op10_quality_rules"])
def test_against_sql(spark, name):
    assert difference(spark, connect(SF_SMALL), entry.queries()[name], entry.oracle_sql()[name], SF_SMALL) is None


def test_op2(spark):
    said = {r["page_id"]: r for r in run(spark, "op2_url_filters")}
    pages = read(spark, "pages")
    assert len(said) == len(pages)
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    for page in pages:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", page["url"] or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [(r, v) for r, v in rules if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        row = said[page["page_id"]]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")


def test_op2_at_any_depth(spark, tmp_path):
    """Wildcards nested in wildcards, numbers among words, paths that end above others, against the recursive SQL."""
    import random

    draw = random.Random(2)
    hosts = ["example.org", "www.example.org", "shop.com", "x.net", "fr.shop.com"]
    few, many = ["a", "b", "de", "fr", "en", "es", "*"], [f"w{i}" for i in range(60)]

    def path():
        names = []
        for _ in range(draw.choice([0, 1, 2, 3, 5, 8, 12])):
            names.append(draw.choice(few) if draw.random() < 0.55 else draw.choice(many) if draw.random() < 0.7 else str(draw.randrange(99)))
        return "/" + "/".join(names) + draw.choice(["", "/", "//", "?q", "#x"])

    found = [f"http://{draw.choice(hosts)}{path()}" for _ in range(6_000)]
    found += [f"http://x.net/{'de/' * 9}{w}/{'fr/' * 7}{v}" for w in many[:30] for v in many[:30]] + [None, "", "://", "none"] * 20
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(found)], "page_id long, url string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages")
    [file] = (tmp_path / "pages").glob("*.parquet")
    file.rename(tmp_path / "pages.parquet")
    rows = {r["page_id"]: r["template"] for r in run(spark, "op2_url_filters", tmp_path)}
    assert len(rows) == len(found) and max(t.count("*") for t in rows.values()) > 3
    con = connect(str(tmp_path))
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT 1")
    assert difference(spark, con, entry.queries()["op2_url_filters"], entry.oracle_sql()["op2_url_filters"], str(tmp_path)) is None


@cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_op3(spark):
    tokenizer, before = library("byte_bpe_50k.json"), 0
    said = {r["doc_id"]: r for r in run(spark, "op3_bit_planes")}
    for doc in sorted(read(spark, "documents"), key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert said[doc["doc_id"]] == {"doc_id": doc["doc_id"], "start": before, "n_tokens": len(ids), "ids_crc32": crc}
        before += len(ids)


def grams(text, width=5):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    size = min(width, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if size else frozenset()


def classes_by_force(texts):
    """{key: (class, links)} of {key: text}."""
    sets = {k: grams(t) for k, t in texts.items()}
    root, degree, keys = {k: k for k in sets}, collections.Counter(), sorted(sets)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                degree[a] += 1
                degree[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (find(k), degree[k]) for k in sets}


def test_op4(spark):
    texts = {d["doc_id"]: d["text"] for d in read(spark, "documents", SF_LABELS)}
    said = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in run(spark, "op4_jaccard_join", SF_LABELS)}
    assert said == classes_by_force(texts)


@pytest.mark.parametrize("name, label, least", [("op5_toxicity", "toxic", 0.85), ("op6_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    labels = {r["doc_id"]: r[label] for r in read(spark, "labels", SF_LABELS)}
    said = run(spark, name, SF_LABELS)
    assert len(said) == len(read(spark, "documents", SF_LABELS))
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in said)
    cutoff = {"toxic": 0.7, "quality": 0.5}[label]
    assert all(r["predicted"] == (r["score"] >= cutoff) for r in said)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in said if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) >= least


def test_op7(spark):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    said = {r["doc_id"]: r for r in run(spark, "op7_byte_bpe")}
    for doc in read(spark, "documents"):
        ids = other.encode_ordinary(doc["text"] or "")
        row = said[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


def test_op9(spark):
    tokenizer = library("word_bpe_49k.json")
    said = {r["doc_id"]: r for r in run(spark, "op9_token_counts")}
    for doc in read(spark, "documents"):
        n = len(tokenizer.encode(doc["text"] or "", add_special_tokens=False))
        size = len((doc["text"] or "").encode())
        assert said[doc["doc_id"]] == {"doc_id": doc["doc_id"], "n_bytes": size, "n_tokens": n, "over_limit": n > 2048}


def measures_by_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


def test_op10(spark):
    said = {r["doc_id"]: r for r in run(spark, "op10_quality_rules", SF_LABELS)}
    docs = read(spark, "documents", SF_LABELS)
    assert len(said) == len(docs)
    for doc in docs:
        row, expected = said[doc["doc_id"]], measures_by_force(doc["text"])
        assert {k: row[k] for k in expected} == expected
        assert row["kept"] == (not row["base_failed"] and not row["rejected_by"])


def test_pipeline_by_stages(spark):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    steps = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        rows = out.collect()
        steps.append(rows)
        docs = spark.createDataFrame(rows, out.schema)
    start, good, unlined, single, clean, last = [{r["doc_id"]: r for r in rows} for rows in steps]
    labels = {r["doc_id"]: r["quality"] for r in read(spark, "labels")}
    assert set(good) <= set(start) and all(d in good for d in start if labels.get(d) == 1)
    assert not any(d in good for d in start if labels.get(d) == 0)

    keys = {d: [line.strip(" \t\n\x0b\x0c\r").encode().lower() for line in (r["text"] or "").split("\n")] for d, r in good.items()}
    often = collections.Counter(k for own in keys.values() for k in set(own) if k)
    first = {}
    for d in sorted(keys):
        for i, k in enumerate(keys[d]):
            first.setdefault(k, (d, i))
    for d, r in good.items():
        lines = (r["text"] or "").split("\n")
        stay = [x for i, (x, k) in enumerate(zip(lines, keys[d])) if not k or often[k] < (2 if len(k.split()) > 50 else 10) or first[k] == (d, i)]
        assert unlined[d]["text"] == "\n".join(stay)

    classes = classes_by_force({d: r["text"] for d, r in unlined.items()})
    assert set(single) == {d for d, (c, _) in classes.items() if c == d}

    windows = set()
    for item in read(spark, "benchmark"):
        windows |= grams(item["text"], 10)
    leaks = {d for d, r in single.items() if any(grams(r["text"], n) & windows for n in {len(w) for w in windows})}
    assert set(clean) == set(single) - leaks
    assert set(last) == set(clean) and all(r["round_trip"] for r in last.values())
