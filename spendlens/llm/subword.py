"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of learned vectors of hashed features: the word,
its character n-grams, and the pair with the word before it where the two are
equal.  A document's vector is the mean of its words' vectors; a softmax over
it gives the label.  Numpy trains the vectors by stochastic gradient descent on
a bounded sample of labelled documents.  As the softmax of two labels needs one
number of a document's vector, workers score documents with one weight a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import require, with_columns
from spendlens.llm.words import memory_of

#: Labelled documents of each class to train on.
SAMPLE = 600
BUCKETS, WIDTH, GRAM = 1 << 16, 8, 3
AGAIN = 0  # bucket of a word equal to the one before it
EPOCHS, RATE, SEED = 5, 0.5, 7
#: Characters of a word beyond which its n-grams are hashed in numpy, and n-grams hashed at a time.
WORD_CHARS, PIECE = 64, 1 << 16


def words(text: bytes | None) -> list[str]:
    """Words between white space, a word equal to the one before it marked by a leading space."""
    found = (text or b"").decode().split()
    return [w if w != b else " " + w for w, b in zip(found, [None, *found])]


def crc_table() -> np.ndarray:
    """What each byte does to a crc32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def long_grams(bare: str) -> Iterator[np.ndarray]:
    """Buckets of a long word's n-grams, in pieces that overlap by all but one character of an n-gram."""
    framed = f"<{bare}>"
    for begin in range(0, len(framed) - GRAM + 1, PIECE):
        codes = np.frombuffer(framed[begin : begin + PIECE + GRAM - 1].encode("utf-32-le"), "<u4")
        n = len(codes) - GRAM + 1
        crc = np.full(n, 0xFFFFFFFF, np.uint32)
        for i in range(GRAM):
            for shift in (0, 8, 16, 24):
                byte = codes[i : i + n] >> np.uint32(shift)
                crc = CRC[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        yield (crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)


def features(word: str) -> list[int]:
    """Buckets of a word's features."""
    again = word[0] == " "
    bare = word[again:]
    found = [crc32(bare.encode()) % BUCKETS]
    if len(bare) > WORD_CHARS:
        found += [b for piece in long_grams(bare) for b in piece.tolist()]
    else:
        framed = f"<{bare}>".encode("utf-32-le")  # four bytes a character
        found += [crc32(framed[i : i + 4 * GRAM]) % BUCKETS for i in range(0, len(framed) - 4 * GRAM + 1, 4)]
    if again:
        found += [AGAIN] * len(found)
    return found


@dataclass
class Model:
    weights: list[float]  # of each bucket: what it adds to the log odds of label 1
    bias: float

    def of_words(self, found: list[str]) -> list[float]:
        at = self.weights.__getitem__
        weights = np.array(self.weights) if any(len(w) > WORD_CHARS for w in found) else None

        def mean(word: str) -> float:
            again = word[0] == " "
            if len(word) - again <= WORD_CHARS:
                own = features(word)
                return sum(map(at, own)) / len(own)
            n, total = 1, at(crc32(word[again:].encode()) % BUCKETS)
            for piece in long_grams(word[again:]):
                n, total = n + len(piece), total + float(weights[piece].sum())
            return (total / n + at(AGAIN)) / 2 if again else total / n

        return list(map(mean, found))


def shares(text: bytes | None) -> np.ndarray:
    """The weight of each bucket in a document: its features' part of each word, its words' part of the whole text."""
    found = words(text)
    total = np.zeros(BUCKETS)
    for word, n in Counter(found).items():
        if len(word) <= WORD_CHARS:
            own = features(word)
            np.add.at(total, own, n / (len(own) * len(found)))
        else:
            own = np.bincount(features(word), minlength=BUCKETS)
            total += own * (n / (own.sum() * len(found)))
    return total


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = SEED) -> Model:
    """Embeddings and softmax weights by stochastic gradient descent, folded into one weight a bucket.

    A document is its buckets and their weights.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(documents)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(documents)):
            ids, share = documents[i]
            if not len(ids):
                continue
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ vectors[ids]
            logits = hidden @ out + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            # each feature moves by its weight in the document, in steps that do not shrink with its length
            vectors[ids] -= rate * np.outer(share / np.linalg.norm(share), back)
    difference = out[:, 1] - out[:, 0]
    return Model((vectors @ difference).tolist(), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    """Rows never to learn from: crc32 of the key as text leaves remainder 1 by 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, label: str, sizes: dict[int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and _label of at most so many labelled documents of each label,
    none held out: the first by a hash of the key, so the same rows every time."""
    order = F.xxhash64(F.lit(label), F.col(key))
    usable = labels.filter(F.col(key).isNotNull() & ~held_out(F.col(key)))
    parts = [
        usable.filter(F.col(label) == value).select(F.col(key), F.lit(value).alias("_label")).distinct().orderBy(order).limit(size)
        for value, size in sizes.items()
    ]
    picked = reduce(DataFrame.union, parts)
    return docs.filter(F.col(text).isNotNull()).select(key, text).join(F.broadcast(picked), key)  # as many rows as the sizes' sum


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", size: int = SAMPLE, key: str = "doc_id",
        text: str = "text") -> Model:
    """A model from at most ``size`` documents of each label, each used whole, however long.

    Workers sum up the features of a document, so the driver gets at most one
    number a bucket for each.  Rows with a null label, key or text teach
    nothing; rows that repeat with one key teach each.  Without documents of
    both labels the model gives every text the label that there is, or 1.
    """
    require(docs, key, text)
    require(labels, key, label)
    picked = sample(docs, labels, label, {0: size, 1: size}, key, text)

    def step(rows):
        for (texts,), batch in rows:
            found = [shares(t) for t in texts]
            used = [np.flatnonzero(f) for f in found]
            yield [[u.astype("<u2").tobytes() for u in used], [f[u].astype("<f4").tobytes() for f, u in zip(found, used)]], batch

    added = [T.StructField("_buckets", T.BinaryType()), T.StructField("_shares", T.BinaryType())]
    rows = with_columns(picked, [text], added, step, carry=[key, "_label"]).collect()  # the sample
    rows = sorted((r[key], r["_label"], bytes(r["_buckets"]), bytes(r["_shares"])) for r in rows)
    values = [r[1] for r in rows]
    if len(set(values)) < 2:
        return Model([0.0] * BUCKETS, 5.0 if 0 not in values else -5.0)
    return train([(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(w, "<f4")) for _, _, b, w in rows], values)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of label 1 from the whole text; a null text or one without words has 0.

    Rows that repeat are scored alike, long texts and words whole.  Other columns stay; one named like the score is replaced.
    """
    require(docs, text)
    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex

    def step(rows):
        model, known = shared.value, memory_of(tag)
        for (texts,), batch in rows:
            found = list(map(words, texts))
            known.learn(found, model.of_words)
            means = [sum(map(known.__getitem__, w)) / len(w) + model.bias if w else -np.inf for w in found]
            yield [(1 / (1 + np.exp(-np.array(means)))).tolist()], batch

    return with_columns(docs, [text], [T.StructField(name, T.DoubleType())], step)
