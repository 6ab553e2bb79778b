"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on the words
by which toxic documents differ.  A window is a word in a fixed frame.  It is
compressed with the ordinary dictionary, and with the toxic one behind it: the
bytes that the toxic dictionary saves are the window's distance.  Words are
written in UTF-16, since bytes saved are whole numbers.  A document's evidence
is its largest saving; the cutoff is calibrated on labelled documents that
neither dictionary has seen.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spendlens.llm.common import require, with_columns
from spendlens.llm.subword import sample
from spendlens.llm.words import memory_of

#: Labelled documents to learn from, toxic and ordinary; a third of them calibrates.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 900, 3000
ORDINARY_BYTES, TOXIC_BYTES = 24_000, 1_600
#: A word is typical of toxic text if its share there is so many times that in ordinary text, and the
#: documents with it times the logarithm of that ratio come to so much: the one of these that calibrates best.
RATIO, EVIDENCE = 25, (30, 15, 8, 4)
CUTOFF = 0.7
#: How many missed toxic documents a wrongly marked ordinary share weighs.
CAUTION = 4
EDGES = bytes(b for b in range(33, 127) if not chr(b).isalnum())
FRAME = bytes(range(1, 13))


def words(text: bytes | None) -> list[str]:
    """Words in lower case without ASCII punctuation at their ends."""
    return [w.decode() for w in (part.strip(EDGES) for part in (text or b"").lower().split()) if w]


def framed(word: str) -> bytes:
    return FRAME + f" {word} ".encode("utf-16-le")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    cutoff: float

    def savings(self) -> Callable[[Iterable[str]], list[int]]:
        """A function that gives the bytes saved on each word."""
        import zstandard

        end = FRAME + " ".encode("utf-16-le")
        settings = zstandard.ZstdCompressionParameters.from_level(
            19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=False, write_content_size=False, write_dict_id=False
        )

        def compressor(content: bytes):
            content = zstandard.ZstdCompressionDict(content + end, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=content, compression_params=settings).compress

        plain, both = compressor(self.ordinary), compressor(self.ordinary + self.toxic)
        return lambda found: [len(plain(w)) - len(both(w)) for w in map(framed, found)]

    def score(self, most: int) -> float:
        """From the largest saving to a probability that passes ``CUTOFF`` half a byte below the calibrated saving."""
        return 1 / (1 + math.exp(self.cutoff - 0.5 - most) * (1 - CUTOFF) / CUTOFF)


def dictionary(samples: list[str], size: int) -> bytes:
    """The content of a trained dictionary, or the samples' end where they are too few to train on."""
    import zstandard

    data = [s.encode("utf-16-le") for s in samples]
    try:
        return zstandard.train_dictionary(size + 2048, data).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(data)[-size:]


def typical(toxic: list[list[str]], ordinary: list[list[str]], evidence: float) -> set[str]:
    """Words of toxic documents that ordinary ones lack.

    Copies of a document repeat a word between the same neighbours, so a word
    counts as often as it has different neighbours, at most once a document.
    """
    neighbours, times, elsewhere = defaultdict(set), Counter(), Counter()
    for found in toxic:
        for before, word, after in zip(["", *found], found, [*found[1:], ""]):
            neighbours[word].add((before, after))
        times.update(set(found))
    for found in ordinary:
        elsewhere.update(set(found))
    chosen = set()
    for word, n in times.items():
        n = min(n, len(neighbours[word]))
        ratio = n / len(toxic) * len(ordinary) / (elsewhere[word] + 0.5)
        if ratio > RATIO and n * math.log(ratio) >= evidence:
            chosen.add(word)
    return chosen


def train(toxic: list[bytes], ordinary: list[bytes], seed: int = 5) -> Model:
    """Dictionaries from two thirds of the texts, the evidence a word needs and the cutoff from the rest."""
    order = random.Random(seed)
    parts = []
    for texts in (toxic, ordinary):
        found = list(map(words, texts))
        order.shuffle(found)
        parts += [found[: -(-2 * len(found) // 3)], found[-(-2 * len(found) // 3) :]]
    bad, bad_left, good, good_left = parts
    stretches = [f" {' '.join(found[i : i + 8])} " for found in good for i in range(0, len(found), 8)]
    order.shuffle(stretches)
    plain = dictionary(stretches[:30_000], ORDINARY_BYTES)
    model, best, tried = Model(plain, b"", math.inf), -math.inf, set()
    vocabulary = sorted({w for part in (bad_left, good_left) for found in part for w in found})
    for evidence in EVIDENCE:
        marks = frozenset(typical(bad, good, evidence))
        if not marks or not bad_left or marks in tried:
            continue
        tried.add(marks)
        chosen = [w for found in bad for w in found if w in marks]
        random.Random(seed).shuffle(chosen)
        groups = [f" {' '.join(chosen[i : i + 3])} " for i in range(0, len(chosen), 3)]
        other = Model(plain, dictionary(groups, TOXIC_BYTES), math.inf)
        known = dict(zip(vocabulary, other.savings()(vocabulary)))
        most = [np.array([max(map(known.__getitem__, found), default=0) for found in part]) for part in (bad_left, good_left)]
        gain = {t: (most[0] >= t).mean() - CAUTION * (most[1] >= t).mean() if len(most[1]) else 0 for t in range(1, 40)}
        if max(gain.values()) > best + 0.002:  # the most careful of equals
            model, best = other, max(gain.values())
            model.cutoff = float(max(t for t, g in gain.items() if g >= best - 0.002))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
        toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE) -> Model:
    """A model from a bounded sample of labelled texts.

    Rows with a null label, key or text teach nothing.  Without toxic texts
    nothing is toxic: every score is 0.
    """
    require(docs, key, text)
    require(labels, key, label)
    picked = sample(docs, labels, label, {1: toxic_sample, 0: ordinary_sample}, key, text).collect()  # the sample
    rows = sorted((r[key], r["_label"], r[text].encode()) for r in picked)
    return train([t for _, v, t in rows if v], [t for _, v, t in rows if not v])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability that the whole text is toxic; null and empty texts have the least there is.

    Other columns stay; one named like the score is replaced.
    """
    require(docs, text)
    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex

    def step(rows):
        model, known = shared.value, memory_of(tag)
        saved = model.savings()
        for (texts,), batch in rows:
            found = [set(words(t)) for t in texts]
            known.learn(found, saved)
            yield [[model.score(max(map(known.__getitem__, f), default=0)) for f in found]], batch

    return with_columns(docs, [text], [T.StructField(name, T.DoubleType())], step)
