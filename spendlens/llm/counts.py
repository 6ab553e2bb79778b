"""Token counts: batch encoding that returns lengths only."""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import require, with_columns
from spendlens.llm.words import Memory, by_bytes, owned

#: Characters, and bytes, handed to a tokenizer at a time.
BATCH_CHARS, BATCH_BYTES = 200_000, 250_000
#: ASCII white space, at each of which a text is split, written as U+0020.
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: A stretch of more characters without a space is split on, where a letter follows one of these marks.
LONG, MARKS = 1_000, r"(?<=[.,;:!?。、，．；：！？…])(?=\p{L})"


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def lengths(path: str, parts: list[str]) -> list[int]:
    """Tokens of each part, encoded in batches of about the same number of bytes."""
    encode = tokenizer(path).encode_batch_fast
    batches = by_bytes(parts, BATCH_BYTES, lambda part: len(part.encode()))
    return list(chain.from_iterable(map(len, encode(batch, add_special_tokens=False)) for batch in batches))


def stretches(text: bytes | None) -> list[str]:
    """A text cut where no token can cross."""
    parts = (text or b"").translate(SPACES).decode().split(" ")
    if len(max(parts, key=len)) <= LONG:
        return parts
    import regex

    cut = regex.compile(MARKS).split
    return list(chain.from_iterable(cut(p) if len(p) > LONG else (p,) for p in parts))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    ``path`` names a tokenizers file whose pre-tokenizer drops white space and
    parts a mark from the letter behind it, but for the apostrophe, so that a
    text may be split there: the tokens of a text are those of its parts,
    whatever its length.  Workers remember the length of frequent
    parts and encode the others in batches balanced by bytes.  Special tokens
    are not added; their strings inside a text are handled as the library does.

    Null and empty texts have 0 bytes and 0 tokens.  A run of letters alone is
    never split, however long.  Other columns stay; one
    named like an added column is replaced.  Repeated rows are counted alike.
    """
    require(docs, text)
    added = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]

    def step(rows):
        known = owned(("counts", path), lambda: Memory(250_000))
        for (texts,), batch in rows:
            parts = list(map(stretches, texts))
            known.learn(parts, lambda missing: lengths(path, missing))
            counts = [sum(map(known.__getitem__, p)) for p in parts]
            yield ([len(t or b"") for t in texts], counts, [n > limit for n in counts]), batch

    return with_columns(docs, [text], added, step)


def totals(counted: DataFrame, *groups: str) -> DataFrame:
    """Documents, bytes, tokens and documents over the limit, by the given columns."""
    return counted.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum("n_tokens").alias("n_tokens"),
        F.count_if("over_limit").alias("n_over_limit"),
    )
