"""A Bloom filter in one row, made and asked with column expressions.

It drops rows before a shuffle whose key is surely not in a long list.  Its
size is bounded: beyond ``MOST_BITS`` it only lets more rows pass.  Some rows
always pass wrongly, so an exact join follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, bits that each key sets, and the most there are: 8 MB, as they go to every task.
KEY_BITS, HASHES, MOST_BITS = 12, 4, 1 << 26


def size_for(n: int) -> int:
    """Bits for ``n`` keys: a power of two."""
    return min(MOST_BITS, max(1 << 10, 1 << (n * KEY_BITS - 1).bit_length()))


def _places(key: Column, bits: int) -> list[Column]:
    """The bits of a key, from the two halves of one hash."""
    value = F.xxhash64(key)
    low, step = value.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(value, 32)
    return [(low + step * i) % bits for i in range(HASHES)]


def bit_words(places: DataFrame, bits: int) -> DataFrame:
    """(words): the bits named in the column ``place``, as an array of 64-bit words, one row."""
    words = places.groupBy(F.shiftright("place", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS INT)))").alias("word"))
    every = places.sparkSession.range(bits // 64).join(words, "id", "left")
    rows = F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
    return every.agg(F.transform(rows, lambda row: row["word"]).alias("words"))


def bit_at(words: Column, place: Column) -> Column:
    """Whether the bit of a place is set."""
    return F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1


def bloom_words(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(words): the filter of a column as an array of 64-bit words, one row.

    Missing keys are left out; without keys all words are 0.
    """
    known = keys.select(F.col(column).alias("key")).filter(F.col("key").isNotNull())
    return bit_words(known.select(F.explode(F.array(*_places(F.col("key"), bits))).alias("place")), bits)


def may_be_in(keys: DataFrame, column: str, n: int) -> Column:
    """False for rows whose ``column`` is surely not among the ``n`` keys of that column; missing for a missing one."""
    bits = size_for(n)
    words = bloom_words(keys, column, bits).scalar()
    first, *others = [bit_at(words, p) for p in _places(F.col(column), bits)]
    for found in others:
        first = first & found
    return first
