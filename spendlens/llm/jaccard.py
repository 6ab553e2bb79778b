"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Texts with the same set of n-grams are one node.  Nodes that agree on a band of
their MinHash signature share a bucket.  A bucket of few nodes gives all its
pairs.  A larger one is never paired with itself: its nodes are verified
against a pivot; those within the threshold are linked through it, and the rest goes
on to the next round with a pivot of its own.  As Jaccard distance obeys the
triangle inequality, the distances to the pivot tell which of the rest could
still be linked to nodes that have a link; just those pairs are verified too.
Beforehand, nodes go whose n-grams are too often theirs alone to be linked.
So no two linked texts of a bucket end in different classes, at any size.
All links lie within a class: where a class has a node of a large bucket, its
nodes are compared once more, all with all in blocks inside tasks, for the
number of links of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import bounded_broadcast, kept, map_slices, require, with_columns
from spendlens.llm.decontam import MIX, roll, words
from spendlens.llm.words import Memory, owned

#: Nodes of a bucket of which all pairs are verified, and rounds of pivots before the rest is paired by distance alone.
SMALL, ROUNDS = 48, 2
#: Members of a block when two lists of a large bucket are compared.
BLOCK = 128
#: Nodes and bytes of n-grams of a block when a whole class is compared, and n-grams counted at a time.
CLASS_BLOCK, CLASS_BYTES, COLUMNS = 1024, 8_000_000, 4096
MOST_HASHES = 128
NO_KEY = -(1 << 63)


def bands_for(threshold: float, recall: float, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most selective rows whose bands find a pair at the
    threshold with at least this probability, within so many hashes."""
    found = None
    for rows in range(1, most_hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows > most_hashes:
            break
        found = bands, rows
    if found is None:
        raise ValueError("more hashes are needed for this recall")
    return found


@cache
def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 32, (n, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (n, 1), np.uint32)


def ngrams(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-grams; one of all words if they are fewer than ``width``."""
    from xxhash import xxh3_64_intdigest

    known, found = worker_memory(), list(map(words, texts))
    known.learn(found, lambda missing: map(xxh3_64_intdigest, missing))
    for own in found:
        ids = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        yield np.unique(roll(ids, min(width, len(ids)))) if own else np.zeros(0, np.uint64)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A number for each band, from the minima of bands * rows hash functions."""
    factor, shift = multipliers(bands * rows)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    short = ((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    for begin in range(0, len(short), 2048):
        np.minimum(least, (factor * short[begin : begin + 2048] + shift).min(axis=1), out=least)
    out = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        out = (out + column) * MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def jaccard(a: bytes, b: bytes) -> float:
    left, right = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return shared / (len(left) + len(right) - shared)


# --- steps ------------------------------------------------------------------------


def worker_memory() -> Memory:
    return owned("jaccard", lambda: Memory(60_000))


def signatures(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """key, node (a digest of the n-gram set; null without words) and its bands."""

    def step(batches):
        from xxhash import xxh3_128_digest

        for (texts,), batch in batches:
            nodes, found = [], []
            for grams in ngrams(texts, width):
                nodes.append(xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                found.append(signature(grams, bands, rows) if len(grams) else [])
            yield [nodes, found], batch

    added = [T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).alias("text"))
    return with_columns(keyed, ["text"], added, step, carry=["key"])


def gram_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """node and its n-gram hashes, from one document of each wanted node (node, key)."""

    def step(batches):
        from xxhash import xxh3_128_digest

        for (texts,), batch in batches:
            sets = [grams.tobytes() for grams in ngrams(texts, width)]
            yield [[xxh3_128_digest(s) for s in sets], sets], batch

    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).alias("text"))
    picked = keyed.join(bounded_broadcast(wanted.select("key").distinct()), "key", "left_semi")
    added = [T.StructField("node", T.BinaryType()), T.StructField("grams", T.BinaryType())]
    computed = with_columns(picked, ["text"], added, step, carry=[])
    return computed.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def linkable(sets: DataFrame, threshold: float) -> DataFrame:
    """The nodes that can be linked at all: an n-gram that no other node has is
    never shared, so a node with too many of them reaches the threshold with none."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map_slices(batches):
            for number, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(grams, np.int64)
                yield pa.RecordBatch.from_pydict({"gram": own, "id": np.full(len(own), number)})

    named = sets.withColumn("id", F.xxhash64("node"))
    rows = named.select("id", "grams").mapInArrow(spread, "gram long, id long")
    single = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1")
    alone = single.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    size = F.octet_length("grams") / 8
    able = F.coalesce("alone", F.lit(0)) <= (1 - threshold) * size + 1e-6
    return named.join(alone, "id", "left").filter(able).select("node")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, jaccard of pairs of nodes."""

    def step(batches):
        for (left, right), batch in batches:
            yield [[jaccard(a, b) for a, b in zip(left, right)]], batch

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("right")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("left")), "a")
    return with_columns(both, ["left", "right"], [T.StructField("jaccard", T.DoubleType())], step, carry=["a", "b"])


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


BUCKET = ["band", "value"]


def small_pairs(members: DataFrame) -> DataFrame:
    """All pairs of each bucket, of at most ``SMALL`` members."""
    lists = members.groupBy(*BUCKET).agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    tails = lists.select("nodes", F.posexplode("nodes").alias("at", "a"))
    return tails.select("a", F.explode(F.expr("slice(nodes, at + 2, size(nodes))")).alias("b"))


def sized(members: DataFrame) -> DataFrame:
    """Members of buckets of two and more, with the bucket's size."""
    return members.join(members.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), BUCKET)


def with_pivot(large: DataFrame) -> DataFrame:
    """Members of large buckets with the bucket's pivot: the one that shares the
    most buckets with the most others.  That is the middle of a group of near
    copies, and the same one in all its buckets."""
    weights = large.groupBy("node").agg(F.sum("n").alias("weight"))
    middle = F.max_by("node", F.struct("weight", F.xxhash64("node"))).alias("pivot")
    pivots = large.join(weights, "node").groupBy(*BUCKET).agg(middle)
    return large.join(pivots, BUCKET)


def candidate_links(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int,
                    threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """a, b, jaccard of the verified links that join all linked nodes of every bucket,
    all links of small buckets among them; the n-gram sets; the nodes of large buckets."""
    reach = 1 - threshold + 1e-9
    found = kept(sized(buckets), "buckets")
    wanted = found.select("node").distinct().join(nodes.select("node", "key"), "node")
    sets = kept(gram_sets(docs, wanted, key, text, width), "gram-sets")
    members = found.select(*BUCKET, "node").join(kept(linkable(sets, threshold), "linkable"), "node", "left_semi")
    found = kept(sized(members), "buckets")
    crowded = found.filter(F.col("n") > SMALL).select("node").distinct()
    links = []
    for number in range(ROUNDS + 1):
        pairs = [small_pairs(found.filter(F.col("n") <= SMALL))]
        large = found.filter(F.col("n") > SMALL)
        done = large.isEmpty()
        if not done:
            large = kept(with_pivot(large), "large")
            pairs.append(large.filter("node <> pivot").select(*ordered("node", "pivot")))
        checked = kept(verified(reduce(DataFrame.union, pairs).distinct(), sets), "checked")
        links.append(checked)
        if done:
            break
        to_pivot = checked.select("a", "b", (1 - F.col("jaccard")).alias("far"))
        placed = large.select(*BUCKET, "node", "pivot", *ordered("node", "pivot")).join(to_pivot, ["a", "b"], "left")
        placed = kept(placed.select(*BUCKET, "node", F.coalesce("far", F.lit(0.0)).alias("far")), "placed")
        rest = placed.filter(F.col("far") > reach)
        if rest.isEmpty():
            break
        # the linked ones that could be within reach of one of the rest, and in the end all that could
        last = number == ROUNDS
        near = rest if last else rest.filter(F.col("far") <= 2 * reach)
        others = placed if last else placed.filter(F.col("far") <= reach)
        links.append(kept(crossed(near, others, sets, reach), "crossed"))
        found = kept(sized(rest.select(*BUCKET, "node")), "buckets")
    return reduce(DataFrame.union, links).filter(F.col("jaccard") >= threshold - 1e-9).distinct(), sets, crowded


def crossed(near: DataFrame, others: DataFrame, sets: DataFrame, reach: float) -> DataFrame:
    """a, b, jaccard of links between two lists of bucket members.

    Both are cut in blocks of at most about ``BLOCK`` members.  A task compares
    one block with one other and gives links alone, so no pair becomes a row.
    """

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*BUCKET).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name))

    counts = blocks(near, "near_blocks").join(blocks(others, "other_blocks"), BUCKET)
    grams = sets.select("node", "grams")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        placed = side.join(counts, BUCKET).join(grams, "node")
        block = F.pmod(F.xxhash64("node"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return placed.select(*BUCKET, block, every, "node", "far", "grams")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"a": [], "b": [], "jaccard": []}
        names, far = right["other"].to_pylist(), np.array(right["other_far"])
        own = [np.frombuffer(g, np.uint64) for g in right["other_grams"].to_pylist()]
        ends = np.cumsum([len(g) for g in own])
        joined = np.concatenate(own) if own else np.zeros(0, np.uint64)
        for node, distance, data in zip(left["node"].to_pylist(), left["far"].to_pylist(), left["grams"].to_pylist()):
            if not names:
                break
            grams = np.frombuffer(data, np.uint64)
            at = np.minimum(np.searchsorted(grams, joined), len(grams) - 1)
            hits = np.concatenate([[0], np.cumsum(grams[at] == joined)])
            shared = np.diff(hits[np.concatenate([[0], ends])])
            sizes = np.diff(np.concatenate([[0], ends])) + len(grams) - shared
            alike = shared / sizes
            for i in np.flatnonzero((alike >= 1 - reach) & (np.abs(far - distance) <= reach)):
                if names[i] != node:
                    out["a"].append(min(node, names[i]))
                    out["b"].append(max(node, names[i]))
                    out["jaccard"].append(float(alike[i]))
        return pa.table(out, schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("jaccard", pa.float64())]))

    left = dealt(near, "near", "other")
    right = dealt(others, "other", "near").toDF("band_", "value_", "other_block_", "near_block_", "other", "other_far", "other_grams")
    both = left.groupBy(*BUCKET, "near_block", "other_block").cogroup(right.groupBy("band_", "value_", "near_block_", "other_block_"))
    return both.applyInArrow(compare, "a binary, b binary, jaccard double").distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set on the left shares with each on the right, by products of 0-1 matrices."""
    both = np.intersect1d(*(np.unique(np.concatenate(side)) for side in (left, right)), assume_unique=True)
    out = np.zeros((len(left), len(right)))
    sides = []
    for side in (left, right):
        flat = np.concatenate(side)
        rows = np.repeat(np.arange(len(side)), [len(g) for g in side])
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        real = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[real], kind="stable")
        sides.append((len(side), rows[real][order], at[real][order]))
    for begin in range(0, len(both), COLUMNS):
        parts = []
        for n, rows, at in sides:
            low, high = np.searchsorted(at, [begin, begin + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(both) - begin)), np.float32)
            part[rows[low:high], at[low:high] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def links_within(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """node and others, the documents of other nodes of its class that the node is linked to.

    ``members`` has node, root and n_copies.  A class is cut in blocks, each one
    row; a task compares one block with one other and gives a number for each
    node, so no pair becomes a row.
    """
    placed = kept(members.join(sets.select("node", "grams"), "node"), "class-sets")
    size = F.greatest(F.count(F.lit(1)) / F.lit(CLASS_BLOCK), F.sum(F.octet_length("grams")) / F.lit(CLASS_BYTES))
    blocks = bounded_broadcast(kept(placed.groupBy("root").agg(F.ceil(size).cast("int").alias("blocks")), "class-blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    dealt = placed.join(blocks, "root").select("root", "blocks", block, F.struct("node", "n_copies", "grams").alias("member"))
    packed = dealt.groupBy("root", "blocks", "block").agg(F.collect_list("member").alias("members"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = packed.select("root", "block", "members", every).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "members"
    )

    def compare(group: pa.Table) -> pa.Table:
        sides = []
        for at in range(group.num_rows):
            rows = group["members"].slice(at, 1).combine_chunks().flatten()
            names, copies, grams = rows.flatten()
            sides.append((names, copies.to_numpy(), [np.frombuffer(g.as_buffer(), np.uint64) for g in grams]))
        (names, copies, own), (others, other_copies, other) = sides[0], sides[-1]
        shared = shared_counts(own, other)
        sizes = np.array([len(g) for g in own])[:, None] + np.array([len(g) for g in other]) - shared
        linked = shared / sizes >= threshold - 1e-9
        if len(sides) == 1 and group["low"][0].as_py() == group["high"][0].as_py():
            np.fill_diagonal(linked, False)
            return pa.table({"node": names, "others": linked @ copies})
        if len(sides) == 1:  # the other block is empty
            return pa.table({"node": names, "others": np.zeros(len(names), np.int64)})
        nodes = pa.concat_arrays([names, others])
        return pa.table({"node": nodes, "others": np.concatenate([linked @ other_copies, copies @ linked])})

    counted = paired.groupBy("root", "low", "high").applyInArrow(compare, "node binary, others long")
    return counted.groupBy("node").agg(F.sum("others").alias("others"))


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, by alternating large and small stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = kept(edges, "edges")
    while not is_starred(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = kept(small.distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def is_starred(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return sums.filter((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row for each document: ``key``, class_id, n_links, n_copies.

    Documents are linked if the Jaccard similarity of their sets of ``width``-word
    n-grams is at least ``threshold``; words as in ``decontam``; a text of fewer
    words has one n-gram.  class_id is the least key of all documents that
    links connect.  n_copies counts the documents with the same set, itself
    included, and n_links the other documents a document is linked to
    directly, whatever the size of its buckets and class.  ``recall`` is the chance
    that a pair at the threshold shares a band; bands and rows follow from it.

    Null and empty texts, and others without words, have no links and are
    classes of their own, with n_copies 1.  Rows that repeat are copies.  A null key sorts before all others.
    """
    require(docs, key, text)
    bands, rows = bands_for(threshold, recall)
    signed = kept(signatures(docs, key, text, width, bands, rows), "signatures")
    worded = signed.filter("node IS NOT NULL")
    nodes = kept(worded.groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n_copies")), "nodes")
    unique = worded.join(nodes, ["node", "key"], "left_semi").dropDuplicates(["node"])
    buckets = unique.select("node", F.posexplode("bands").alias("band", "value"))
    found, sets, crowded = candidate_links(buckets, nodes, docs, key, text, width, threshold)
    links = kept(found, "links")
    roots = components(links)
    one_way = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = one_way.join(nodes.select(F.col("node").alias("b"), "n_copies"), "b").groupBy(F.col("a").alias("node"))
    degree = linked.agg(F.sum("n_copies").alias("some"))
    rooted = kept(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    large = rooted.join(crowded.withColumn("_crowded", F.lit(True)), "node", "left").groupBy("root")
    large = large.agg(F.count(F.lit(1)).alias("n"), F.max("_crowded").alias("_crowded")).filter("n > 2 AND _crowded").select("root")
    members = rooted.join(bounded_broadcast(kept(large, "large-classes")), "root", "left_semi").select("node", "root", "n_copies")
    every = links_within(members, sets, threshold)
    least = rooted.groupBy("root").agg(F.min("key").alias("class_id"))
    others = F.coalesce("others", "some", F.lit(0))
    per_node = rooted.join(least, "root").join(degree, "node", "left").join(every, "node", "left").select(
        "node", "class_id", "n_copies", (others + F.col("n_copies") - 1).alias("n_links")
    )
    out = signed.select("key", "node").join(per_node, "node", "left")
    plain = lambda c: F.when(F.col(c) != NO_KEY, F.col(c))
    return out.select(
        plain("key").alias(key),
        F.when(F.col("node").isNull(), plain("key")).otherwise(plain("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents with the least key of their class, and those without words.

    Rows with equal keys stay together if one of them is to stay.
    """
    stays = F.max(F.col("class_id").eqNullSafe(F.col(key)))
    gone = classes.groupBy(key).agg(stays.alias("stays")).filter("NOT stays").select(F.col(key).alias("_gone"))
    return docs.join(bounded_broadcast(kept(gone, "gone")), F.col(key) == F.col("_gone"), "left_anti")
