"""Merkle manifest of a data set: trees of 16 branches, kept as postorder append logs.

Each source has a tree over its documents in key order, and one more tree has
the roots of the sources.  The leaves of a tree are cut in aligned ranges of
16^3.  A builder takes one range and appends each node to its log
as soon as the node is complete: a leaf, then every run that the leaf ends.
That order needs no index: how many nodes are complete before a leaf follows
from the number of leaves alone, so the position of any node, and of the
siblings that a proof needs, is closed form.  The last node of a log is the
range's root, a leaf of the next tier, until one node is left.

A table of logs has one row a range: ``tree``, ``at`` (its number), ``size``
(leaves of the whole tree in this tier), ``tier`` and ``nodes``, the digests in
completion order.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import bounded_broadcast, kept, map_slices, require

#: Branches of a node, and the levels that a builder makes.
BRANCH, LEVELS = 16, 3
DIGEST = 32
#: The tree of the sources; a source's tree is named "=" and the source, that of the null source "".
TOP = "*"
#: Most sources whose proofs (some kilobytes each) are broadcast; more are joined.
MOST_SOURCES = 1 << 12


# --- one range of leaves ------------------------------------------------------------


def digest_of(parts: list[bytes]) -> bytes:
    """sha256 of digests written as hex text."""
    return sha256(b"".join(p.hex().encode() for p in parts)).digest()


def levels(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    found = 0
    while n > 1:
        n, found = -(-n // BRANCH), found + 1
    return found


def height(size: int, most: int = LEVELS) -> int:
    """Levels that a builder makes over its range, ``most`` at most, in a tree of ``size`` leaves."""
    return min(most, levels(size))


def position(level: int, number: int, n: int) -> int:
    """Where node ``number`` of a level stands in the log of ``n`` leaves."""
    last = min((number + 1) * BRANCH**level, n) - 1  # its last leaf
    return level + sum(last // BRANCH**h for h in range(levels(n) + 1))


def completed(leaves: list[bytes], up: int) -> list[bytes]:
    """The nodes over a range of leaves in the order in which they are complete."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(up)]
    for at, node in enumerate(leaves, 1):
        log.append(node)
        for level in range(up):
            runs[level].append(node)
            if len(runs[level]) < BRANCH and at < len(leaves):
                break
            node = digest_of(runs[level])
            runs[level] = []
            log.append(node)
    return log


def addressed(log: bytes, n: int, up: int) -> list[list[bytes]]:
    """The digests of each level below the root of a range, as hex text, found by their positions."""
    text, size, out = log.hex().encode(), 2 * DIGEST, []
    for level in range(up):
        places = (size * position(level, i, n) for i in range(-(-n // BRANCH**level)))
        out.append([text[p : p + size] for p in places])
    return out


#: The siblings of a level: the digests before the node and those behind it.
Step = tuple[bytes, bytes]


def proof_of(nodes: list[list[bytes]], leaf: int) -> list[Step]:
    """What stands beside the way from a leaf to the root of its range."""
    out, number = [], leaf
    for level in nodes:
        begin = number - number % BRANCH
        out.append((b"".join(level[begin:number]), b"".join(level[number + 1 : begin + BRANCH])))
        number //= BRANCH
    return out


def fold(node: bytes, proof: list[Step]) -> bytes:
    """The root, as hex text, that a node and its siblings give."""
    for left, right in proof:
        node = sha256(left + node + right).hexdigest().encode()
    return node


PROOF = "array<struct<left: binary, right: binary>>"


# --- leaves ---------------------------------------------------------------------------


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """sha256 of the fields, each its length in bytes, a colon and its value; ``-`` for null."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``number`` (place in the tree, from 0) and ``size`` (leaves of the tree).

    Rows are sorted over all tasks and counted by task, so a tree of any size
    is numbered without a task of its own.  Sorting is by ``tree``, then ``order``.
    """
    ordered = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    place = ordered.columns.index("tree")
    schema = ordered.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            own = []
            for name in batch.column(place).to_pylist():
                n = n + 1 if name == tree else 0
                tree = name
                own.append(n)
            columns = [*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "local"])

    rows = kept(ordered.mapInArrow(count, f"{schema},part:int,local:bigint"), "merkle-leaves")
    counts = kept(rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")
    # a tree has a row for each task it reaches
    own = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("tree", "part", earlier.alias("before"), F.sum("n").over(own).alias("size"))
    joined = rows.join(bounded_broadcast(kept(places, "merkle-places")), ["tree", "part"])
    return joined.select(*leaves.columns, (F.col("before") + F.col("local")).alias("number"), "size")


# --- building ---------------------------------------------------------------------------

LOG = "tree string, at long, size long, tier int, nodes binary"


def built(leaves: DataFrame, tier: int, most: int) -> DataFrame:
    """Logs of one tier, from tree, number, size and node of its leaves."""
    span = BRANCH**most

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("number")
        size = group["size"][0].as_py()
        log = completed(group["node"].to_pylist(), height(size, most))
        at = group["number"][0].as_py() // span
        return pa.table({"tree": group["tree"][:1], "at": [at], "size": [size], "tier": pa.array([tier], pa.int32()), "nodes": [b"".join(log)]})

    ranges = leaves.select("tree", "number", "size", "node", F.floor(F.col("number") / span).alias("_at"))
    return ranges.groupBy("tree", "_at").applyInArrow(build, LOG)


def tiers(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Logs of all tiers, the lowest first; each has a 16^most-th of the nodes of the one before."""
    span, found = BRANCH**most, [kept(built(leaves, 0, most), "merkle-log")]
    while True:
        higher = found[-1].filter(F.col("size") > span)
        if higher.isEmpty():
            return found
        top = F.expr(f"substring(nodes, octet_length(nodes) - {DIGEST - 1}, {DIGEST})").alias("node")
        nodes = higher.select("tree", F.col("at").alias("number"), F.ceil(F.col("size") / span).alias("size"), top)
        found.append(kept(built(nodes, len(found), most), "merkle-log"))


def roots(logs: list[DataFrame], most: int) -> DataFrame:
    """tree and node, the root of each tree."""
    done = [log.filter(F.col("size") <= BRANCH**most) for log in logs]
    top = F.expr(f"substring(nodes, octet_length(nodes) - {DIGEST - 1}, {DIGEST})").alias("node")
    out = done[0].select("tree", top)
    for log in done[1:]:
        out = out.union(log.select("tree", top))
    return out


def child_proofs(logs: DataFrame, most: int) -> DataFrame:
    """tree, number and proof (within its range) of each leaf of a tier."""
    span = BRANCH**most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        for batch in map_slices(batches):
            for row in batch.to_pylist():
                n = min(span, row["size"] - row["at"] * span)
                nodes = addressed(row["nodes"], n, height(row["size"], most))
                for begin in range(0, n, 256):
                    some = range(begin, min(n, begin + 256))
                    proofs = [[{"left": a, "right": b} for a, b in proof_of(nodes, i)] for i in some]
                    yield pa.RecordBatch.from_pydict({
                        "tree": [row["tree"]] * len(some), "number": [row["at"] * span + i for i in some], "proof": pa.array(proofs, kind),
                    })

    return logs.mapInArrow(run, f"tree string, number long, proof {PROOF}")


def upper_proofs(logs: list[DataFrame], most: int) -> DataFrame:
    """tree, at and upper: the proof of each lowest range from its root up to the tree's."""
    out = None
    for log in reversed(logs[1:]):
        own = child_proofs(log, most).withColumnRenamed("number", "at")
        if out is not None:
            above = out.select("tree", F.col("at").alias("_above"), "upper")
            own = own.withColumn("_above", F.floor(F.col("at") / BRANCH**most)).join(above, ["tree", "_above"], "left").drop("_above")
            own = own.withColumn("proof", F.concat("proof", F.coalesce("upper", F.array().cast(PROOF)))).drop("upper")
        out = own.withColumnRenamed("proof", "upper")
    if out is None:
        return logs[0].select("tree", "at", F.array().cast(PROOF).alias("upper")).filter("false")
    return kept(out, "merkle-upper")


# --- the operator -----------------------------------------------------------------------


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, key: str = "doc_id",
             source: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             text: str = "text", levels_a_range: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """Build the manifest of a table of documents and check every document against it.

    A leaf is the sha256 of ``columns``, each its UTF-8 length, a colon and its
    value, or ``-`` where it is null.  The leaves of a source stand in ascending
    order of ``key``, a null key first, equal keys by their leaf.  Runs of 16
    become a node, the last one of a level with what is left, until one node,
    the source's subroot, is left; a lone leaf is its subroot.  The subroots in
    order of the source (null first, then by bytes) make the root alike.

    Returns the rows (key, leaf, subroot, root, proof_sha256, folded_root,
    verified) and the logs of every tier, those of the sources first.  A
    document's proof is its siblings' digests from the leaf up to the root, and
    proof_sha256 their sha256.  folded_root follows from the proof and the leaf
    of the row as it is read again: ``tampered`` says which rows have the text
    ``changed``; verified tells whether it is the root.  Digests are hex text.

    Null and empty texts differ.  Rows that repeat are leaves of their own, with
    equal leaves beside each other.  Long texts are hashed whole.  Columns that
    are not named have no part in it.  An empty table has no rows and no root.
    """
    require(docs, key, source, *columns)
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("tree")
    fields = [F.col(c) for c in columns]
    altered = F.lit(None).cast("binary")
    if tampered is not None:
        other = [changed if c == text else F.col(c) for c in columns]
        altered = F.when(tampered, leaf(other))
    rows = docs.select(tree, F.col(key).alias("key"), leaf(fields).alias("node"), altered.alias("altered"))
    placed = kept(numbered(kept(rows, "merkle-rows"), ["key", "node"]), "merkle-placed")
    most, span = levels_a_range, BRANCH**levels_a_range
    logs = tiers(placed, most)
    subroots = kept(roots(logs, most), "merkle-subroots")
    named = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "node")
    sources = kept(numbered(named, ["name"]), "merkle-sources")
    top = tiers(sources, most)
    root = roots(top, most).first()  # one row, if there is any document
    whole = root["node"] if root else b""

    # the way from a source's root to the root, then from each range up to it
    by_source = child_proofs(top[0], most)
    if len(top) > 1:
        above = upper_proofs(top, most).select(F.col("at").alias("_at"), "upper")
        joined = by_source.withColumn("_at", F.floor(F.col("number") / span)).join(above, "_at")
        by_source = joined.withColumn("proof", F.concat("proof", "upper"))
    outer = sources.select("number", F.col("name").alias("tree"), "node").join(by_source.select("number", "proof"), "number")
    outer = kept(outer.select("tree", F.col("node").alias("subroot"), F.col("proof").alias("outer")), "merkle-outer")
    ways = logs[0].select("tree", "at", "nodes").join(upper_proofs(logs, most), ["tree", "at"], "left")
    ways = kept(ways.join(bounded_broadcast(outer, MOST_SOURCES), "tree"), "merkle-ways")
    members = placed.withColumn("at", F.floor(F.col("number") / span)).select(
        "tree", "at", "size", F.struct("number", "key", "node", "altered").alias("member")
    )
    ranges = members.groupBy("tree", "at").agg(F.max("size").alias("size"), F.collect_list("member").alias("members"))  # a range at most
    kind = docs.schema[key].dataType.simpleString()
    checked = ranges.join(ways, ["tree", "at"]).select("size", "members", "nodes", "upper", "outer", "subroot")
    hexes = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = checked.mapInArrow(_checker(whole, most), f"key {kind}, {hexes}")
    return out.withColumnRenamed("key", key), [*logs, *top]


def _checker(root: bytes, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = root.hex()
        for batch in map_slices(batches):
            keys = batch.schema.field("members").type.value_type.field("key").type
            for row in batch.to_pylist():
                nodes = addressed(row["nodes"], len(row["members"]), height(row["size"], most))
                upper = [(p["left"], p["right"]) for p in [*(row["upper"] or ()), *row["outer"]]]
                tail, subroot = b"".join(a + b for a, b in upper), row["subroot"].hex()
                out = []
                for member in row["members"]:
                    own = proof_of(nodes, member["number"] % BRANCH**most)
                    proof = sha256(b"".join(a + b for a, b in own) + tail).hexdigest()
                    folded = fold((member["altered"] or member["node"]).hex().encode(), own + upper).decode()
                    out.append((member["key"], member["node"].hex(), subroot, whole, proof, folded, folded == whole))
                names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                columns = [pa.array(c, keys if i == 0 else None) for i, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
