"""Two-leg links between campaigns and SKUs.

Forward: one chosen value of the primary key to its secondaries.  Reverse:
each of those secondaries to every primary it occurs with.  Numbering of nodes
and pairs follows first appearance, forward before reverse and each leg by its
keys; it runs on the grouped links, never on report rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.checks import check_choice
from spendlens.functions.ids import canonical_id, pair_key
from spendlens.functions.values import zero_to_epsilon
from spendlens.operators.bloom import may_be_in
from spendlens.operators.filters import distinct_values, drop_missing, for_key, keep_members
from spendlens.operators.metrics import grouped_metrics
from spendlens.operators.ranking import first_seen_index
from spendlens.operators.skew import heavy_keys, known_keys, salted_left_join
from spendlens.schema import BROADCAST_ROWS, PALETTE_SIZE

SIDES = ("campaign_id", "promoted_sku")


def other_side(primary: str) -> str:
    check_choice(primary, SIDES, "primary")
    return SIDES[1 - SIDES.index(primary)]


def flow_rows(df: DataFrame) -> DataFrame:
    """Report rows with both ids, which the flow cuts at their first dot."""
    return drop_missing(df, SIDES).withColumns({side: canonical_id(side) for side in SIDES})


def chosen_rows(df: DataFrame, primary: str, chosen: str) -> DataFrame:
    """The flow's rows of one primary value.  Its ids begin with that value, a filter that reaches the scan."""
    return for_key(flow_rows(df.filter(F.startswith(primary, F.lit(chosen)))), primary, chosen)


def flow_forward(rows: DataFrame, primary: str, chosen: str, metric: str) -> DataFrame:
    """(primary, secondary, metric) for one primary value."""
    return grouped_metrics(for_key(rows, primary, chosen), [primary, other_side(primary)], [metric])


def flow_reverse(rows: DataFrame, forward: DataFrame, primary: str, metric: str) -> DataFrame:
    """(secondary, primary, metric) for the secondaries of the forward leg.

    A short list of secondaries is broadcast and picks the report rows before
    they are grouped, so one chosen value does not shuffle the whole report.
    With a long one, a Bloom filter of it drops nearly all other rows before
    they are grouped and shuffled.  Links are grouped first: a secondary then has
    one row per primary, however many report rows it has, when it meets the list.
    """
    secondary = other_side(primary)
    own = forward.select(secondary)
    n = own.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        return grouped_metrics(keep_members(rows, own, secondary, rows=n), [secondary, primary], [metric])
    near = rows.filter(may_be_in(own, secondary, own.count()))
    return keep_members(grouped_metrics(near, [secondary, primary], [metric]), own, secondary)


def mirrored(reverse: DataFrame, primary: str, chosen: str) -> DataFrame:
    """The forward leg read off the reverse leg, which holds each of its links
    the other way round."""
    return for_key(reverse, primary, chosen)


def union_legs(forward: DataFrame, reverse: DataFrame, primary: str, metric: str) -> DataFrame:
    """(leg, source, target, value) of both legs, zero weights made tiny."""
    secondary = other_side(primary)

    def leg(df: DataFrame, name: str, source: str, target: str) -> DataFrame:
        value = zero_to_epsilon(metric).alias("value")
        return df.select(F.lit(name).alias("leg"), F.col(source).alias("source"), F.col(target).alias("target"), value)

    return leg(forward, "forward", primary, secondary).unionByName(leg(reverse, "reverse", secondary, primary))


def _node(label: Column, side: str, namespaced: bool) -> Column:
    return F.concat(F.lit(f"{side}:"), label) if namespaced else label


def name_nodes(links: DataFrame, primary: str, namespaced: bool = False) -> DataFrame:
    """Links whose ends are node labels.  A campaign and an SKU with equal text
    are one node unless labels are namespaced by their side."""
    if not namespaced:
        return links
    secondary = other_side(primary)
    forward = F.col("leg") == "forward"

    def end(name: str, on_forward: str, on_reverse: str) -> Column:
        label = F.col(name)
        return F.when(forward, _node(label, on_forward, True)).otherwise(_node(label, on_reverse, True))

    return links.withColumns({
        "source": end("source", primary, secondary),
        "target": end("target", secondary, primary),
    })


def flow_nodes(links: DataFrame) -> DataFrame:
    """(label, node_id): labels numbered from 0 by first appearance, all
    sources before all targets."""
    ends = links.select(
        F.inline(F.array(*[
            F.struct(F.col(end).alias("label"), F.struct(F.lit(block), "leg", "source", "target").alias("seen"))
            for block, end in enumerate(("source", "target"))
        ]))
    )
    return first_seen_index(ends, "label", "seen", "node_id")


def flow_pair_slots(links: DataFrame, palette: int = PALETTE_SIZE) -> DataFrame:
    """(lo, hi, pair_id, slot): unordered pairs numbered by first appearance,
    and their place in a cycling palette."""
    pairs = links.select(pair_key("source", "target").alias("pair"), F.struct("leg", "source", "target").alias("seen"))
    ids = first_seen_index(pairs.select("pair.*", "seen"), ["lo", "hi"], "seen", "pair_id")
    return ids.withColumn("slot", F.pmod("pair_id", F.lit(palette)))


def number_links(links: DataFrame, nodes: DataFrame, slots: DataFrame) -> DataFrame:
    """Links with node ids of both ends and the palette slot of their pair.
    The chosen label, and perhaps others, is an end of very many links, so the
    lookups of frequent labels are dealt out."""
    numbered = links
    for end, heavy in zip(("source", "target"), heavy_keys(links, ["source"], ["target"])):
        ids = nodes.select(F.col("label").alias(end), F.col("node_id").alias(f"{end}_id"))
        numbered = salted_left_join(numbered, ids, [end], heavy)
    keyed = numbered.withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")})
    return keyed.join(slots.drop("pair_id"), ["lo", "hi"], "left").drop("lo", "hi")


def with_product(links: DataFrame, rows: DataFrame, chosen: str | None = None) -> DataFrame:
    """Left join of each SKU's distinct product names onto a table with a
    ``promoted_sku`` column; an SKU with two names yields two rows."""
    names = distinct_values(rows, ["promoted_sku", "promoted_product"])
    if chosen is None:
        return links.join(names, "promoted_sku", "left")
    return salted_left_join(links, names, ["promoted_sku"], known_keys(links, [chosen]))
