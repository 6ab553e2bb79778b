"""URL filters from a tree of path templates, in DataFrame functions alone.

The paths of a host form a tree of segments.  From the top, segments that
vary become wildcards: numbers, and the children of a node that has many of
few pages each.  Templates of a host that differ in one fixed segment are branches;
branches whose labelled pages do not differ by more than chance are merged.
A template is rejected if its share of blocked among labelled pages, smoothed
towards its host and that towards all pages, is high enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import kept, require
from spendlens.operators.skew import heavy_keys, salted_left_join

#: A node's children vary if they are so many, with so few pages each on average.
MANY, FEW_PAGES = 20, 5
#: Labelled pages that the share above a template counts for, and the share from which templates are rejected.
WEIGHT, REJECT = 20, 0.8
#: The share of all labelled pages is smoothed towards this one.
PRIOR = 0.2
#: Standard deviations by which a branch differs from its siblings.
DIFFERENT = 3.0
#: Numbers and long hexadecimal names, with or without a file ending.
VARIABLE = r"^([0-9]+|[0-9a-f]{12,}|[0-9a-f-]{32,})(\.[A-Za-z0-9]{1,5})?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # host and path as "host/path", and "allow" or "block"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(reversed(rules), key=lambda r: len(r[0])):  # the longest is asked first
        on, rest = rule.split("/", 1)
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def templates(pages: DataFrame) -> DataFrame:
    """host, path, pages, blocked, labelled, template and branch of each distinct path.

    ``pages`` has host, path and verdict (allow, block or null).  The branch is
    the template with its last fixed segment left open.

    A node's children depend only on the wildcards above it.  So a round looks
    at all levels at once: the highest varied node on a path is final, and what
    lies below it is looked at again in the next round, together with the paths
    that its wildcard brought there.  Rounds then follow the wildcards nested in
    one path, not its levels.
    """
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    named = F.transform(segments, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    tree = pages.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count("verdict").alias("labelled")
    )
    tree = kept(tree.withColumns({"_done": named, "_from": F.lit(0), "_id": F.md5(F.concat("host", "path"))}), "tree")
    ended = []
    while True:
        ended.append(tree.filter(F.size("_done") <= F.col("_from")))
        tree = tree.filter(F.size("_done") > F.col("_from"))
        steps = F.transform(F.sequence("_from", F.size("_done") - 1), lambda i: F.struct(
            i.alias("_place"), F.md5(F.array_join(F.slice("_done", F.lit(1), i), "/")).alias("_node"), F.get("_done", i).alias("_own")
        ))
        nodes = tree.select("host", "pages", "_id", F.inline(steps))
        varied = kept(varied_nodes(nodes), "varied")
        if varied.isEmpty():
            break
        on = ["host", "_node"]
        placed = _spread(nodes.select(*on, "_id", "_place"), varied.withColumn("_varied", F.lit(True)), on)
        first = placed.filter("_varied").groupBy("_id").agg(F.min("_place").alias("_first"))
        opened = F.transform("_done", lambda s, i: F.when(i == F.col("_first"), F.lit("*")).otherwise(s))
        tree = tree.join(first, "_id", "left").withColumns({
            "_done": F.when(F.col("_first").isNull(), F.col("_done")).otherwise(opened),
            "_from": F.coalesce(F.col("_first") + 1, F.size("_done")),
        })
        tree = kept(tree.drop("_first"), "tree")
    tree = reduce(DataFrame.unionByName, ended, tree)
    fixed = F.array_max(F.transform("_done", lambda s, i: F.when(s != "*", i).otherwise(-1)))
    opened = F.transform("_done", lambda s, i: F.when(i == F.col("_fixed"), F.lit("{}")).otherwise(s))
    tree = tree.withColumn("_fixed", F.coalesce(fixed, F.lit(-1)))
    joined_parts = lambda c: F.concat(F.lit("/"), F.array_join(c, "/"))
    return tree.select(
        "host", "path", "pages", "blocked", "labelled", joined_parts(F.col("_done")).alias("template"), joined_parts(opened).alias("branch")
    )


def varied_nodes(nodes: DataFrame) -> DataFrame:
    """host and _node of the nodes with many different children of few pages each."""
    children = nodes.filter(F.col("_own") != "*").groupBy("host", "_node", "_own").agg(F.sum("pages").alias("pages"))
    sizes = children.groupBy("host", "_node").agg(F.count(F.lit(1)).alias("_many"), F.sum("pages").alias("_pages"))
    return sizes.filter((F.col("_many") >= MANY) & (F.col("_pages") < FEW_PAGES * F.col("_many"))).select("host", "_node")


def _spread(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` LEFT JOIN ``right``, one row a key; rows of a frequent key, as of one large host, go to many tasks."""
    [heavy] = heavy_keys(left, on)
    return salted_left_join(left, right, on, heavy)


def judged_templates(paths: DataFrame) -> DataFrame:
    """host, template, merged (the branch and how it differs), purity and rejected."""

    def share(blocked: str, labelled: str, above: Column) -> Column:
        return (F.col(blocked) + WEIGHT * above) / (F.col(labelled) + WEIGHT)

    sums = lambda b, n: (F.sum("blocked").alias(b), F.sum("labelled").alias(n))
    leaves = kept(paths.groupBy("host", "branch", "template").agg(*sums("blocked", "labelled")), "leaves")
    by_branch, by_host = heavy_keys(leaves, ["host", "branch"], ["host"])
    siblings = leaves.groupBy("host", "branch").agg(*sums("all_blocked", "all_labelled"))
    base = F.try_divide("all_blocked", "all_labelled")
    spread = F.sqrt(F.col("labelled") * base * (1 - base) + 0.25)
    score = F.coalesce((F.col("blocked") - F.col("labelled") * base) / spread, F.lit(0.0))
    kind = F.when(score > DIFFERENT, "more").when(score < -DIFFERENT, "less").otherwise("alike")
    placed = salted_left_join(leaves, siblings, ["host", "branch"], by_branch).select(
        "host", "branch", "template", "blocked", "labelled", kind.alias("kind")
    )
    merged = placed.groupBy("host", "branch", "kind").agg(*sums("blocked", "labelled"))
    hosts = leaves.groupBy("host").agg(*sums("host_blocked", "host_labelled"))
    overall = leaves.agg(*sums("any_blocked", "any_labelled"))
    total = share("any_blocked", "any_labelled", F.lit(PRIOR))
    above = share("host_blocked", "host_labelled", F.coalesce(total, F.lit(PRIOR)))
    # one row for the whole table
    beside = salted_left_join(merged, hosts, ["host"], by_host).join(F.broadcast(overall))
    scored = beside.withColumn("purity", share("blocked", "labelled", above))
    scored = scored.select("host", "branch", "kind", "purity", (F.col("purity") >= REJECT).alias("rejected"))
    named = F.concat_ws(" ", "branch", "kind").alias("merged")
    own = placed.select("host", "branch", "template", "kind")
    return salted_left_join(own, scored, ["host", "branch", "kind"], by_branch, ["host", "branch"]).select(
        "host", "template", named, "purity", "rejected"
    )


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule, verdict, template, purity of every page.

    Where a rule fits, it decides, and its pages are the labelled ones that the
    templates learn from.  Elsewhere a page is blocked if its template is
    rejected, and allowed otherwise, as is a template without labelled pages
    near it.  Of rules of one length the first listed holds.  A null URL, or one
    without ``://``, has an empty host and path and the template ``/``.  Repeated
    rows count each and are judged alike.  A path may have any number of levels;
    other columns of ``pages`` are left out.
    """
    require(pages, key, url)
    host, path = parts(F.col(url))
    split = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": name, "verdict": verdict})
    paths = kept(templates(ruled), "paths")
    verdicts = _spread(paths.select("host", "path", "template"), judged_templates(paths), ["host", "template"])
    said = F.coalesce("verdict", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return _spread(ruled, verdicts, ["host", "path"]).select(
        key, "host", "path", "rule", said.alias("verdict"), "template", "purity"
    )
