"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Measures of a text feed rules of the form "reject if the value is above a
cutoff".  For each stratum and rule the cutoff comes from a fixed list, chosen
on labelled documents: a cutoff is allowed if an exact binomial test shows
that it rejects less than a given share of good documents, at a level divided
by the number of all tests.  The rules' shares add up to the stratum's limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import bounded_broadcast, kept, require

#: Share of a stratum's good documents that all rules together may reject, and the chance that any test errs.
RISK, ERROR = 0.04, 0.05
#: A cutoff is worth so many rejected bad documents for a rejected good one.
CAUTION = 10
SHARES = [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8]
#: Value and cutoffs of each rule, by the measures' names.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", SHARES),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", SHARES),
    "repeat_words": ("n_repeat_words / greatest(n_words, 1)", SHARES),
    "word_length": ("word_chars / greatest(n_words, 1)", [6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 30.0, 50.0]),
}
WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, although it is named in an inner function."""
    return F.transform(F.array(value), use)[0]


def window_hashes(word_hashes: Column) -> Column:
    last = F.size(word_hashes) - WINDOW
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def covered_words(hashes: Column) -> Column:
    """Words in windows that occur more than once: equal neighbours in sorted order give the windows, their gaps the words."""

    def places(ranked: Column) -> Column:
        def place(i: Column) -> Column:
            own = F.get(ranked, i)
            same = own["h"].eqNullSafe(F.get(ranked, i - 1)["h"]) | own["h"].eqNullSafe(F.get(ranked, i + 1)["h"])
            return F.when(same, own["at"])

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(ranked) - 1), place), lambda p: p.isNotNull())

    def total(starts: Column) -> Column:
        def add(held: Column, i: Column) -> Column:
            gap = F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(WINDOW))
            return held + F.least(gap, F.lit(WINDOW)).cast("bigint")

        return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0).cast("bigint"), add)

    numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    counted = bound(F.sort_array(numbered), lambda ranked: bound(F.sort_array(places(ranked)), total))
    return F.when(repeats, counted).otherwise(F.lit(0).cast("bigint"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its measures.

    Words are runs of characters outside white space.  n_words; word_chars,
    their code points; n_symbols, characters of ``#*$%&|<>``; n_lines, lines
    with a word; n_dup_lines, those equal to an earlier line; n_repeat_words,
    words in windows of eight words that occur twice or more.  All are 0 for
    null and empty texts.  Other columns stay; one named like a measure is replaced.
    """
    require(docs, text)
    others = [c for c in docs.columns if c != text and c not in MEASURES]
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(
        *others,
        whole.alias("_text"),
        F.filter(F.split(whole, SPACE, -1), lambda w: w != "").alias("_words"),
        F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    hashes = bound(F.transform("_words", lambda w: F.xxhash64(w)), window_hashes)
    return cut.select(
        *others,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        bound(hashes, covered_words).alias("n_repeat_words"),
    )


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """The chance of at most ``k`` of ``n`` where each has the given share."""

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + F.log(F.lit(share / (1 - share)))
        return F.struct(term.alias("term"), (state["sum"] + F.exp(term)).alias("sum"))

    first = n * F.log(F.lit(1 - share))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), start, add)["sum"]).otherwise(F.exp(first))


def passed(value: Column, grid: list[float]) -> Column:
    """How many cutoffs of an ascending list the value is above."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: value > c))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", label: str = "quality",
                   risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, and for each rule the cutoff or null.

    All labelled documents are the holdout, as the lists of cutoffs are fixed:
    good (label 1) or bad (0).  A cutoff is allowed if the chance of so few rejected good
    documents, were their true share the rule's limit, is at most ``error``
    divided by all tests.  Of the allowed ones that reject more bad than ``CAUTION``
    times good ones, the best wins; a tie goes to the higher cutoff.  A stratum
    with too few good documents for any proof has no cutoffs.
    """
    require(labels, key, label)
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    known = marked.groupBy(key).agg(F.min(label).alias("_good"))  # a document labelled both ways is bad
    rows = measured.join(known, key)
    above = [F.struct(F.lit(name).alias("rule"), passed(F.expr(value), grid).alias("level")) for name, (value, grid) in RULES.items()]
    counted = rows.select(F.col(stratum).alias("stratum"), "_good", F.inline(F.array(*above))).groupBy("stratum", "rule", "level").agg(
        F.count_if(F.col("_good") == 1).alias("good"), F.count_if(F.col("_good") == 0).alias("bad")
    )
    grids = F.create_map(*[x for name, (_, grid) in RULES.items() for x in (F.lit(name), F.array(*map(F.lit, grid)))])
    group = ["stratum", "rule"]
    # a level for every cutoff, whether or not a document ends there
    wanted = counted.select(*group).distinct().withColumn("grid", grids[F.col("rule")])
    wanted = wanted.select(*group, F.posexplode("grid").alias("at", "cutoff")).withColumn("level", F.col("at") + 1)
    levels = counted.select(*group, "level", "good", "bad")
    joined = wanted.select(*group, "level", "cutoff").join(levels, [*group, "level"], "full")
    upward = Window.partitionBy(*group).orderBy(F.desc("level"))
    whole = Window.partitionBy(*group)
    tested = joined.select(
        *group, "cutoff",
        F.sum(F.coalesce("good", F.lit(0))).over(upward).alias("good_out"),
        F.sum(F.coalesce("bad", F.lit(0))).over(upward).alias("bad_out"),
        F.sum(F.coalesce("good", F.lit(0))).over(whole).alias("good"),
    ).filter("cutoff IS NOT NULL")
    tests = tested.agg(F.count(F.lit(1)).alias("tests")).scalar()
    share = risk / len(RULES)
    proved = tested.withColumn("tests", tests).withColumn(
        "chance", F.when(F.col("good_out") < F.col("good") * share, binomial_tail(F.col("good"), F.col("good_out"), share)).otherwise(1.0)
    )
    worth = F.col("bad_out") - CAUTION * F.col("good_out")
    allowed = proved.filter((F.col("chance") <= error / F.col("tests")) & (worth > 0))
    best = allowed.groupBy(*group).agg(F.max_by("cutoff", F.struct(worth, F.col("cutoff"))).alias("cutoff"))
    picked = [F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in RULES]
    return best.groupBy("stratum").agg(*picked)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text",
          label: str = "quality") -> DataFrame:
    """``key``, the stratum, the measures, base_failed, rejected_by (rules, in their order) and kept.

    base_failed: under 20 words, or over 30 percent of the words in repeated
    windows.  kept: neither that, nor a value above the cutoff of its
    stratum.  Null and empty strata are one, named by an empty text.  Each row is judged by itself,
    repeated rows alike; labels for documents that do not exist have no effect.
    """
    require(docs, key, text, stratum)
    measured = kept(measure(docs.select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), text), text), "measures")
    cutoffs = kept(choose_cutoffs(measured, labels, "_stratum", key, label), "cutoffs").withColumnRenamed("stratum", "_stratum")
    joined = measured.join(bounded_broadcast(cutoffs), "_stratum", "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = [F.when(F.expr(value) > F.col(f"cut_{name}"), F.lit(name)) for name, (value, _) in RULES.items()]
    rejected = F.array_compact(F.array(*broken))
    return joined.select(
        key, F.col("_stratum").alias("stratum"), *MEASURES, failed.alias("base_failed"), rejected.alias("rejected_by"),
        (~failed & (F.size(rejected) == 0)).alias("kept"),
    )
