"""Frequent keys, large sets and plan shape."""

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL, rows
from spendlens.operators import attribution as A, ranking, skew
from spendlens.operators.lineage import cut
from workload.fixtures import campaign_summary

DAY = dt.date(2024, 1, 1)


def plan_text(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture(scope="module")
def lopsided(spark):
    """9,000 rows, a third of them one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    return spark.range(0, 9000, 1, 12).select(key.cast("string").alias("k"), F.col("id").alias("row"))


def shares(spark, heavy, key):
    found = spark.range(1).select(heavy, F.try_element_at(heavy, F.xxhash64(F.lit(key)))).first()
    return found[0], found[1]


def test_heavy_keys_are_found(lopsided, spark):
    [heavy] = skew.heavy_keys(lopsided, ["k"])
    found, copies = shares(spark, heavy, "0")
    assert len(found) == 1 and copies == 3  # a third of the rows, with an eighth for each of 8 tasks


@pytest.mark.parametrize("keys", [200, 270, 100_000])
def test_no_heavy_keys_in_even_data(spark, keys):
    even = spark.range(100_000).select((F.col("id") % keys).cast("string").alias("k"))
    [heavy] = skew.heavy_keys(even, ["k"])
    assert spark.range(1).select(F.size(heavy)).first()[0] == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_heavy_keys_of_empty_partitions_and_tables(spark, lopsided, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for rows_left, expected in ((lopsided.filter("k = '0'").coalesce(1), 1), (lopsided.filter("k = 'none'"), 0)):
            [heavy] = skew.heavy_keys(rows_left, ["k"])
            assert spark.range(1).select(F.size(heavy)).first()[0] == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_flagging_without_sales(spark):
    empty = sales_of(spark, 10).filter("campaign_id = 'none'")
    assert A.flag_promoted(empty, promotions_of(spark, 10)).count() == 0
    assert A.set_membership(empty, promotions_of(spark, 10).filter("campaign_id = 'none'")).count() == 0


@pytest.mark.parametrize("partitions", [12, 1])
def test_salted_join_deals_out_and_keeps_rows(spark, lopsided, partitions):
    dim = spark.createDataFrame([("0", "zero"), ("1", "one")], "k string, name string")
    lopsided = lopsided.coalesce(partitions)  # a hot key is split even if one partition has all of it
    [heavy] = skew.heavy_keys(lopsided, ["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.salted_left_join(lopsided, dim, ["k"], heavy)
        assert joined.count() == 9000
        counts = dict(joined.groupBy("name").count().collect())
        assert counts == {"zero": 3000, "one": 1, None: 5999}
        spread = joined.filter("name = 'zero'").groupBy(F.spark_partition_id()).count().collect()
        assert len(spread) > 1 and max(r["count"] for r in spread) <= 2200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def sales_of(spark, skus):
    """A hot campaign-day: every row sells on the same day for one campaign."""
    return spark.range(skus * 2).select(
        F.lit("hot").alias("campaign_id"), F.lit(DAY).alias("date"),
        F.col("id").cast("string").alias("purchased_sku"), F.lit(1).cast("decimal(18,4)").alias("total_sales"),
    )


def promotions_of(spark, skus):
    return spark.range(skus).select(
        F.lit("hot").alias("campaign_id"), F.lit(DAY).alias("date"), F.col("id").cast("string").alias("promoted_sku")
    )


@pytest.mark.parametrize("skus", [9_999, 10_001])
def test_sets_mean_the_same_at_any_size(spark, skus):
    promotions, sales = promotions_of(spark, skus), sales_of(spark, skus)
    con = duckdb.connect()
    con.register("promo", promotions.toPandas())
    con.register("sales", sales.drop("total_sales").toPandas())
    sets = A.promoted_sets(promotions).agg(F.count("*"), F.countDistinct("promoted_sku"), F.min("n_skus"), F.max("n_skus")).first()
    assert tuple(sets) == (skus, skus, skus, skus)
    [theirs] = con.execute(
        "SELECT count(*), count_if(p.promoted_sku IS NOT NULL), min(n), max(n), count_if(n IS NULL) FROM sales s "
        "LEFT JOIN promo p ON p.promoted_sku = s.purchased_sku, (SELECT count(DISTINCT promoted_sku) AS n FROM promo)"
    ).fetchall()
    attached = A.attach_promoted(sales, promotions)
    mine = attached.agg(
        F.count("*"), F.count_if("is_promoted"), F.min("n_skus"), F.max("n_skus"), F.count_if(F.col("n_skus").isNull())
    ).first()
    assert tuple(mine) == theirs == (2 * skus, skus, skus, skus, 0)
    flagged = A.set_membership(sales, promotions)
    assert dict(flagged.groupBy("is_promoted").count().collect()) == {True: skus, False: skus}
    [(listed,)] = A.promoted_lists(promotions, "hot").select(F.size("promoted_skus")).collect()
    assert listed == skus


def test_hot_day_is_flagged_whole(spark):
    flagged = A.flag_promoted(sales_of(spark, 3000), promotions_of(spark, 3000))
    assert dict(flagged.groupBy("match_status").count().collect()) == {"promoted": 3000, "not_promoted": 3000}
    assert rows(A.promoted_sales(sales_of(spark, 3000), promotions_of(spark, 3000)), "is_promoted", "total_sales") == [
        (False, 3000.0), (True, 3000.0)
    ]


def test_ranks_with_a_third_of_equal_values(spark):
    # values 0..99 for two thirds, 50 for the rest, spread over many ranges
    value = F.when(F.col("id") % 3 == 0, 50.0).otherwise((F.col("id") % 100).cast("double"))
    values = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit("m").alias("metric"), value.alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ranking.value_ranks(values, "k")
        ranked.select("k").count()
        mine = {r["value"]: r["rank"] for r in ranked.select("value", "rank").distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = dict(values.groupBy("value").count().collect())
    assert mine == {v: 1 + sum(n for w, n in counts.items() if w > v) for v in counts}


def test_positions_over_ranges(spark, monkeypatch):
    totals = spark.range(4000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranking.with_position(totals, ranking.descending("value", "k"))
        found = {r["k"]: r["position"] for r in placed.collect()}
        monkeypatch.setattr(ranking, "BROADCAST_ROWS", 10)
        middle = rows(ranking.rank_slice(totals, "k", 1000, 1009), "k", "position")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(((-(i % 7)), str(i)) for i in range(4000))
    assert [found[k] for _, k in order] == list(range(1, 4001))
    assert middle == sorted((order[i - 1][1], i) for i in range(1000, 1010))


def test_cut_uses_the_named_folder(spark, tmp_path):
    context = spark.sparkContext
    kept = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path / "shared"))
    try:
        assert cut(spark.range(10)).count() == 10
        assert any((tmp_path / "shared").rglob("part-*"))
    finally:
        if kept:
            context.setCheckpointDir(kept)


def test_distribution_reads_the_report_once(spark):
    df = entry.queries()["share_campaign_top5"](spark, SF_SMALL)
    df.collect()
    final = plan_text(df).split("== Initial Plan ==")[0]
    scans = len(re.findall(r"FileScan parquet", final))
    assert scans == 1 and "ReusedExchange" in final


def test_score_reads_the_report_once(spark):
    df = entry.queries()["score_sku"](spark, SF_SMALL)
    df.collect()
    assert "ReusedExchange" in plan_text(df)


@pytest.mark.parametrize("name", ["trend_top5_roas", "sales_contribution", "flow_reverse", "score_sku", "metric_ranks",
                                  "share_sku_top5", "flag_promoted", "placement_share", "campaign_card"])
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_text(entry.queries()[name](spark, SF_SMALL))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert banned not in plan


def test_window_and_columns_reach_the_scan(spark, tmp_path):
    from spendlens.operators.filters import between_dates
    from spendlens.operators.metrics import metric_totals

    campaign_summary(spark, SF_SMALL).write.parquet(str(tmp_path / "report"))
    report = spark.read.parquet(str(tmp_path / "report"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_text(metric_totals(between_dates(report, "1996-01-01", "1996-12-31"), "campaign_id", "clicks"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(date,1996-01-01)" in plan and "IsNotNull(campaign_id)" in plan
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"date", "campaign_id", "clicks"}


def test_a_second_load_adds_its_own_states_alone(spark, t1):
    import uuid

    from spendlens.operators import metrics
    from spendlens.plans import rollup
    from spendlens.sources import snapshots

    name = f"t1-{uuid.uuid4().hex}"
    rollup.add_load(spark, name, t1.filter("date = '2024-01-01'"))
    first = snapshots.folders(spark, name)
    rollup.add_load(spark, name, t1.filter("date <> '2024-01-01'"))
    assert snapshots.folders(spark, name)[:1] == first and len(snapshots.folders(spark, name)) == 2
    added = spark.read.parquet(snapshots.folders(spark, name)[1] + "/days")
    assert {str(r["date"]) for r in added.collect()} == {"2024-01-02", "2024-01-03"}

    def same(states, keys, wanted):
        found = rollup.merged_metrics(states, keys)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.select(found.columns).collect()))

    for _ in range(2):
        same(rollup.day_states(spark, name), ["campaign_id"], metrics.grouped_metrics(t1, ["campaign_id"]))
        same(rollup.day_states(spark, name), ["date", "placement_type"], metrics.placement_daily(t1))
        same(rollup.sku_states(spark, name), ["promoted_sku"], metrics.grouped_metrics(t1, ["promoted_sku"]))
        assert rollup.merged_facts(rollup.campaign_states(spark, name)).collect() == metrics.basic_facts(t1).collect()
        day = rollup.merged_facts(rollup.campaign_states(spark, name), DAY, DAY).first()
        assert tuple(day) == (2, DAY, DAY)
        rollup.compact(spark, name)
    assert len(snapshots.folders(spark, name)) == 1


def test_compaction_shuffles_the_states_of_shared_days_alone(spark, t1, monkeypatch):
    """Loads of different days are copied; keys of days in two loads, or of no day, end in one row."""
    import uuid

    from spendlens.plans import rollup
    from spendlens.sources import snapshots

    add, by_key = snapshots.add, r"hashpartitioning\(date#\d+, campaign_id#\d+"

    def compacted(*loads):
        name, plans = f"t1-{uuid.uuid4().hex}", []
        for load in loads:
            rollup.add_load(spark, name, load)

        def run_first(session, name, tables, fresh):
            tables["days"].collect()
            plans.append(tables["days"]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
            return add(session, name, tables, fresh)

        with monkeypatch.context() as patched:
            patched.setattr(snapshots, "add", run_first)
            rollup.compact(spark, name)
        return rollup.day_states(spark, name), plans[0]

    whole = rollup.partial_states(t1, rollup.DAY_KEYS)
    states, plan = compacted(t1.filter("date = '2024-01-01'"), t1.filter("date <> '2024-01-01'"), t1.filter("false"))
    assert not re.search(by_key, plan)
    assert rows(states, *whole.columns) == rows(whole)

    undated = t1.withColumn("date", F.when(F.col("campaign_id") != "B", F.col("date")))
    again = undated.filter("clicks >= 10 AND placement_type = 'PLA'")
    assert again.filter("date IS NULL").count() and again.filter("date IS NOT NULL").count()
    whole = rollup.partial_states(undated.unionByName(again), rollup.DAY_KEYS)
    states, plan = compacted(undated, again)
    assert re.search(by_key, plan)
    assert rows(states, *whole.columns) == rows(whole)


def test_sketched_facts_stay_within_their_error(spark):
    """Sketches of 30 days, each with campaigns of others, count 60,000 campaigns to 5 %: three standard errors."""
    from spendlens.plans import rollup

    rows = spark.range(120_000).select((F.col("id") % 60_000).cast("string").alias("campaign_id"),
                                       F.date_add(F.lit(DAY), (F.col("id") % 31).cast("int")).alias("date"))
    states = rollup.id_states(rows.withColumn("date", F.when(F.col("date") > DAY, F.col("date"))))
    found = rollup.merged_facts(states).first()
    assert abs(found["n_campaigns"] - 60_000) <= 3_000
    assert (found["min_date"], found["max_date"]) == (DAY + dt.timedelta(1), DAY + dt.timedelta(30))
    part = rollup.merged_facts(states, DAY + dt.timedelta(5), DAY + dt.timedelta(6)).first()
    assert abs(part["n_campaigns"] - 120_000 / 31 * 2) <= 400
    assert tuple(rollup.merged_facts(states, end=DAY).first()) == (0, None, None)


def test_bloom_filter(spark):
    """Lets every key pass and few others; nothing passes without keys."""
    from spendlens.operators import bloom

    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("sku")).union(spark.createDataFrame([(None,)], "sku string"))
    rows = spark.range(220_000).select(F.concat(F.lit("k"), "id").alias("sku")).union(spark.createDataFrame([(None,)], "sku string"))
    passed = rows.filter(bloom.may_be_in(keys, "sku", 20_001))
    assert passed.join(keys, "sku", "left_semi").count() == 20_000
    assert passed.count() <= 20_000 + 0.01 * 200_000
    assert rows.filter(bloom.may_be_in(keys.limit(0), "sku", 0)).count() == 0
    assert bloom.size_for(10**12) == bloom.MOST_BITS


def test_long_lists_of_secondaries_meet_few_rows(spark):
    """Of 20,000 secondaries' report rows alone are grouped and shuffled, with one that a third of the rows have."""
    from spendlens.operators import flow

    n = 20_000
    own = spark.range(n).select(F.lit("A").alias("campaign_id"), F.col("id").cast("string").alias("promoted_sku"), F.lit(1).alias("clicks"))
    other = spark.range(300_000).select(
        F.concat(F.lit("B"), F.col("id") % 7).alias("campaign_id"),
        F.when(F.col("id") % 3 == 0, "0").otherwise((F.col("id") + 10_000).cast("string")).alias("promoted_sku"), F.lit(1).alias("clicks"),
    )
    rows = cut(own.union(other))
    forward = cut(flow.flow_forward(rows, "campaign_id", "A", "clicks"))
    reverse = flow.flow_reverse(rows, forward, "campaign_id", "clicks")
    wanted = rows.filter(F.col("promoted_sku").cast("int") < n).groupBy("promoted_sku", "campaign_id").agg(F.sum("clicks").alias("clicks"))
    assert reverse.count() == wanted.count() and reverse.exceptAll(wanted.select(reverse.columns)).isEmpty()
    plan = plan_text(reverse)
    below = plan[plan.index("partial_sum(clicks") : plan.index("getbit")]  # the filter is under the partial sums, before any exchange
    assert "Exchange" not in below


def test_ranks_plan_without_a_job(spark):
    """Planning runs nothing, and a value that most rows share gets one rank."""
    from spendlens.operators.ranking import value_ranks

    tracker, group = spark.sparkContext.statusTracker(), "planning-ranks"
    rows = spark.range(50_000).select(
        F.col("id").cast("string").alias("k"), F.lit("m").alias("metric"),
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id").cast("double")).alias("value"),
    )
    spark.sparkContext.setJobGroup(group, group)
    ranked = value_ranks(rows, "k")
    assert len(tracker.getJobIdsForGroup(group)) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    wanted = rows.toPandas()
    wanted["rank"] = wanted["value"].rank(method="min", ascending=False)
    found = ranked.toPandas().set_index("k")["rank"]
    assert ((found.loc[wanted["k"]].values == wanted["rank"].values) | (wanted["rank"].isna().values & found.loc[wanted["k"]].isna().values)).all()


@pytest.mark.parametrize("metric", ["clicks", "spend", "cpc"])
def test_top_of_many_groups_meets_few_rows(spark, metric, monkeypatch):
    """Of 60,000 SKUs with a few large ones, hardly more than those are grouped; values are tied, negative or missing."""
    from spendlens.operators import bounds
    from spendlens.plans.distribution import distribution
    from spendlens.schema import METRICS, MONEY

    number = F.when(F.col("id") < 40, 5_000 - (F.col("id") % 10) * 100).when(F.col("id") % 7 == 0, -3).when(F.col("id") % 5 > 0, F.col("id") % 4)
    real = (number * F.lit(0.1)).alias
    report = cut(spark.range(60_000).withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.lit("C").alias("campaign_id"), F.when(F.col("id") != 11, F.concat(F.lit("S"), "id")).alias("promoted_sku"), F.lit(DAY).alias("date"),
        number.alias("clicks"), number.cast(MONEY).alias("spend"), real("cpc"), *[real(m) for m in METRICS if m not in ("clicks", "spend", "cpc")],
    ))
    found = bounds.split_by_bounds(report, "promoted_sku", metric, 25)
    assert found.rows.count() < 1_000
    assert rows(found.rows.agg(F.count_distinct("campaign_id")))  # whole rows
    plan = plan_text(found.rows.groupBy("promoted_sku").agg(F.sum("clicks")))
    assert "Exchange" not in plan[plan.index("partial_sum(clicks") : plan.index("getbit")]  # the filter is under the partial sums

    def shares_of(n, **settings):
        result = distribution(report, "promoted_sku", metric, n, **settings).shares
        return sorted(((r["group"], r["metric"]), round(r["value"], 4), round(r["pct"], 6)) for r in result.collect())

    assert shares_of(25, by_bounds=True) == shares_of(25)
    if metric == "spend":
        monkeypatch.setattr(bounds, "BUCKETS", 1 << 6)  # crowded buckets, none of which can be left out
        assert shares_of(25, by_bounds=True, combine_others=False) == shares_of(25, combine_others=False)


@pytest.mark.parametrize("n", [1, 3, 99])
def test_bounds_on_small_and_empty_tables(spark, t1, n):
    """Fewer groups than asked for, or none; a mean has no bounds."""
    from spendlens.operators.bounds import split_by_bounds
    from spendlens.plans.distribution import distribution

    for table in (t1, t1.filter("false")):
        for metric in ("total_sales", "roas"):
            both = [distribution(table, "promoted_sku", metric, n, by_bounds=b) for b in (True, False)]
            assert sorted(rows(both[0].shares), key=str) == sorted(rows(both[1].shares), key=str)
            assert sorted(rows(both[0].means), key=str) == sorted(rows(both[1].means), key=str)
    with pytest.raises(ValueError, match="mean"):
        split_by_bounds(t1, "promoted_sku", "roas", n)
