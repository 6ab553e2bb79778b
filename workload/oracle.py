"""SQL side of every checked query, for DuckDB over the same tables."""

from __future__ import annotations

from spendlens.schema import MEAN_METRICS, METRICS, SUM_METRICS
from workload.fixtures import CAMPAIGN_CTE, PROMO_CTE, SALES_CTE
from workload.queries import CAMPAIGN, DAY_ONE, END, NUDGE, SKU, START

WINDOW = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
EARLY = f"date BETWEEN DATE '{DAY_ONE}' AND DATE '{START}'"
EXACT = ("total_sales", "spend", "impressions", "clicks")  # decimals and integers


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def agg(metric: str, kind: str | None = None) -> str:
    """Aggregate of a metric by class, as a double where it is not an integer."""
    kind = kind or METRICS[metric].kind
    if kind == "mean":
        return f"avg(CAST({metric} AS DOUBLE))"
    if metric in ("impressions", "clicks"):
        return f"CAST(coalesce(sum({metric}), 0) AS BIGINT)"
    return f"CAST(coalesce(sum({metric}), 0) AS DOUBLE)"


def near(value: str, digits: int = 4) -> str:
    """The rounding of the Spark side."""
    return f"round({value} + {NUDGE}, {digits})"


PCT_BY_METRIC = near("value / NULLIF(sum(value) OVER (PARTITION BY metric), 0) * 100")


def rounded(metric: str, digits: int = 4, kind: str | None = None) -> str:
    kind = kind or METRICS[metric].kind
    text = agg(metric, kind)
    return text if kind == "sum" and metric in EXACT else near(text, digits)


def wide(keys: str, source: str = "campaign", where: str = "true", digits: int = 4) -> str:
    """Grouped table with all metrics by class."""
    metrics = ", ".join(f"{rounded(m, digits)} AS {m}" for m in METRICS)
    not_null = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"SELECT {keys}, {metrics} FROM {source} WHERE {where} AND {not_null} GROUP BY {keys}"


def even(keys: str, digits: int = 2) -> str:
    """Grouped table with all metrics by class, ties rounded to the even digit."""
    parts = []
    for m in METRICS:
        total = f"sum({m})" if m in ("total_sales", "spend") else agg(m)
        parts.append(f"{agg(m)} AS {m}" if m in ("impressions", "clicks") else f"CAST(round_even({total}, {digits}) AS DOUBLE) AS {m}")
    return f"SELECT {keys}, {', '.join(parts)} FROM campaign WHERE {keys} IS NOT NULL GROUP BY {keys}"


def long(key: str, metrics=tuple(METRICS), source: str = "campaign", where: str = "true") -> str:
    """(key, metric, value) without rounding, one branch per metric."""
    return " UNION ALL ".join(
        f"SELECT {key}, '{m}' AS metric, CAST({agg(m)} AS DOUBLE) AS value FROM {source} "
        f"WHERE {where} AND {key} IS NOT NULL GROUP BY {key}"
        for m in metrics
    )


def totals(key: str, metric: str, where: str = "true", source: str = "campaign") -> str:
    return f"SELECT {key}, {agg(metric)} AS value FROM {source} WHERE {where} AND {key} IS NOT NULL GROUP BY {key}"


def placed(key: str, metric: str, where: str = "true") -> str:
    return (
        f"SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, {key}) AS position "
        f"FROM ({totals(key, metric, where)})"
    )


def trend(metric: str, where: str = "true", low: int = 1, high: int = 5) -> str:
    return with_(CAMPAIGN_CTE, f"placed AS ({placed('campaign_id', metric, where)})") + (
        f"SELECT date, campaign_id, placement_type, {rounded(metric, kind='sum')} AS value, position AS rank "
        f"FROM campaign JOIN placed USING (campaign_id) WHERE {where} AND position BETWEEN {low} AND {high} AND placement_type IS NOT NULL "
        "GROUP BY date, campaign_id, placement_type, position"
    )


def units(column: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN '{m.unit}'" for name, m in METRICS.items())
    return f"CASE {column} {cases} ELSE '' END"


def heat(column: str, table: str) -> str:
    low, high = f"(SELECT min({column}) FROM {table})", f"(SELECT max({column}) FROM {table})"
    return near(f"(CAST({column} AS DOUBLE) - {low}) / NULLIF({high} - {low}, 0)", 6)


def share(key: str, metric: str, n: int, others: bool, where: str = "true") -> str:
    """Shares of the top n groups, with one line for all others on request."""
    head = with_(
        CAMPAIGN_CTE,
        f"grouped AS ({long(key, SUM_METRICS, where=where)})",
        f"top AS (SELECT {key} FROM ({placed(key, metric, where)}) WHERE position <= {n})",
        f'folded AS (SELECT {key} AS "group", false AS is_others, metric, value FROM grouped '
        f"WHERE {key} IN (SELECT {key} FROM top)"
        + (
            f" UNION ALL SELECT 'others', true, metric, coalesce(sum(value) FILTER (WHERE {key} NOT IN "
            f"(SELECT {key} FROM top)), 0) FROM grouped GROUP BY metric)"
            if others
            else ")"
        ),
    )
    return head + (
        f'SELECT "group", is_others, metric, {near("value")} AS value, {PCT_BY_METRIC} AS pct FROM folded'
    )


FLAGGED = (
    "flagged AS (SELECT s.*, p.promoted_sku IS NOT NULL AS is_promoted, "
    "CASE WHEN p.promoted_sku IS NOT NULL THEN 'promoted' WHEN d.campaign_id IS NOT NULL THEN 'not_promoted' "
    "ELSE 'unmatched' END AS match_status FROM sales s "
    "LEFT JOIN (SELECT DISTINCT campaign_id, date, promoted_sku FROM promo WHERE promoted_sku IS NOT NULL) p "
    "ON s.campaign_id = p.campaign_id AND s.date = p.date AND s.purchased_sku = p.promoted_sku "
    "LEFT JOIN (SELECT DISTINCT campaign_id, date FROM promo) d ON s.campaign_id = d.campaign_id AND s.date = d.date)"
)
CATEGORY = "CASE WHEN is_promoted THEN 'Promoted SKU' ELSE 'Non-Promoted SKU' END AS category"
BY_FLAG = (
    f"by_flag AS (SELECT campaign_id, is_promoted, {CATEGORY}, sum(total_sales) AS total_sales "
    "FROM flagged GROUP BY campaign_id, is_promoted)"
)
WHOLE = "CAST(sum(total_sales) OVER (PARTITION BY campaign_id) AS DOUBLE)"
SETS = (
    "sets AS (SELECT campaign_id, date, count(DISTINCT promoted_sku) AS n_skus, "
    "coalesce(string_agg(DISTINCT promoted_sku, ',' ORDER BY promoted_sku), '') AS promoted_skus "
    "FROM promo GROUP BY campaign_id, date)"
)


def flow_ctes(primary: str, chosen: str, metric: str, where: str = "true", extra: str = "") -> list[str]:
    secondary = "promoted_sku" if primary == "campaign_id" else "campaign_id"
    value = agg(metric)
    return [
        CAMPAIGN_CTE,
        f"rows_ AS (SELECT date, split_part(campaign_id, '.', 1) AS campaign_id, split_part(promoted_sku, '.', 1) "
        f"AS promoted_sku, promoted_product, {metric} FROM campaign "
        f"WHERE campaign_id IS NOT NULL AND promoted_sku IS NOT NULL AND {where})",
        f"fwd AS (SELECT {primary}, {secondary}, {value} AS {metric} FROM rows_ WHERE {primary} = '{chosen}' "
        f"GROUP BY {primary}, {secondary})",
        f"rev AS (SELECT {secondary}, {primary}, {value} AS {metric} FROM rows_ "
        f"WHERE {secondary} IN (SELECT {secondary} FROM fwd) GROUP BY {secondary}, {primary})",
        f"links AS (SELECT 'forward' AS leg, {primary} AS source, {secondary} AS target, "
        f"CASE WHEN {metric} = 0 THEN 1e-6 ELSE CAST({metric} AS DOUBLE) END AS value FROM fwd UNION ALL "
        f"SELECT 'reverse', {secondary}, {primary}, "
        f"CASE WHEN {metric} = 0 THEN 1e-6 ELSE CAST({metric} AS DOUBLE) END FROM rev)",
        "seq AS (SELECT *, row_number() OVER (ORDER BY leg, source, target) AS n FROM links)",
        "ends AS (SELECT source AS label, 0 AS block, n FROM seq UNION ALL SELECT target, 1, n FROM seq)",
        "first_end AS (SELECT label, min(block * 1000000000 + n) AS seen_at FROM ends GROUP BY label)",
        "nodes AS (SELECT label, row_number() OVER (ORDER BY seen_at) - 1 AS node_id FROM first_end)",
        "pairs AS (SELECT least(source, target) AS lo, greatest(source, target) AS hi, min(n) AS seen_at FROM seq GROUP BY 1, 2)",
        "slots AS (SELECT lo, hi, row_number() OVER (ORDER BY seen_at) - 1 AS pair_id, "
        "(row_number() OVER (ORDER BY seen_at) - 1) % 12 AS slot FROM pairs)",
    ]


def numbered_links(primary: str, chosen: str, metric: str, where: str = "true") -> str:
    return with_(*flow_ctes(primary, chosen, metric, where)) + (
        f"SELECT leg, source, target, {near('value')} AS value, s.node_id AS source_id, t.node_id AS target_id, slot "
        "FROM links JOIN nodes s ON s.label = source JOIN nodes t ON t.label = target "
        "JOIN slots ON lo = least(source, target) AND hi = greatest(source, target)"
    )


def score(axis: str, w_sales: float, w_roas: float, w_spend: float, where: str = "true") -> str:
    def norm(c: str) -> str:
        low, high = f"(SELECT min({c}) FROM g)", f"(SELECT max({c}) FROM g)"
        return f"(({c} - {low}) / NULLIF({high} - {low}, 0))"

    total = f"{w_sales} * {norm('total_sales')} + {w_roas} * {norm('roas')} - {w_spend} * {norm('spend')}"
    return with_(
        CAMPAIGN_CTE,
        f"g AS (SELECT {axis}, {agg('total_sales')} AS total_sales, {agg('spend')} AS spend, {agg('roas')} AS roas "
        f"FROM campaign WHERE {where} AND {axis} IS NOT NULL GROUP BY {axis})",
    ) + (
        f"SELECT {axis}, total_sales, spend, {near('roas', 6)} AS roas, {near(total, 6)} AS score FROM g"
    )


def card(metrics: list[str]) -> str:
    branches = []
    for m in metrics:
        text = f"printf('%.2f {METRICS[m].unit.replace('%', '%%')}', CAST(own AS DOUBLE))"
        branches.append(
            f"SELECT '{m}' AS metric, {near('CAST(own AS DOUBLE)')} AS value, place AS rank, "
            f"'{METRICS[m].unit}' AS unit, {text} AS value_text, '{m} (rank: ' || place || ')' AS legend "
            f"FROM (SELECT campaign_id, {agg(m)} AS own, rank() OVER (ORDER BY {agg(m)} DESC NULLS LAST) AS place "
            f"FROM campaign WHERE {WINDOW} GROUP BY campaign_id) WHERE campaign_id = '{CAMPAIGN}'"
        )
    return with_(CAMPAIGN_CTE) + " UNION ALL ".join(branches)


def ranks(key: str, metrics: list[str]) -> str:
    return with_(CAMPAIGN_CTE, f"v AS ({long(key, metrics)})") + (
        f"SELECT {key}, metric, {near('value')} AS value, CASE WHEN value IS NOT NULL THEN "
        "rank() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST) END AS rank FROM v"
    )


C = with_(CAMPAIGN_CTE)
S = with_(SALES_CTE)
SP = with_(SALES_CTE, PROMO_CTE, FLAGGED)

PROFILE = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {near(f'CAST(max({m}) AS DOUBLE)')} AS max_value, "
    f"{near(f'CAST(min({m}) AS DOUBLE)')} AS min_value, {near(f'CAST(sum({m}) AS DOUBLE) / count({m})')} AS mean_value "
    "FROM campaign"
    for m in METRICS
)
TYPED = ", ".join(
    f"CAST({m} AS DOUBLE) AS {m}" if m in ("total_sales", "spend") else m if m in EXACT else f"{near(m)} AS {m}"
    for m in METRICS
)


def dotted(name: str, vary: str) -> str:
    """An id that keeps its text behind a dot in every fourth row."""
    return f"CASE WHEN {vary} % 4 = 1 THEN {name} || '.b' ELSE {name} END AS {name}"

ORACLE: dict[str, str] = {
    "normalize_campaign": C
    + f"SELECT date, {dotted('campaign_id', 'clicks')}, placement_type, {dotted('promoted_sku', 'clicks')}, "
    f"{dotted('promoted_product_id', 'clicks')}, promoted_product, {TYPED} FROM campaign",
    "normalize_sales": S
    + f"SELECT date, order_date, {dotted('campaign_id', 'CAST(purchased_sku AS INT)')}, "
    f"{dotted('purchased_sku', 'CAST(purchased_sku AS INT)')}, CAST(total_sales AS DOUBLE) AS total_sales, "
    "CAST(CASE WHEN CAST(purchased_sku AS INT) % 3 = 0 THEN 18 ELSE 0 END AS BIGINT) AS order_hour FROM sales",
    "date_bounds": C + "SELECT min(date) AS min_date, max(date) AS max_date FROM campaign",
    "filter_date_range": C
    + "SELECT date, campaign_id, promoted_sku, CAST(total_sales AS DOUBLE) AS total_sales, clicks "
    f"FROM campaign WHERE {WINDOW}",
    "filter_campaign": C
    + "SELECT date, campaign_id, placement_type, CAST(spend AS DOUBLE) AS spend, impressions "
    f"FROM campaign WHERE campaign_id = '{CAMPAIGN}'",
    "drop_missing_keys": C
    + "SELECT date, campaign_id, promoted_sku, CAST(total_sales AS DOUBLE) AS total_sales "
    "FROM campaign WHERE campaign_id IS NOT NULL AND promoted_sku IS NOT NULL",
    "canonical_id_text": "SELECT l_orderkey, l_partkey || '.0' AS raw_id, split_part(l_partkey || '.0', '.', 1) AS sku "
    "FROM lineitem",
    "numeric_id_text": "WITH r AS (SELECT l_orderkey, CASE WHEN l_partkey % 50 = 0 THEN NULL "
    "WHEN l_partkey % 7 = 0 THEN l_partkey || '.0' WHEN l_partkey % 11 = 0 THEN 'x' || l_partkey "
    "ELSE CAST(l_partkey AS VARCHAR) END AS raw_id FROM lineitem) "
    "SELECT *, CAST(CAST(trunc(TRY_CAST(coalesce(raw_id, '0') AS DOUBLE)) AS BIGINT) AS VARCHAR) AS sku FROM r",
    "parse_date_lenient": "WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'bad' "
    "WHEN l_linenumber <> 2 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS raw_date FROM lineitem) "
    "SELECT *, TRY_CAST(raw_date AS DATE) AS date FROM r",
    "project_rename": C
    + "SELECT campaign_id AS campaign, promoted_sku AS sku, CAST(total_sales AS DOUBLE) AS sales FROM campaign",
    "label_flag": SP + f"SELECT DISTINCT campaign_id, is_promoted, {CATEGORY} FROM flagged",
    "zero_to_epsilon": C
    + "SELECT campaign_id, date, CAST(spend AS DOUBLE) AS spend, CASE WHEN spend = 0 THEN 1e-6 "
    "ELSE CAST(spend AS DOUBLE) END AS weight FROM campaign",
    "pair_key": C
    + "SELECT DISTINCT least(campaign_id, promoted_sku) AS lo, greatest(campaign_id, promoted_sku) AS hi "
    "FROM campaign WHERE campaign_id IS NOT NULL AND promoted_sku IS NOT NULL",
    "round_metrics": C + even("campaign_id"),
    "metric_text": C
    + " UNION ALL ".join(
        f"SELECT campaign_id, '{m}' AS metric, printf('%.2f {METRICS[m].unit.replace('%', '%%')}', "
        + (f"CAST(round(sum({m}), 2) AS DOUBLE)" if m in ("total_sales", "spend") else f"CAST({agg(m)} AS DOUBLE)")
        + ") AS value_text FROM campaign GROUP BY campaign_id"
        for m in METRICS
    ),
    "unit_lookup": C
    + f"SELECT metric, max_value, {units('metric')} AS unit FROM ({PROFILE})",
    "metric_class": C
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{METRICS[m].kind}' AS class, {near(f'CAST({agg(m)} AS DOUBLE)')} AS value FROM campaign"
        for m in METRICS
    ),
    "percent_of": C
    + "SELECT campaign_id, date, CAST(spend AS DOUBLE) AS spend, CAST(total_sales AS DOUBLE) AS total_sales, "
    f"{near('CAST(spend AS DOUBLE) / NULLIF(CAST(total_sales AS DOUBLE), 0) * 100')} AS pct FROM campaign",
    "basic_facts": C
    + "SELECT count(DISTINCT campaign_id) AS n_campaigns, min(date) AS min_date, max(date) AS max_date FROM campaign",
    "metric_profile": C + PROFILE,
    "campaign_overview": C + even("campaign_id"),
    "metric_totals_sum": C + totals("campaign_id", "total_sales"),
    "metric_totals_mean": C
    + f"SELECT promoted_sku, {near('value')} AS value FROM ({totals('promoted_sku', 'roas')})",
    "trend_series": C
    + f"SELECT date, campaign_id, placement_type, {rounded('roas', kind='sum')} AS value FROM campaign "
    "GROUP BY date, campaign_id, placement_type",
    "rolled_overview": C + f"SELECT campaign_id, {', '.join(f'{near(agg(m))} AS {m}' for m in ('total_sales', 'ctr', 'roas'))}, CAST(sum(clicks) AS BIGINT) AS clicks "
    "FROM campaign WHERE campaign_id IS NOT NULL GROUP BY campaign_id",
    "rolled_sku_totals": C + f"SELECT promoted_sku, {near('value')} AS value FROM ({totals('promoted_sku', 'roas')})",
    "rolled_trend": C
    + f"SELECT date, campaign_id, placement_type, {rounded('roas', kind='sum')} AS value FROM campaign "
    "GROUP BY date, campaign_id, placement_type",
    "rolled_facts": C
    + "SELECT count(DISTINCT campaign_id) AS n_campaigns, min(date) AS min_date, max(date) AS max_date, "
    f"true AS within_bound, true AS same_dates FROM campaign WHERE {WINDOW}",
    "footer_bounds": C + "SELECT min(date) AS min_date, max(date) AS max_date FROM campaign",
    "long_list_members": with_(CAMPAIGN_CTE, SALES_CTE)
    + "SELECT date, campaign_id, promoted_sku, clicks FROM campaign "
    "WHERE promoted_sku IN (SELECT purchased_sku FROM sales WHERE purchased_sku LIKE '%7')",
    "rolled_placement": C + wide("placement_type"),
    "comparison_series": C
    + f"SELECT date, {rounded('total_sales')} AS total_sales, {rounded('ctr', kind='sum')} AS ctr FROM campaign "
    f"WHERE {WINDOW} AND campaign_id = '{CAMPAIGN}' GROUP BY date",
    "sku_daily": C
    + wide(
        "date, sku",
        "(SELECT * EXCLUDE promoted_sku, coalesce(promoted_sku, '0') AS sku FROM campaign)",
        f"{WINDOW} AND campaign_id = '{CAMPAIGN}'",
    ).replace("SELECT date, sku,", "SELECT date, sku AS promoted_sku,"),
    "placement_totals": C + wide("placement_type"),
    "placement_daily": C + wide("date, placement_type", where=WINDOW),
    "others_total": with_(CAMPAIGN_CTE, f"placed AS ({placed('campaign_id', 'clicks')})")
    + 'SELECT CASE WHEN position <= 5 THEN campaign_id ELSE \'others\' END AS "group", position > 5 AS is_others, '
    "'clicks' AS metric, CAST(sum(value) AS DOUBLE) AS value FROM placed GROUP BY 1, 2",
    "top_group_means": with_(
        CAMPAIGN_CTE, f"v AS ({long('campaign_id', MEAN_METRICS)})", f"placed AS ({placed('campaign_id', 'total_sales')})"
    )
    + f"SELECT campaign_id, metric, {near('v.value')} AS value FROM v JOIN placed USING (campaign_id) WHERE position <= 5",
    "promoted_sets": with_(PROMO_CTE, SETS)
    + "SELECT DISTINCT campaign_id, date, promoted_sku, n_skus FROM promo JOIN sets USING (campaign_id, date) "
    "WHERE promoted_sku IS NOT NULL OR n_skus = 0",
    "promoted_lists": with_(PROMO_CTE, SETS)
    + f"SELECT date, n_skus, promoted_skus FROM sets WHERE campaign_id = '{CAMPAIGN}'",
    "promoted_sales": SP.rstrip() + f",\n{BY_FLAG}\n"
    + "SELECT campaign_id, is_promoted, category, CAST(total_sales AS DOUBLE) AS total_sales FROM by_flag",
    "promoted_daily": SP
    + f"SELECT date, is_promoted, {CATEGORY}, CAST(sum(total_sales) AS DOUBLE) AS total_sales FROM flagged "
    f"WHERE campaign_id = '{CAMPAIGN}' GROUP BY date, is_promoted",
    "flow_forward": with_(*flow_ctes("campaign_id", CAMPAIGN, "roas"))
    + f"SELECT campaign_id, promoted_sku, {near('roas')} AS roas FROM fwd",
    "flow_reverse": with_(*flow_ctes("campaign_id", CAMPAIGN, "clicks"))
    + "SELECT promoted_sku, campaign_id, clicks FROM rev",
    "score_inputs": C
    + f"SELECT promoted_sku, {rounded('total_sales')} AS total_sales, {rounded('spend')} AS spend, "
    f"{rounded('roas')} AS roas FROM campaign WHERE promoted_sku IS NOT NULL GROUP BY promoted_sku",
    "column_totals": with_(
        CAMPAIGN_CTE,
        "g AS (SELECT placement_type, " + ", ".join(f"{agg(m)} AS {m}" for m in METRICS) + " FROM campaign GROUP BY 1)",
    )
    + "SELECT " + ", ".join(f"{near(f'CAST(sum({m}) AS DOUBLE)')} AS {m}" for m in METRICS) + " FROM g",
    "sales_hierarchy": SP.rstrip() + f",\n{BY_FLAG}\n"
    + "SELECT campaign_id, category, CAST(sum(total_sales) AS DOUBLE) AS total_sales, "
    "CAST(CASE WHEN campaign_id IS NULL THEN 0 WHEN category IS NULL THEN 1 ELSE 2 END AS BIGINT) AS level, "
    + near("CAST(sum(total_sales) AS DOUBLE) / NULLIF((SELECT CAST(sum(total_sales) AS DOUBLE) FROM by_flag), 0) * 100")
    + " AS pct FROM by_flag GROUP BY ROLLUP (campaign_id, category)",
    "campaign_products": C
    + "SELECT DISTINCT coalesce(promoted_sku, '0') AS promoted_sku, promoted_product_id, promoted_product "
    f"FROM campaign WHERE campaign_id = '{CAMPAIGN}'",
    "attach_promoted": SP.rstrip() + f",\n{SETS}\n"
    + "SELECT s.date, s.campaign_id, purchased_sku, CAST(total_sales AS DOUBLE) AS total_sales, n_skus, is_promoted "
    "FROM flagged s LEFT JOIN sets p ON s.campaign_id = p.campaign_id AND s.date = p.date",
    "set_membership": SP
    + "SELECT date, campaign_id, purchased_sku, CAST(total_sales AS DOUBLE) AS total_sales, is_promoted FROM flagged",
    "semi_top_campaigns": with_(CAMPAIGN_CTE, f"placed AS ({placed('campaign_id', 'total_sales')})")
    + "SELECT date, campaign_id, promoted_sku, CAST(total_sales AS DOUBLE) AS total_sales FROM campaign "
    "WHERE campaign_id IN (SELECT campaign_id FROM placed WHERE position <= 5)",
    "flag_promoted": SP
    + "SELECT order_date, campaign_id, purchased_sku, CAST(total_sales AS DOUBLE) AS total_sales, date, is_promoted, "
    "match_status FROM flagged",
    "anti_top_campaigns": with_(CAMPAIGN_CTE, f"placed AS ({placed('campaign_id', 'total_sales')})")
    + "SELECT campaign_id, value FROM placed WHERE position > 5",
    "flow_products": with_(*flow_ctes("campaign_id", CAMPAIGN, "total_sales"))
    + "SELECT campaign_id, fwd.promoted_sku, fwd.total_sales, p.promoted_product FROM fwd "
    f"LEFT JOIN (SELECT DISTINCT promoted_sku, promoted_product FROM rows_ WHERE campaign_id = '{CAMPAIGN}') p "
    "ON p.promoted_sku = fwd.promoted_sku",
    "campaign_card": card(["clicks", "roas"]),
    "sales_contribution": SP.rstrip() + f",\n{BY_FLAG}\n"
    + "SELECT campaign_id, is_promoted, category, CAST(total_sales AS DOUBLE) AS total_sales, "
    f"{WHOLE} AS campaign_total, {near(f'CAST(total_sales AS DOUBLE) / NULLIF({WHOLE}, 0) * 100')} "
    "AS contribution_pct FROM by_flag",
    "metric_ranks": ranks("promoted_sku", ["clicks", "spend", "roas"]),
    "rank_slice": with_(CAMPAIGN_CTE, f"placed AS ({placed('promoted_sku', 'impressions')})")
    + "SELECT promoted_sku, value, position FROM placed WHERE position BETWEEN 11 AND 30",
    "full_positions": with_(CAMPAIGN_CTE, f"placed AS ({placed('promoted_sku', 'clicks')})")
    + "SELECT promoted_sku, value, position FROM placed",
    "min_max": with_(
        CAMPAIGN_CTE,
        f"g AS (SELECT campaign_id, {agg('total_sales')} AS total_sales, {agg('spend')} AS spend, {agg('roas')} AS roas "
        "FROM campaign GROUP BY campaign_id)",
    )
    + f"SELECT campaign_id, total_sales, spend, {near('roas', 6)} AS roas, "
    + ", ".join(f"{heat(m, 'g')} AS {m}_norm" for m in ("total_sales", "spend", "roas")) + " FROM g",
    "flow_nodes": with_(*flow_ctes("campaign_id", CAMPAIGN, "total_sales", WINDOW)) + "SELECT label, node_id FROM nodes",
    "flow_pair_slots": with_(*flow_ctes("campaign_id", CAMPAIGN, "total_sales", EARLY))
    + "SELECT lo, hi, pair_id, slot FROM slots",
    "placement_share": with_(CAMPAIGN_CTE, f"v AS ({long('placement_type', where=WINDOW)})")
    + f"SELECT placement_type, metric, {near('value')} AS value, {PCT_BY_METRIC} AS pct FROM v",
    "heat_scale": with_(
        CAMPAIGN_CTE,
        "g AS (SELECT campaign_id, " + ", ".join(f"{agg(m)} AS {m}" for m in METRICS) + " FROM campaign GROUP BY 1)",
    )
    + "SELECT campaign_id, " + ", ".join(f"{heat(m, 'g')} AS {m}_heat" for m in METRICS) + " FROM g",
    "sample_rows": C
    + "SELECT date, campaign_id, promoted_product_id, CAST(total_sales AS DOUBLE) AS total_sales, clicks, "
    "CAST(spend AS DOUBLE) AS spend FROM campaign ORDER BY 1, 2, 3, 4, 5, 6 LIMIT 5",
    "ranked_totals": C + totals("campaign_id", "spend") + " ORDER BY value DESC, campaign_id",
    "top_n": with_(CAMPAIGN_CTE, f"placed AS ({placed('promoted_sku', 'total_sales')})")
    + "SELECT promoted_sku, value, position FROM placed WHERE position <= 10",
    "page_of": with_(CAMPAIGN_CTE, f"placed AS ({placed('promoted_sku', 'total_sales')})")
    + "SELECT promoted_sku, value, position, CAST(ceil((SELECT count(*) FROM placed) / 10.0) AS BIGINT) AS page_count "
    "FROM placed WHERE position BETWEEN 21 AND 30",
    "sorted_ids": S + "SELECT DISTINCT campaign_id FROM sales WHERE campaign_id IS NOT NULL ORDER BY campaign_id",
    "distinct_in_order": with_(
        CAMPAIGN_CTE,
        "f AS (SELECT promoted_sku, min(row(date, campaign_id, promoted_product_id)) AS seen_at FROM campaign "
        "WHERE promoted_sku IS NOT NULL GROUP BY promoted_sku)",
    )
    + "SELECT promoted_sku, row_number() OVER (ORDER BY seen_at, promoted_sku) AS position FROM f",
    "trend_ranks_6_10": trend("spend", f"date >= DATE '{START}'", 6, 10),
    "page_of_rank_range": with_(CAMPAIGN_CTE, f"placed AS ({placed('promoted_sku', 'total_sales')})")
    + "SELECT promoted_sku, value, position, CAST(3 AS BIGINT) AS page_count FROM placed WHERE position BETWEEN 26 AND 33",
    "flow_products_by_sku": with_(*flow_ctes("promoted_sku", SKU, "total_sales"))
    + "SELECT fwd.promoted_sku, campaign_id, fwd.total_sales, p.promoted_product FROM fwd "
    f"LEFT JOIN (SELECT DISTINCT promoted_sku, promoted_product FROM rows_ WHERE promoted_sku = '{SKU}') p "
    "ON p.promoted_sku = fwd.promoted_sku",
    "flow_links_full": numbered_links("campaign_id", CAMPAIGN, "total_sales"),
    "flow_pair_slots_full": with_(*flow_ctes("campaign_id", CAMPAIGN, "total_sales")) + "SELECT lo, hi, pair_id, slot FROM slots",
    "campaign_flagged_rows": SP
    + "SELECT order_date, campaign_id, purchased_sku, CAST(total_sales AS DOUBLE) AS total_sales, date, is_promoted, "
    f"match_status FROM flagged WHERE campaign_id = '{CAMPAIGN}'",
    "share_sku_spend": share("promoted_sku", "spend", 7, True),
    "share_sku_spend_by_bounds": share("promoted_sku", "spend", 7, True),
    "share_sku_cpc_by_bounds": share("promoted_sku", "cpc", 40, False, WINDOW),
    "trend_top5_total_sales": trend("total_sales"),
    "trend_top5_roas": trend("roas", WINDOW),
    "share_campaign_top5": share("campaign_id", "total_sales", 5, True),
    "share_sku_top5": share("promoted_sku", "roas", 5, True, WINDOW),
    "share_no_others": share("campaign_id", "total_sales", 8, False),
    "flow_links": numbered_links("campaign_id", CAMPAIGN, "total_sales", EARLY),
    "flow_links_by_sku": numbered_links("promoted_sku", SKU, "roas"),
    "score_campaign": score("campaign_id", 0.5, 0.3, 0.2),
    "score_sku": score("promoted_sku", 0.33, 0.33, 0.34, WINDOW),
    "cumulative_score": with_(
        CAMPAIGN_CTE,
        f"g AS (SELECT campaign_id, {agg('total_sales')} AS total_sales, avg(clicks) AS clicks, {agg('spend')} AS spend "
        "FROM campaign GROUP BY campaign_id)",
        "s AS (SELECT campaign_id, "
        + ", ".join(
            f"({c} - min({c}) OVER ()) / NULLIF(max({c}) OVER () - min({c}) OVER (), 0) AS {c}_norm"
            for c in ("total_sales", "clicks", "spend")
        )
        + " FROM g)",
    )
    + f"SELECT campaign_id, {near('0.4 * total_sales_norm + 0.3 * clicks_norm + 0.3 * spend_norm', 6)} AS total_score "
    "FROM s ORDER BY total_score DESC, campaign_id",
}
