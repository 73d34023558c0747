"""Queries that make every branch of the gates, unit factors and the serving
decision occur, and the remaining market and report tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions import columns as fn
from estatelens.operators.contract import AREA_TO_SQFT, PRICE_TO_CRORE
from estatelens.operators.encoders import fit_encoders
from estatelens.operators.evaluate import PREDICTORS, regression_metrics, residual_band, serving_decision
from estatelens.operators.features import unknown_furnishing_labels
from estatelens.operators.ingest import ingest_listings, map_and_convert
from estatelens.operators.rates import rate_sheet
from estatelens.operators.reports import correlations, histogram, skew_corrected
from estatelens.operators.serving import missing_signals, report_completeness, serving_reason, status_rollup
from estatelens.plans import oracle as O
from estatelens.plans.common import cleaned, oof_rules, round_floats
from estatelens.plans.ingest_queries import INGEST_SQL, TEST_CONTRACT, contract_feed
from estatelens.plans.rate_queries import RATES_AS_OF, RATES_LAST_UPDATED, RATES_SQL, rates_for
from estatelens.plans.registry import register
from estatelens.plans.report_queries import _OOF_RES
from estatelens.plans.valuation_queries import VQ_SQL, queries_batch

BINS = 48


def _histogram_sql(table: str, value: str) -> str:
    """48 equal-width bins of ``value`` per city, the last one closed."""
    return f"""
, x AS (SELECT city_key, {value} AS v FROM {table} WHERE {value} IS NOT NULL),
r AS (SELECT city_key, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
             CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM x GROUP BY city_key),
b AS (SELECT x.city_key, CAST(least(floor((v - lo) / ((hi - lo) / {BINS})), {BINS - 1}) AS INTEGER) AS bin FROM x JOIN r USING (city_key)),
c AS (SELECT city_key, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT city_key, lo, hi, CAST(unnest(range({BINS})) AS INTEGER) AS bin FROM r)
SELECT g.city_key, g.bin, round(lo + bin * ((hi - lo) / {BINS}), 6) AS lo, round(lo + (bin + 1) * ((hi - lo) / {BINS}), 6) AS hi,
       coalesce(n, 0) AS n
FROM g LEFT JOIN c USING (city_key, bin)"""


@register("ppsf_histogram", O.with_ctes(O.CLEAN_LISTINGS, _histogram_sql("listings", "price_per_sqft")))
def q_ppsf_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-5: price per sq.ft."""
    return round_floats(histogram(cleaned(spark, sf_dir)[0], "price_per_sqft", BINS))


@register("residual_skewness", O.with_ctes(_OOF_RES, """
SELECT city_key, round(skewness(res), 6) AS skew_residual, count(*) AS n FROM oofr GROUP BY city_key"""))
def q_residual_skewness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-6: bias-corrected skewness of the rule's out-of-fold log residuals."""
    return round_floats(oof_rules(spark, sf_dir).groupBy("city_key").agg(
        skew_corrected(F.col("res")).alias("skew_residual"), F.count(F.lit(1)).alias("n")))


@register("residual_histogram_48", O.with_ctes(_OOF_RES, _histogram_sql("oofr", "res")))
def q_residual_histogram_48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-5: the rule's out-of-fold log residuals."""
    return round_floats(histogram(oof_rules(spark, sf_dir), "res", BINS))


_ELEVEN = {"price": "price", "price_per_sqft": "price_per_sqft", "area": "area", "bedrooms": "bedrooms", "bathrooms": "bathrooms",
           "luxury_score": "luxury_score",
           "is_house": "CASE WHEN property_type = 'house' THEN 1.0 ELSE 0.0 END",
           "furnishing_code": "CASE furnishing_type WHEN 'unfurnished' THEN 0 WHEN 'semi-furnished' THEN 1 WHEN 'furnished' THEN 2 END",
           "age_code": "coalesce(CASE age_possession WHEN 'Under Construction' THEN 0 WHEN 'New Property' THEN 1 WHEN 'Relatively New' THEN 2 "
                       "WHEN 'Moderately Old' THEN 3 WHEN 'Old Property' THEN 4 END, -1)",
           "balcony_code": "coalesce(CASE balcony WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '3+' THEN 4 END, -1)",
           "log_price": "ln(price)"}
_PAIRS = [(a, b) for i, a in enumerate(_ELEVEN) for b in list(_ELEVEN)[i + 1:]]


@register("correlation_matrix_11", O.with_ctes(O.CLEAN_LISTINGS, ", w AS (SELECT city_key, " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {c}" for c, e in _ELEVEN.items()) + " FROM listings) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT city_key, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM w GROUP BY city_key" for a, b in _PAIRS) + ")"))
def q_correlation_matrix_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-8 / FN-10..14: 55 pairwise-complete correlations of eleven numeric columns, label codes among them."""
    listings, _ = cleaned(spark, sf_dir)
    wide = listings.select("city_key", "price", "price_per_sqft", "area", "bedrooms", "bathrooms", "luxury_score",
                           fn.is_house("property_type").alias("is_house"), fn.furnishing_code("furnishing_type").alias("furnishing_code"),
                           fn.age_code("age_possession").alias("age_code"), fn.balcony_code("balcony").alias("balcony_code"),
                           F.log("price").alias("log_price"))
    return round_floats(correlations(wide, list(_ELEVEN)))


@register("global_encoder_table", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, round(quantile_cont(price_per_sqft, 0.5), 6) AS g_median, round(avg(price_per_sqft), 6) AS g_mean,
       round(stddev_samp(price_per_sqft), 6) AS g_std, count(*) AS g_count
FROM listings GROUP BY city_key"""))
def q_global_encoder_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-2: the city-level encoder table."""
    return round_floats(fit_encoders(cleaned(spark, sf_dir)[0]).global_stats.drop("fold"))


# ---- unit factors and gate refusals ----

_UNITS = [(a, p) for a in AREA_TO_SQFT for p in PRICE_TO_CRORE]


@register("unit_conversions", O.with_ctes(INGEST_SQL, "SELECT * FROM (" + " UNION ALL ".join(f"""
SELECT city_key, '{a}' AS area_unit, '{p}' AS price_unit, round(sum(area) * {AREA_TO_SQFT[a]}, 3) AS total_area,
       round(sum(price) / 1e-2 * {PRICE_TO_CRORE[p]}, 6) AS total_price, count(price_per_sqft) AS n_rated
FROM mapped GROUP BY city_key""" for a, p in _UNITS) + ")"))
def q_unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-3..5: the feed read under every declared pair of units."""
    feed, out = contract_feed(spark, sf_dir), None
    for a, p in _UNITS:
        m = map_and_convert(feed, replace(TEST_CONTRACT, area_unit=a, price_unit=p))
        g = m.groupBy("city_key").agg(F.round(F.sum("area"), 3).alias("total_area"), F.round(F.sum("price"), 6).alias("total_price"),
                                      F.count("price_per_sqft").alias("n_rated"))
        g = g.withColumns({"area_unit": F.lit(a), "price_unit": F.lit(p)})
        out = g if out is None else out.unionByName(g)
    return out.select("city_key", "area_unit", "price_unit", "total_area", "total_price", "n_rated")


#: Variants of the feed's declaration: what each changes, and by how much areas and prices then come out.
_VARIANTS = {
    "as_declared": ({}, 1.0, 1.0),
    "price_in_crore": ({"price_unit": "crore"}, 1.0, 100.0),
    "price_in_rupees": ({"price_unit": "rupees"}, 1.0, 1e-5),
    "area_in_sqm": ({"area_unit": "sqm"}, 10.7639, 1.0),
    "narrow_range": ({"expected_ppsf_range": (1.0, 2.0)}, 1.0, 1.0),
    "label_left_out": ({"area_basis_labels": {k: v for k, v in TEST_CONTRACT.area_basis_labels.items() if v != "carpet"}}, 1.0, 1.0),
}


def _gate_sql(name: str) -> str:
    change, area, price = _VARIANTS[name]
    lo, hi = change.get("expected_ppsf_range", TEST_CONTRACT.expected_ppsf_range)
    ppsf = f"(median_ppsf * {price} / {area})"
    unit = {"lakh": ("rupees", "crore"), "crore": ("lakh", None), "rupees": (None, "lakh")}[change.get("price_unit", "lakh")]
    lit = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"
    left_out = "area_basis_labels" in change
    return f"""
SELECT '{name}' AS variant, city_key, reason IS NULL AS passed, reason,
       CASE WHEN price_reason = 'price_unit' THEN CASE WHEN {ppsf} > 100000 THEN {lit(unit[0])} ELSE {lit(unit[1])} END END AS suggested_unit,
       {'1' if left_out else '0'}::BIGINT AS n_unmapped_labels
FROM (SELECT *, {"'unmapped_label'" if left_out else 'price_reason'} AS reason FROM (SELECT *, CASE
    WHEN non_positive_prices > 0 THEN 'price_sign'
    WHEN NOT coalesce(median_area * {area} BETWEEN 100 AND 20000, false) THEN 'area_unit'
    WHEN NOT coalesce({ppsf} BETWEEN 1000 AND 100000, false) THEN 'price_unit'
    WHEN NOT coalesce({ppsf} BETWEEN {lo} AND {hi}, false) THEN 'city_range' END AS price_reason FROM gate))"""


@register("ingest_gate_refusals", O.with_ctes(INGEST_SQL, "SELECT * FROM (" + " UNION ALL ".join(map(_gate_sql, _VARIANTS)) + ")"))
def q_ingest_gate_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-5..9 / FN-18: the gate's verdict on wrongly declared feeds, by city."""
    feed, out = contract_feed(spark, sf_dir), None
    for name, (change, _, _) in _VARIANTS.items():
        gate = ingest_listings(feed, replace(TEST_CONTRACT, **change)).gate_report.select(
            F.lit(name).alias("variant"), "city_key", "passed", "reason", "suggested_unit",
            F.col("n_unmapped_labels").cast("bigint").alias("n_unmapped_labels"))
        out = gate if out is None else out.unionByName(gate)
    return out


# ---- serving decision on a table of errors that takes all branches ----

_ERRORS_SQL = """SELECT n_name AS city_key, round(15 + 25 * sum(CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END) / count(*)
              + (n_nationkey % 4) * 4, 6) AS model_mape, round(15 + 25 * sum(CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END) / count(*)
              + (n_nationkey % 4) * 4 + (n_nationkey % 3 - 1) * 3, 6) AS baseline_mape
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey"""


@register("serving_decision_branches", f"""
WITH e AS ({_ERRORS_SQL}),
d AS (SELECT *, model_mape < baseline_mape AS model_beats_baseline, least(model_mape, baseline_mape) < 30 AS meets_quality_floor FROM e),
s AS (SELECT *, CASE WHEN NOT meets_quality_floor THEN 'not_served' WHEN model_beats_baseline THEN 'model' ELSE 'baseline' END AS serving_status FROM d)
SELECT city_key, model_mape, baseline_mape, model_beats_baseline, meets_quality_floor, NOT model_beats_baseline AS baseline_served, serving_status,
       CASE serving_status WHEN 'not_served' THEN 'floor'
            WHEN 'baseline' THEN CASE WHEN abs(model_mape - baseline_mape) < 1e-9 THEN 'tie' ELSE 'rule_ahead' END END AS served_reason,
       CASE WHEN length(city_key) % 2 = 0 THEN 'society_ppsf,furnishing_code,age_code,balcony_code,luxury_score,amenity_count,is_resale' ELSE '' END
         AS missing_signals
FROM s""")
def q_serving_decision_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV-1..4 / FN-21: all statuses and reasons, on errors derived from the customer table."""
    from estatelens.operators.serving import SIGNAL_FEATURES
    from estatelens.sources.tables import read_table
    c = read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    share = 15 + 25 * F.sum(F.when(F.col("c_custkey") % 3 == 0, 1.0).otherwise(0.0)) / F.count(F.lit(1))
    e = c.groupBy(F.col("n_name").alias("city_key"), "n_nationkey").agg(share.alias("m"))
    model = F.round(F.col("m") + F.col("n_nationkey") % 4 * 4, 6)
    rule = F.round(F.col("m") + F.col("n_nationkey") % 4 * 4 + (F.col("n_nationkey") % 3 - 1) * 3, 6)
    rows = e.select("city_key", F.explode(F.array(F.struct(F.lit("model").alias("predictor"), model.alias("mape_pct")),
                                                  F.struct(F.lit("baseline_sector").alias("predictor"), rule.alias("mape_pct")))).alias("r"))
    d = serving_decision(rows.select("city_key", "r.*"))
    features = F.when(F.length("city_key") % 2 == 0, F.array(F.lit("area"), F.lit("bathrooms"), F.lit("is_house"))).otherwise(
        F.array(*[F.lit(f) for f in SIGNAL_FEATURES]))
    return d.withColumns({"served_reason": serving_reason(F.col("serving_status"), F.col("model_mape"), F.col("baseline_mape")),
                          "missing_signals": missing_signals(features)})


@register("rate_sheet", O.with_ctes(RATES_SQL, f"""
SELECT zone, property_type, source, CAST(source_date AS VARCHAR) AS source_date, round(rate_low_per_sqft, 6) AS rate_low_per_sqft,
       round(rate_high_per_sqft, 6) AS rate_high_per_sqft, '{RATES_LAST_UPDATED}' AS last_updated, 183 AS staleness_days,
       (DATE '{RATES_AS_OF}' - DATE '{RATES_LAST_UPDATED}') > 183 AS stale
FROM rates"""))
def q_rate_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-6: every rate row with the table's date and the staleness threshold."""
    return round_floats(rate_sheet(rates_for(spark, sf_dir), RATES_LAST_UPDATED, RATES_AS_OF))


@register("city_status_rollup", f"""
WITH e AS ({_ERRORS_SQL}),
d AS (SELECT city_key, CASE WHEN NOT least(model_mape, baseline_mape) < 30 THEN 'not_served'
                            WHEN model_mape < baseline_mape THEN 'model' ELSE 'baseline' END AS serving_status
      FROM e JOIN nation ON n_name = city_key WHERE n_nationkey % 5 <> 0),
r AS (SELECT n_name AS city_key FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name FROM region),
c AS (SELECT n_name AS city_key FROM nation UNION SELECT city_key FROM r)
SELECT c.city_key, CASE WHEN serving_status IN ('model', 'baseline') THEN serving_status WHEN r.city_key IS NOT NULL THEN 'rates'
                        ELSE coalesce(serving_status, 'none') END AS status,
       serving_status IS NOT NULL AS evaluated, r.city_key IS NOT NULL AS has_rates
FROM c LEFT JOIN d USING (city_key) LEFT JOIN r ON r.city_key = c.city_key""")
def q_city_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-4: nations as cities, a fifth of them never evaluated, half of them with rates, regions known from rates only."""
    from estatelens.sources.tables import read_table
    nation = read_table(spark, sf_dir, "nation")
    decision = q_serving_decision_branches(spark, sf_dir).join(
        nation.where("n_nationkey % 5 != 0").select(F.col("n_name").alias("city_key")), "city_key", "left_semi")
    rates = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("city_key")).unionByName(
        read_table(spark, sf_dir, "region").select(F.col("r_name").alias("city_key")))
    return status_rollup(nation.select(F.col("n_name").alias("city_key")), decision, rates)


@register("rule_report_completeness", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, part, part NOT IN ('metrics:model', 'metrics:model_no_society') AS present
FROM (SELECT DISTINCT city_key FROM listings),
     (SELECT unnest(['metrics:model', 'metrics:model_no_society', 'metrics:baseline_sector', 'metrics:baseline_global',
                     'encoders', 'band']) AS part)"""))
def q_rule_report_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-5 for the rules' report: model rows are missing from it, everything else is there."""
    listings, _ = cleaned(spark, sf_dir)
    oof = oof_rules(spark, sf_dir)
    return report_completeness(listings, PREDICTORS, regression_metrics(oof, ["baseline_sector", "baseline_global"]),
                               {"encoders": fit_encoders(listings).sector_stats, "band": residual_band(oof, "pred_baseline_sector")})


@register("unknown_query_furnishing", O.with_ctes(VQ_SQL, """
SELECT DISTINCT city_key, furnishing AS furnishing_type FROM vq
WHERE furnishing IS NOT NULL AND furnishing NOT IN ('unfurnished', 'semi-furnished', 'furnished')"""))
def q_unknown_query_furnishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-15 on rows that do hold labels without a code: the valuation query batch."""
    return unknown_furnishing_labels(queries_batch(spark, sf_dir).withColumnRenamed("furnishing", "furnishing_type"))
