"""Market statistics, exploratory tables and report pieces with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions.columns import AGE_CODES
from estatelens.operators.cleaning import public_feed, standardize_columns
from estatelens.operators.evaluate import residual_band
from estatelens.operators.quantiles import multi_quantiles, rank_within, top_k_per_group
from estatelens.operators.reports import (assign_quintile, box_stats, correlations, describe, duplicate_count,
                                          histogram, missing_share, quintile_edges, sample_listings, skew_corrected,
                                          value_counts)
from estatelens.plans import oracle as O
from estatelens.plans.common import cleaned, oof_rules, round_floats
from estatelens.plans.registry import register
from estatelens.sources.listings import raw_listings

NUMERIC = ["price", "price_per_sqft", "area", "bedrooms", "bathrooms", "luxury_score"]


def _oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oof_rules(spark, sf_dir)


def _std_feed(spark, sf_dir):
    return standardize_columns(public_feed(raw_listings(spark, sf_dir)))


_UNPIVOT_NUM = """(SELECT city_key, 'price' AS column_name, CAST(price AS DOUBLE) AS v FROM listings
  UNION ALL SELECT city_key, 'price_per_sqft', price_per_sqft FROM listings
  UNION ALL SELECT city_key, 'area', area FROM listings
  UNION ALL SELECT city_key, 'bedrooms', CAST(bedrooms AS DOUBLE) FROM listings
  UNION ALL SELECT city_key, 'bathrooms', CAST(bathrooms AS DOUBLE) FROM listings
  UNION ALL SELECT city_key, 'luxury_score', CAST(luxury_score AS DOUBLE) FROM listings)"""


@register("market_describe", O.with_ctes(O.CLEAN_LISTINGS, f"""
SELECT city_key, column_name, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max
FROM {_UNPIVOT_NUM} GROUP BY city_key, column_name"""))
def q_market_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-1: describe() of the numeric columns per city (exact quartiles)."""
    listings, _ = cleaned(spark, sf_dir)
    return round_floats(describe(listings, NUMERIC))


@register("duplicate_count", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, CAST(sum(_copies) - count(*) AS BIGINT) AS duplicates FROM dedup GROUP BY city_key"""))
def q_duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-2: rows of the raw feed that repeat an earlier row."""
    std = _std_feed(spark, sf_dir)
    return duplicate_count(std, [c for c in std.columns if c != "listing_id"])


@register("missing_share", O.with_ctes(O.CLEAN_LISTINGS, """
, per AS (
  SELECT city_key, count(*) AS n, count(*) FILTER (WHERE society IS NULL) AS society,
         count(*) FILTER (WHERE price IS NULL) AS price, count(*) FILTER (WHERE balcony IS NULL) AS balcony,
         count(*) FILTER (WHERE property_type IS NULL) AS property_type, count(*) FILTER (WHERE sector IS NULL) AS sector
  FROM std GROUP BY city_key
)
SELECT city_key, column_name, round(100.0 * nulls / n, 6) AS missing_pct
FROM (SELECT city_key, n, 'society' AS column_name, society AS nulls FROM per
      UNION ALL SELECT city_key, n, 'price', price FROM per
      UNION ALL SELECT city_key, n, 'balcony', balcony FROM per
      UNION ALL SELECT city_key, n, 'property_type', property_type FROM per
      UNION ALL SELECT city_key, n, 'sector', sector FROM per)
WHERE nulls > 0"""))
def q_missing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-3: percent missing per column of the raw feed (columns with any)."""
    std = _std_feed(spark, sf_dir)
    return round_floats(missing_share(std, ["society", "price", "balcony", "property_type", "sector"]))


@register("property_type_counts", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, property_type AS label, count(*) AS n FROM listings WHERE property_type IS NOT NULL
GROUP BY city_key, property_type"""))
def q_property_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-4: listings per property type."""
    listings, _ = cleaned(spark, sf_dir)
    return value_counts(listings, F.col("property_type"))


_AGE_ORDER = list(AGE_CODES)
_AGE_VALUES = ", ".join(f"('{a}', {i})" for i, a in enumerate(_AGE_ORDER))


@register("age_counts_ordered", O.with_ctes(O.CLEAN_LISTINGS, f"""
, labels(label, ordinal) AS (VALUES {_AGE_VALUES}),
cities AS (SELECT DISTINCT city_key FROM listings),
c AS (SELECT city_key, age_possession AS label, count(*) AS n FROM listings GROUP BY ALL)
SELECT ci.city_key, l.label, CAST(l.ordinal AS INTEGER) AS ordinal, coalesce(c.n, 0) AS n
FROM cities ci CROSS JOIN labels l LEFT JOIN c ON c.city_key = ci.city_key AND c.label = l.label"""))
def q_age_counts_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-4 + ORD-1: possession counts laid on the fixed label order."""
    listings, _ = cleaned(spark, sf_dir)
    return value_counts(listings, F.col("age_possession"), order=_AGE_ORDER)


@register("bedroom_counts", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, CASE WHEN bedrooms > 6 THEN '>6' ELSE CAST(bedrooms AS VARCHAR) END AS label, count(*) AS n
FROM listings WHERE bedrooms IS NOT NULL GROUP BY ALL"""))
def q_bedroom_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-4: listings per bedroom count, counts above 6 pooled as '>6'."""
    listings, _ = cleaned(spark, sf_dir)
    b = F.when(F.col("bedrooms") > 6, F.lit(">6")).otherwise(F.col("bedrooms").cast("string"))
    return value_counts(listings, b)


@register("price_histogram", O.with_ctes(O.CLEAN_LISTINGS, """
, r AS (SELECT city_key, CASE WHEN min(price) = max(price) THEN min(price) - 0.5 ELSE min(price) END AS lo,
               CASE WHEN min(price) = max(price) THEN max(price) + 0.5 ELSE max(price) END AS hi
        FROM listings GROUP BY city_key),
b AS (SELECT l.city_key, CAST(least(floor((price - lo) / ((hi - lo) / 48)), 47) AS INTEGER) AS bin
      FROM listings l JOIN r USING (city_key)),
c AS (SELECT city_key, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT city_key, lo, hi, CAST(unnest(range(48)) AS INTEGER) AS bin FROM r)
SELECT g.city_key, g.bin, round(lo + bin * ((hi - lo) / 48), 6) AS lo, round(lo + (bin + 1) * ((hi - lo) / 48), 6) AS hi,
       coalesce(n, 0) AS n
FROM g LEFT JOIN c USING (city_key, bin)"""))
def q_price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-5 / AGG-9: 48 equal-width price bins per city, last bin closed."""
    listings, _ = cleaned(spark, sf_dir)
    return round_floats(histogram(listings, "price", 48))


@register("price_skewness", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, round(skewness(price), 6) AS skew_price, round(skewness(ln(price)), 6) AS skew_log_price
FROM listings GROUP BY city_key"""))
def q_price_skewness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-6: bias-corrected skewness of price and log price."""
    listings, _ = cleaned(spark, sf_dir)
    return round_floats(listings.groupBy("city_key").agg(
        skew_corrected(F.col("price")).alias("skew_price"),
        skew_corrected(F.log("price")).alias("skew_log_price")))


@register("segment_stats", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, property_type, round(corr(area, price), 6) AS corr_area_price,
       round(quantile_cont(price, 0.5), 6) AS median_price, round(quantile_cont(price_per_sqft, 0.5), 6) AS median_ppsf
FROM listings GROUP BY city_key, property_type"""))
def q_segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-7: per property type, area-price correlation and medians."""
    listings, _ = cleaned(spark, sf_dir)
    keys = ["city_key", "property_type"]
    c = listings.groupBy(*keys).agg(F.corr("area", "price").alias("corr_area_price"))
    m = multi_quantiles(listings, keys, {"price": {"median_price": 0.5}, "price_per_sqft": {"median_ppsf": 0.5}})
    return round_floats(c.join(m, keys, "left"))


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]


@register("correlation_matrix", O.with_ctes(O.CLEAN_LISTINGS, "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT city_key, '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr "
    f"FROM listings GROUP BY city_key" for a, b in _PAIRS) + ")"))
def q_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-8: pairwise-complete correlations of the numeric columns."""
    listings, _ = cleaned(spark, sf_dir)
    return round_floats(correlations(listings, NUMERIC))


@register("bedroom_box_stats", O.with_ctes(O.CLEAN_LISTINGS, """
, q AS (SELECT city_key, bedrooms, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
               quantile_cont(price, 0.75) AS q3 FROM listings WHERE bedrooms BETWEEN 1 AND 5 GROUP BY ALL)
SELECT q.city_key, q.bedrooms, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(price) FILTER (WHERE price >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
       round(max(price) FILTER (WHERE price <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi
FROM listings l JOIN q USING (city_key, bedrooms) GROUP BY q.city_key, q.bedrooms, q1, median, q3"""))
def q_bedroom_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-9: price box statistics for 1-5 bedrooms."""
    listings, _ = cleaned(spark, sf_dir)
    return round_floats(box_stats(listings.where(F.col("bedrooms").between(1, 5)), "price", "bedrooms"))


@register("age_composition", O.with_ctes(O.CLEAN_LISTINGS, f"""
, labels(label, ordinal) AS (VALUES {_AGE_VALUES}),
a AS (SELECT city_key, age_possession AS label, quantile_cont(price_per_sqft, 0.5) AS median_ppsf_all,
             avg(CASE WHEN property_type = 'house' THEN 1.0 ELSE 0.0 END) AS house_share
      FROM listings WHERE age_possession IS NOT NULL GROUP BY ALL),
f AS (SELECT city_key, age_possession AS label, quantile_cont(price_per_sqft, 0.5) AS median_ppsf_flats
      FROM listings WHERE age_possession IS NOT NULL AND property_type = 'flat' GROUP BY ALL)
SELECT a.city_key, a.label, CAST(l.ordinal AS INTEGER) AS ordinal, round(median_ppsf_all, 6) AS median_ppsf_all,
       round(median_ppsf_flats, 6) AS median_ppsf_flats, round(house_share, 6) AS house_share
FROM a JOIN labels l USING (label) LEFT JOIN f USING (city_key, label)"""))
def q_age_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-10 / EDA-11: median ppsf by possession age over all listings and
    inside flats only, with the share of houses per age (composition)."""
    listings, _ = cleaned(spark, sf_dir)
    df = listings.where(F.col("age_possession").isNotNull()).withColumn("label", F.col("age_possession"))
    keys = ["city_key", "label"]
    allq = multi_quantiles(df, keys, {"price_per_sqft": {"median_ppsf_all": 0.5}})
    share = df.groupBy(*keys).agg(F.avg((F.col("property_type") == "house").cast("double")).alias("house_share"))
    flats = multi_quantiles(df.where(F.col("property_type") == "flat"), keys,
                            {"price_per_sqft": {"median_ppsf_flats": 0.5}})
    order = F.create_map(*[x for i, a in enumerate(_AGE_ORDER) for x in (F.lit(a), F.lit(i))])
    out = (allq.join(share, keys).join(flats, keys, "left")
               .withColumn("ordinal", order[F.col("label")].cast("int")))
    return round_floats(out.select("city_key", "label", "ordinal", "median_ppsf_all", "median_ppsf_flats",
                                   "house_share"))


@register("price_quantiles", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, round(quantile_cont(price, 0.25), 6) AS p25, round(quantile_cont(price, 0.5), 6) AS median,
       round(quantile_cont(price, 0.75), 6) AS p75, round(avg(price), 6) AS mean, round(max(price), 6) AS max
FROM listings GROUP BY city_key"""))
def q_price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-12: price quartiles, mean and maximum per city."""
    listings, _ = cleaned(spark, sf_dir)
    q = multi_quantiles(listings, ["city_key"], {"price": {"p25": 0.25, "median": 0.5, "p75": 0.75}})
    m = listings.groupBy("city_key").agg(F.avg("price").alias("mean"), F.max("price").alias("max"))
    return round_floats(q.join(m, "city_key"))


_OOF_RES = O.OOF_RULES + """,
oofr AS (SELECT *, ln(pred_baseline_sector) - ln(price) AS res FROM oof)"""


@register("rule_quintile_errors", O.with_ctes(_OOF_RES, """
, e AS (SELECT city_key, quantile_cont(price, 0.2) AS e1, quantile_cont(price, 0.4) AS e2,
               quantile_cont(price, 0.6) AS e3, quantile_cont(price, 0.8) AS e4, quantile_cont(price, 1.0) AS e5
        FROM oofr GROUP BY city_key),
q AS (SELECT o.*, CASE WHEN price <= e1 THEN 1 WHEN price <= e2 THEN 2 WHEN price <= e3 THEN 3 WHEN price <= e4 THEN 4
                       WHEN price <= e5 THEN 5 END AS quintile
      FROM oofr o JOIN e USING (city_key))
SELECT city_key, CAST(quintile AS INTEGER) AS quintile, count(*) AS n,
       printf('%.2f-%.2f', min(price), max(price)) AS price_range,
       round(avg(res), 6) AS mean_log_residual,
       round(quantile_cont(abs(exp(res) - 1) * 100, 0.5), 6) AS median_ape_pct,
       round(avg(abs(exp(res) - 1) * 100), 6) AS mape_pct
FROM q GROUP BY city_key, quintile"""))
def q_rule_quintile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-13..15: price quintiles (qcut edges), the locality rule's mean
    signed log residual and its error per quintile."""
    oof = _oof(spark, sf_dir)
    e = quintile_edges(oof, "price")
    q = (oof.join((e), "city_key").withColumn("quintile", assign_quintile(F.col("price")).cast("int"))
            .withColumn("ape", F.abs(F.exp("res") - 1) * 100))
    keys = ["city_key", "quintile"]
    agg = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                               F.format_string("%.2f-%.2f", F.min("price"), F.max("price")).alias("price_range"),
                               F.avg("res").alias("mean_log_residual"), F.avg("ape").alias("mape_pct"))
    med = multi_quantiles(q, keys, {"ape": {"median_ape_pct": 0.5}})
    return round_floats(agg.join(med, keys, "left"))


@register("rule_residual_band", O.with_ctes(_OOF_RES, """
SELECT city_key, round(quantile_cont(res, 0.1), 6) AS q10, round(quantile_cont(res, 0.9), 6) AS q90,
       round(exp(-quantile_cont(res, 0.9)) - 1, 6) AS band_lo_pct, round(exp(-quantile_cont(res, 0.1)) - 1, 6) AS band_hi_pct
FROM oofr GROUP BY city_key"""))
def q_rule_residual_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7 (rule): 10th / 90th percentile of the rule's OOF log residuals
    and the price band they imply."""
    oof = _oof(spark, sf_dir)
    b = residual_band(oof, "pred_baseline_sector")
    return round_floats(b.withColumns({"band_lo_pct": F.exp(-F.col("q90")) - 1,
                                       "band_hi_pct": F.exp(-F.col("q10")) - 1}))


@register("residual_histogram", O.with_ctes(_OOF_RES, """
, r AS (SELECT city_key, CASE WHEN min(res) = max(res) THEN min(res) - 0.5 ELSE min(res) END AS lo,
               CASE WHEN min(res) = max(res) THEN max(res) + 0.5 ELSE max(res) END AS hi FROM oofr GROUP BY city_key),
b AS (SELECT o.city_key, CAST(least(floor((res - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin
      FROM oofr o JOIN r USING (city_key)),
c AS (SELECT city_key, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT city_key, lo, hi, CAST(unnest(range(20)) AS INTEGER) AS bin FROM r)
SELECT g.city_key, g.bin, round(lo + bin * ((hi - lo) / 20), 6) AS lo, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS hi,
       coalesce(n, 0) AS n
FROM g LEFT JOIN c USING (city_key, bin)"""))
def q_residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9: 20-bin histogram of the rule's OOF log residuals."""
    return round_floats(histogram(_oof(spark, sf_dir), "res", 20))


@register("training_ranges", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, c AS column_name, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (
  SELECT city_key, 'area' AS c, min(area) AS lo, max(area) AS hi FROM listings GROUP BY city_key
  UNION ALL SELECT city_key, 'bedrooms', min(bedrooms), max(bedrooms) FROM listings GROUP BY city_key
  UNION ALL SELECT city_key, 'bathrooms', min(bathrooms), max(bathrooms) FROM listings GROUP BY city_key
  UNION ALL SELECT city_key, 'luxury_score', min(luxury_score), max(luxury_score) FROM listings GROUP BY city_key)"""))
def q_training_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8: training range of every numeric input a query may carry."""
    from estatelens.operators.valuation import training_ranges
    listings, _ = cleaned(spark, sf_dir)
    return round_floats(training_ranges(listings))


@register("top_areas", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, listing_id, round(area, 6) AS area, sector, round(price, 6) AS price, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY city_key ORDER BY area DESC, listing_id) AS rank FROM listings)
WHERE rank <= 5"""))
def q_top_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2: the five largest listings of every city."""
    listings, _ = cleaned(spark, sf_dir)
    top = top_k_per_group(listings, ["city_key"], [F.desc("area"), F.asc("listing_id")], 5)
    return round_floats(top.select("city_key", "listing_id", "area", "sector", "price", "rank"))


@register("top_sectors", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, name, n, median_price_cr, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY city_key ORDER BY median_price_cr DESC, name) AS rank FROM (
    SELECT city_key, sector AS name, count(*) AS n, round(quantile_cont(price, 0.5), 6) AS median_price_cr
    FROM listings WHERE sector IS NOT NULL GROUP BY city_key, sector HAVING count(*) >= 30))
WHERE rank <= 12"""))
def q_top_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-3: the twelve dearest localities with at least 30 listings."""
    from estatelens.plans.queries import sector_summary
    listings, _ = cleaned(spark, sf_dir)
    s = round_floats(sector_summary(listings)).select("city_key", "name", "n", "median_price_cr")
    return top_k_per_group(s, ["city_key"], [F.desc("median_price_cr"), F.asc("name")], 12)


@register("extreme_residual_share", O.with_ctes(_OOF_RES, """
, e AS (SELECT city_key, quantile_cont(price, 0.2) AS e1, quantile_cont(price, 0.8) AS e4, count(*) AS n
        FROM oofr GROUP BY city_key),
r AS (SELECT o.city_key, o.price, e.e1, e.e4, e.n,
             row_number() OVER (PARTITION BY o.city_key ORDER BY res DESC, listing_id) AS r_hi,
             row_number() OVER (PARTITION BY o.city_key ORDER BY res ASC, listing_id) AS r_lo
      FROM oofr o JOIN e USING (city_key))
SELECT city_key,
       round(avg(CASE WHEN price <= e1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE r_hi <= CAST(floor(0.1 * n) AS BIGINT)), 6)
         AS over_share_q1,
       round(avg(CASE WHEN price > e4 THEN 1.0 ELSE 0.0 END) FILTER (WHERE r_lo <= CAST(floor(0.1 * n) AS BIGINT)), 6)
         AS under_share_q5
FROM r GROUP BY city_key"""))
def q_extreme_residual_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-4: of the 10% largest over-estimates of the rule, the share in the
    cheapest quintile; of the 10% largest under-estimates, the share in the
    dearest quintile."""
    oof = _oof(spark, sf_dir).select("city_key", "listing_id", "price", "res")
    e = multi_quantiles(oof, ["city_key"], {"price": {"e1": 0.2, "e4": 0.8}, "res": {"most": 0.89, "least": 0.11}}, count_prefix="n_")
    # more than a tenth of a city's residuals lie at or beyond either bound: the others need no rank (all rows have one where residuals are missing)
    whole = F.col("n_res") < F.col("n_price")
    base = oof.join((e), "city_key")
    hi = rank_within(base.where(F.coalesce(whole | (F.col("res") >= F.col("most")), F.lit(True))), ["city_key"], [F.desc("res"), F.asc("listing_id")], "r_hi")
    k = F.floor(0.1 * F.col("n_price"))
    over = hi.where(F.col("r_hi") < k).groupBy("city_key").agg(
        F.avg((F.col("price") <= F.col("e1")).cast("double")).alias("over_share_q1"))
    lo = rank_within(base.where(F.coalesce(whole | (F.col("res") <= F.col("least")), F.lit(True))), ["city_key"], [F.asc("res"), F.asc("listing_id")], "r_lo")
    under = lo.where(F.col("r_lo") < k).groupBy("city_key").agg(
        F.avg((F.col("price") > F.col("e4")).cast("double")).alias("under_share_q5"))
    return round_floats(e.select("city_key").join(over, "city_key", "left").join(under, "city_key", "left"))


@register("sample_listings", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, listing_id, sector, property_type, bedrooms, round(area, 6) AS area, round(price, 6) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY city_key ORDER BY md5('7|' || listing_id)) AS r FROM listings)
WHERE r <= 400"""))
def q_sample_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-1: deterministic sample of up to 400 listings per city."""
    listings, _ = cleaned(spark, sf_dir)
    return round_floats(sample_listings(listings))


_FURN_VALUES = "('unfurnished', 0), ('semi-furnished', 1), ('furnished', 2)"


@register("furnishing_ppsf", O.with_ctes(O.CLEAN_LISTINGS, f"""
, labels(label, ordinal) AS (VALUES {_FURN_VALUES})
SELECT city_key, label, CAST(ordinal AS INTEGER) AS ordinal, count(*) AS n,
       round(quantile_cont(price_per_sqft, 0.5), 6) AS median_ppsf
FROM listings JOIN labels ON furnishing_type = label GROUP BY city_key, label, ordinal"""))
def q_furnishing_ppsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-10: median price per sq.ft. by furnishing, in label order."""
    from estatelens.functions.columns import FURNISHING_CODES
    listings, _ = cleaned(spark, sf_dir)
    df = listings.where(F.col("furnishing_type").isNotNull()).withColumn("label", F.col("furnishing_type"))
    keys = ["city_key", "label"]
    q = multi_quantiles(df, keys, {"price_per_sqft": {"median_ppsf": 0.5}}, count_prefix="_n_")
    order = F.create_map(*[x for lab, code in FURNISHING_CODES.items() for x in (F.lit(lab), F.lit(code))])
    return round_floats(q.select("city_key", "label", order[F.col("label")].cast("int").alias("ordinal"),
                                 F.col("_n_price_per_sqft").alias("n"), "median_ppsf"))


@register("price_validity", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, count(*) FILTER (WHERE price IS NULL OR isnan(price) OR price <= 0 OR isinf(price)) AS bad_prices
FROM std GROUP BY city_key"""))
def q_price_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-13: prices that cannot be modelled in log space (raw feed, per city)."""
    from estatelens.operators.evaluate import validate_prices
    return validate_prices(_std_feed(spark, sf_dir))


@register("society_encoder_table", O.with_ctes(O.CLEAN_LISTINGS, """
, g AS (SELECT city_key, quantile_cont(price_per_sqft, 0.5) AS gm FROM listings GROUP BY city_key)
SELECT l.city_key, society, count(*) AS soc_count,
       round((count(*) * quantile_cont(price_per_sqft, 0.5) + 10.0 * any_value(g.gm)) / (count(*) + 10.0), 6)
         AS society_ppsf
FROM listings l JOIN g USING (city_key) WHERE society IS NOT NULL GROUP BY l.city_key, society"""))
def q_society_encoder_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4 / RPT-2: smoothed building rates learned on all listings."""
    from estatelens.operators.encoders import fit_encoders
    listings, _ = cleaned(spark, sf_dir)
    soc = fit_encoders(listings).society_stats
    return round_floats(soc.select("city_key", "society", "soc_count", "society_ppsf"))
