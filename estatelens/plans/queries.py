"""Cleaning, encoders and out-of-fold rule evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.operators.evaluate import regression_metrics
from estatelens.operators.quantiles import multi_quantiles
from estatelens.plans import oracle as O
from estatelens.plans.common import cleaned, oof_rules, round_floats
from estatelens.plans.registry import register


@register("clean_listings", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT listing_id, city_key, property_type, society, sector, round(price, 6) AS price,
       round(price_per_sqft, 6) AS price_per_sqft, round(area, 6) AS area, bedrooms, bathrooms, balcony,
       age_possession, furnishing_type, luxury_score
FROM listings"""))
def q_clean_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-1: cleaned listings of every city."""
    listings, _ = cleaned(spark, sf_dir)
    return round_floats(listings)


@register("cleaning_step_log", O.with_ctes(O.CLEAN_LISTINGS, """
, per_city AS (
  SELECT city_key, CAST(sum(_copies) AS BIGINT) AS n_raw, count(*) AS n_dedup,
         count(*) FILTER (WHERE _drop = 4) AS n_unpriced, count(*) FILTER (WHERE _drop = 5) AS n_trimmed
  FROM tagged GROUP BY city_key
),
steps AS (
  SELECT city_key, 1 AS step_no, 'rename' AS step, n_raw AS rows_in, 0 AS rows_removed FROM per_city
  UNION ALL SELECT city_key, 2, 'copies', n_raw, n_raw - n_dedup FROM per_city
  UNION ALL SELECT city_key, 3, 'labels', n_dedup, 0 FROM per_city
  UNION ALL SELECT city_key, 4, 'unpriced', n_dedup, n_unpriced FROM per_city
  UNION ALL SELECT city_key, 5, 'outliers', n_dedup - n_unpriced, n_trimmed
  FROM per_city
)
SELECT city_key, CAST(step_no AS INTEGER) AS step_no, step, CAST(rows_in AS BIGINT) AS rows_in,
       CAST(rows_removed AS BIGINT) AS rows_removed, CAST(rows_in - rows_removed AS BIGINT) AS rows_out
FROM steps"""))
def q_cleaning_step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-1: rows in / removed / out per city and cleaning step."""
    _, log = cleaned(spark, sf_dir)
    return log


@register("sector_summary", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, sector AS name, count(*) AS n, round(quantile_cont(price, 0.5), 6) AS median_price_cr,
       round(quantile_cont(price_per_sqft, 0.5), 6) AS median_ppsf
FROM listings WHERE sector IS NOT NULL GROUP BY city_key, sector HAVING count(*) >= 30"""))
def q_sector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10 + FLT-7: localities with at least 30 listings, median price and
    median price per sq.ft., dearest first."""
    listings, _ = cleaned(spark, sf_dir)
    return round_floats(sector_summary(listings))


def sector_summary(listings: DataFrame, min_support: int = 30) -> DataFrame:
    df = listings.where(F.col("sector").isNotNull())
    q = multi_quantiles(df, ["city_key", "sector"], {"price": {"median_price_cr": 0.5},
                                                     "price_per_sqft": {"median_ppsf": 0.5}},
                        count_prefix="_n_")
    return (q.where(F.col("_n_price") >= min_support)
             .select("city_key", F.col("sector").alias("name"), F.col("_n_price").alias("n"),
                     "median_price_cr", "median_ppsf")
             .orderBy("city_key", F.desc("median_price_cr"), "name"))


@register("oof_rule_metrics", O.with_ctes(O.OOF_RULES, O.rule_metrics_body()))
def q_oof_rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (CV-1 + AGG-5 + JOIN-1 + JOIN-3 + AGG-6): fold-safe
    locality-median and city-median rules, pooled out-of-fold metrics."""
    return round_floats(regression_metrics(oof_rules(spark, sf_dir), ["baseline_sector", "baseline_global"]))


@register("public_city_listing_counts", O.with_ctes(O.CLEAN_LISTINGS, """
SELECT city_key, count(*) AS n FROM listings
WHERE city_key IN (SELECT lower(r_name) FROM region WHERE r_regionkey <> 4) GROUP BY city_key"""))
def q_public_city_listing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6 / SRC-7: listings of the cities the registry marks public."""
    from estatelens.sources.derived import cities_from_regions
    from estatelens.sources.feeds import public_listings
    listings, _ = cleaned(spark, sf_dir)
    return public_listings(listings, cities_from_regions(spark, sf_dir)).groupBy("city_key").agg(
        F.count(F.lit(1)).alias("n"))
