"""Queries that make the refusals and warnings occur that no feed of the other queries has, and the tables of label codes
and log prices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions import columns as fn
from estatelens.operators.evaluate import regression_metrics
from estatelens.operators.features import build_features
from estatelens.operators.ingest import ingest_listings
from estatelens.operators.reports import histogram
from estatelens.plans import oracle as O
from estatelens.plans.check_queries import BINS, _histogram_sql
from estatelens.plans.common import cleaned, memo, oof_rules, round_floats
from estatelens.plans.ingest_queries import INGEST_SQL, TEST_CONTRACT, contract_feed, ingested
from estatelens.plans.registry import register
from estatelens.sources.listings import hash_bucket

FLAT_CITY = "africa"          # all its prices are made equal
REFUSED = ("asia", "europe")  # cities whose stored basis is another
NEGATIVE = ("africa", "america")
RENAMED = {"asia": "amaravathi"}


@register("log_price_histogram", O.with_ctes(O.CLEAN_LISTINGS, ", l AS (SELECT city_key, ln(price) AS log_price FROM listings)" + _histogram_sql("l", "log_price")))
def q_log_price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDA-5 / FN-15: the models' target, log price, in 48 bins."""
    return round_floats(histogram(cleaned(spark, sf_dir)[0].withColumn("log_price", fn.log_target("price")), "log_price", BINS))


_CODES = {"furnishing": ("furnishing_type", fn.FURNISHING_CODES), "age": ("age_possession", fn.AGE_CODES), "balcony": ("balcony", fn.BALCONY_CODES)}


@register("label_codes", O.with_ctes(O.CLEAN_LISTINGS, "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT city_key, '{kind}' AS encoding, {column} AS label, CASE {column} " + " ".join(f"WHEN '{x}' THEN {float(c)}" for x, c in codes.items())
    + f" END::DOUBLE AS code, count(*) AS n FROM listings WHERE {column} IS NOT NULL GROUP BY city_key, {column}" for kind, (column, codes) in _CODES.items()) + ")"))
def q_label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-2 / FN-10..12: the code that the models read for every label on file, by city, and its listings."""
    listings, _ = cleaned(spark, sf_dir)
    code = {"furnishing": fn.furnishing_code, "age": fn.age_code, "balcony": fn.balcony_code}
    out = None
    for kind, (column, _) in _CODES.items():
        part = listings.where(F.col(column).isNotNull()).groupBy("city_key", F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        part = part.select("city_key", F.lit(kind).alias("encoding"), "label", code[kind]("label").alias("code"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("ingest_flag_features", O.with_ctes(INGEST_SQL, """
SELECT listing_id, city_key, round(coalesce(amenity_count, -1.0), 6) AS amenity_count, coalesce(CAST(is_resale AS DOUBLE), -1.0) AS is_resale FROM ingested"""))
def q_ingest_flag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-4 / FN-14: the two features that only third-party feeds have."""
    return round_floats(build_features(ingested(spark, sf_dir).listings, ["amenity_count", "is_resale"], keep=["listing_id", "city_key"]))


@register("flat_price_metrics", O.with_ctes(O.OOF_RULES + f""",
flat AS (SELECT * REPLACE (CASE WHEN city_key = '{FLAT_CITY}' THEN 1.0 ELSE price END AS price) FROM oof)""", O.rule_metrics_body("flat")))
def q_flat_price_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-14: a city whose prices are all equal has no R^2."""
    flat = oof_rules(spark, sf_dir).withColumn("price", F.when(F.col("city_key") == FLAT_CITY, F.lit(1.0)).otherwise(F.col("price")))
    return round_floats(regression_metrics(flat, ["baseline_sector", "baseline_global"]))


_REFUSALS_SQL = INGEST_SQL + """,
minus AS (SELECT city_key, count(*) AS n FROM tagged_i
          WHERE _basis = 'superbuiltup' AND price IS NOT NULL AND CAST('0x' || substr(listing_id, 1, 8) AS BIGINT) % 100 = 0 GROUP BY city_key)"""


@register("ingest_other_refusals", O.with_ctes(_REFUSALS_SQL, f"""
SELECT 'stored_basis' AS variant, city_key, CASE WHEN city_key IN {REFUSED} THEN 'stored_basis' WHEN NOT passed THEN 'other' END AS reason,
       CASE WHEN city_key IN {REFUSED} THEN 'carpet' END AS stored_basis, non_positive_prices FROM gate_ok
UNION ALL
SELECT 'negative_prices', city_key, CASE WHEN city_key IN {NEGATIVE} AND n > 0 THEN 'price_sign' WHEN NOT passed THEN 'other' END, NULL,
       CASE WHEN city_key IN {NEGATIVE} THEN coalesce(n, 0) ELSE non_positive_prices END
FROM gate_ok LEFT JOIN minus USING (city_key)"""))
def q_ingest_other_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-10: cities whose stored listings have another basis; DQ-5: cities with prices below zero."""
    feed = contract_feed(spark, sf_dir)
    stored = feed.select("city_key").distinct().select("city_key", F.when(F.col("city_key").isin(*REFUSED), "carpet").otherwise(TEST_CONTRACT.area_basis).alias("area_basis"))
    basis = ingest_listings(feed, TEST_CONTRACT, stored).gate_report
    below = F.col("city_key").isin(*NEGATIVE) & (hash_bucket(F.col("listing_id")) % 100 == 0)
    sign = ingest_listings(feed.withColumn("price_lakh", F.when(below, -F.col("price_lakh")).otherwise(F.col("price_lakh"))), TEST_CONTRACT).gate_report
    # a refusal of another kind is none of this query's
    reason = lambda *own: F.when(F.col("reason").isin(*own), F.col("reason")).when(F.col("reason").isNotNull(), "other").alias("reason")
    a = basis.select(F.lit("stored_basis").alias("variant"), "city_key", reason("stored_basis"),
                     F.when(F.col("stored_basis") != TEST_CONTRACT.area_basis, F.col("stored_basis")).alias("stored_basis"), "non_positive_prices")
    b = sign.select(F.lit("negative_prices").alias("variant"), "city_key", reason("price_sign"), F.lit(None).cast("string").alias("stored_basis"), "non_positive_prices")
    return a.unionByName(b)


@register("feed_warnings", O.with_ctes(INGEST_SQL, """
SELECT CASE city_key WHEN 'asia' THEN 'amaravathi' ELSE city_key END AS city_key, 'caveat:unknown_area_basis' AS entry, NULL::BIGINT AS value, NULL AS detail
FROM (SELECT DISTINCT city_key FROM mapped)
UNION ALL
SELECT 'amaravathi', 'warning:other_state', count(*), (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT sector || ', maharashtra' AS s FROM mapped
       WHERE city_key = 'asia' ORDER BY s LIMIT 3)) FROM (SELECT DISTINCT sector FROM mapped WHERE city_key = 'asia') HAVING count(*) > 0"""))
def q_feed_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-17: localities of another state under a key that is easily taken for its city's; DQ-18: a feed of unknown basis."""
    feed = contract_feed(spark, sf_dir)
    own = F.col("city_key").isin(*RENAMED)
    feed = feed.withColumn("locality_raw", F.when(own, F.concat(F.trim(F.regexp_replace("locality_raw", r"\s+", " ")), F.lit(", Maharashtra"))).otherwise(F.col("locality_raw")))
    feed = feed.replace(RENAMED, subset=["city_key"])
    contract = replace(TEST_CONTRACT, area_basis="unknown", area_basis_column=None, area_basis_labels={}, expected_ppsf_range=None)
    log = memo(spark, sf_dir, "warned", lambda: ingest_listings(feed, contract)).feed_log
    return log.where(F.col("entry").startswith("warning:") | F.col("entry").startswith("caveat:")).select("city_key", "entry", "value", "detail")
