"""Ingestion of the contract-shaped test feed: plans and oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.operators.contract import ListingContract
from estatelens.operators.ingest import IngestResult, ingest_listings
from estatelens.plans import oracle as O
from estatelens.plans.common import memo, round_floats
from estatelens.plans.registry import register
from estatelens.session import finished
from estatelens.sources.listings import raw_listings

# The contract of the test feed: price in lakh, area text in sq.ft. (ranges
# allowed), size labels, a per-row basis column and three amenity flags with
# -1 meaning "never recorded".
TEST_CONTRACT = ListingContract(
    columns={"price": "price_lakh", "area": "area_text", "bedrooms": "size_label", "bathrooms": "bathroom",
             "property_type": "ptype", "balcony": "balcony_raw"},
    area_unit="sqft", area_basis="superbuiltup", price_unit="lakh", locality_column="locality_raw",
    expected_ppsf_range=(2000.0, 200000.0),
    parse={"area": "numeric_or_range", "bedrooms": "leading_number", "balcony": "balcony_label"},
    required_columns=("bedrooms",),
    area_basis_column="area_type",
    area_basis_labels={"Super built-up  Area": "superbuiltup", "Carpet  Area": "carpet",
                       "Built Up  Area": "builtup"},
    amenity_columns=("lift", "parking", "gym"), amenity_unknown_value=-1,
)


def contract_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third-party shaped feed: raw text columns as a portal delivers them.  Written once: the ingests of a
    query and of an application read it, none of them joins the tables again."""
    return memo(spark, sf_dir, "contract_feed", lambda: finished(spark, lambda: raw_listings(spark, sf_dir).select(
        "listing_id", "city_key", "price_lakh", "area_text", "size_label", "bathroom",
        "locality_raw", "area_type", "lift", "parking", "gym", F.col("property_type").alias("ptype"),
        "society", F.col("balcony").alias("balcony_raw"), "is_resale"), compression="zstd"))


def ingested(spark: SparkSession, sf_dir: str) -> IngestResult:
    return memo(spark, sf_dir, "ingested", lambda: ingest_listings(contract_feed(spark, sf_dir), TEST_CONTRACT))


_NUM = "(CASE WHEN regexp_matches(trim({x}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') " \
       "THEN TRY_CAST(trim({x}) AS DOUBLE) END)"
_RANGE = "'^\\s*([\\d.]+)\\s*-\\s*([\\d.]+)\\s*$'"


def _num(x: str) -> str:
    return _NUM.format(x=x)


INGEST_SQL = O.RAW_LISTINGS + f""",
feed AS (
  SELECT listing_id, city_key, price_lakh, area_text, size_label, bathroom, locality_raw, area_type, lift, parking,
         gym, property_type AS ptype, society, balcony AS balcony_raw, is_resale
  FROM raw_listings
),
mapped0 AS (
  SELECT listing_id, city_key, area_type, lift, parking, gym, society, is_resale,
         CAST(price_lakh AS DOUBLE) * 1e-2 AS price,
         coalesce({_num('area_text')},
                  ({_num(f"regexp_extract(area_text, {_RANGE}, 1)")} + {_num(f"regexp_extract(area_text, {_RANGE}, 2)")}) / 2.0)
           * 1.0 AS area,
         TRY_CAST(nullif(regexp_extract(size_label, '^\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS bedrooms,
         bathroom AS bathrooms, ptype AS property_type,
         CASE WHEN {_num('balcony_raw')} >= 3 THEN '3+'
              WHEN {_num('balcony_raw')} IS NOT NULL THEN CAST(CAST(trunc({_num('balcony_raw')}) AS INTEGER) AS VARCHAR)
              WHEN trim(balcony_raw) IN ('0', '1', '2', '3', '3+') THEN trim(balcony_raw) END AS balcony,
         lower(regexp_replace(regexp_replace(locality_raw, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS sector,
         area_text AS _raw_area, size_label AS _raw_bedrooms, balcony_raw AS _raw_balcony, locality_raw AS _raw_locality
  FROM feed
),
mapped AS (
  SELECT *, CASE WHEN area = 0 THEN NULL ELSE price * 1e7 / area END AS price_per_sqft,
         CASE trim(area_type) WHEN 'Super built-up  Area' THEN 'superbuiltup' WHEN 'Carpet  Area' THEN 'carpet'
                              WHEN 'Built Up  Area' THEN 'builtup' END AS _basis
  FROM mapped0
),
tagged_i AS (
  SELECT *, CASE WHEN NOT coalesce(_basis = 'superbuiltup', false) THEN 3
                 WHEN NOT coalesce(price_per_sqft BETWEEN 2000.0 AND 200000.0, false) THEN 4 END AS _drop
  FROM mapped
),
gate AS (
  SELECT city_key, count(*) FILTER (WHERE price IS NOT NULL AND price <= 0) AS non_positive_prices,
         quantile_cont(area, 0.5) AS median_area, quantile_cont(price_per_sqft, 0.5) AS median_ppsf
  FROM tagged_i WHERE _drop IS NULL OR _drop = 4 GROUP BY city_key
),
gate_ok AS (
  SELECT *, non_positive_prices = 0 AND coalesce(median_area BETWEEN 100 AND 20000, false)
            AND coalesce(median_ppsf BETWEEN 1000 AND 100000, false)
            AND coalesce(median_ppsf BETWEEN 2000 AND 200000, false) AS passed
  FROM gate
),
surv AS (
  SELECT t.*, CASE WHEN lift_u IS NULL AND parking_u IS NULL AND gym_u IS NULL THEN NULL
                   ELSE coalesce(CAST(lift_u = 1 AS DOUBLE), 0.0) + coalesce(CAST(parking_u = 1 AS DOUBLE), 0.0)
                        + coalesce(CAST(gym_u = 1 AS DOUBLE), 0.0) END AS amenity_count
  FROM (SELECT *, CASE WHEN CAST(lift AS DOUBLE) = -1 THEN NULL ELSE CAST(lift AS DOUBLE) END AS lift_u,
               CASE WHEN CAST(parking AS DOUBLE) = -1 THEN NULL ELSE CAST(parking AS DOUBLE) END AS parking_u,
               CASE WHEN CAST(gym AS DOUBLE) = -1 THEN NULL ELSE CAST(gym AS DOUBLE) END AS gym_u
        FROM tagged_i WHERE _drop IS NULL AND city_key IN (SELECT city_key FROM gate_ok WHERE passed)) t
),
dedup_i AS (
  SELECT min(listing_id) AS listing_id, city_key, area_type, lift, parking, gym, society, is_resale, price, area,
         bedrooms, bathrooms, property_type, balcony, sector, price_per_sqft, amenity_count, count(*) AS _copies
  FROM surv
  GROUP BY city_key, area_type, lift, parking, gym, society, is_resale, price, area, bedrooms, bathrooms,
           property_type, balcony, sector, price_per_sqft, amenity_count
),
staged0 AS (
  SELECT *, CASE WHEN price IS NULL THEN 7 WHEN area IS NULL OR bedrooms IS NULL THEN 8 END AS _drop FROM dedup_i
),
bounds_i AS (
  SELECT city_key, quantile_cont(price_per_sqft, 0.005) AS plo, quantile_cont(price_per_sqft, 0.995) AS phi,
         quantile_cont(area, 0.005) AS alo, quantile_cont(area, 0.995) AS ahi
  FROM staged0 WHERE _drop IS NULL GROUP BY city_key
),
staged AS (
  SELECT s.* EXCLUDE (_drop),
         coalesce(s._drop, CASE WHEN NOT coalesce(price_per_sqft BETWEEN plo AND phi AND area BETWEEN alo AND ahi, false)
                                THEN 9 END) AS _drop
  FROM staged0 s LEFT JOIN bounds_i USING (city_key)
),
ingested AS (
  SELECT * EXCLUDE (_drop, _copies), 'superbuiltup' AS area_basis FROM staged WHERE _drop IS NULL
)"""


@register("ingest_listings", O.with_ctes(INGEST_SQL, """
SELECT listing_id, city_key, area_type, lift, parking, gym, society, is_resale, round(price, 6) AS price,
       round(area, 6) AS area, round(bedrooms, 6) AS bedrooms, bathrooms, property_type, balcony, sector,
       round(price_per_sqft, 6) AS price_per_sqft, round(amenity_count, 6) AS amenity_count, area_basis
FROM ingested"""))
def q_ingest_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-2: contract-driven ingest of every city (MAP-2..6, FN-1..6,
    FLT-1..6, DRV-1, DQ-5..9)."""
    return round_floats(ingested(spark, sf_dir).listings)


@register("ingest_gate_report", O.with_ctes(INGEST_SQL, """
SELECT city_key, non_positive_prices, round(median_area, 6) AS median_area, round(median_ppsf, 6) AS median_ppsf,
       passed, CASE WHEN non_positive_prices > 0 THEN 'price_sign'
                    WHEN NOT coalesce(median_area BETWEEN 100 AND 20000, false) THEN 'area_unit'
                    WHEN NOT coalesce(median_ppsf BETWEEN 1000 AND 100000, false) THEN 'price_unit'
                    WHEN NOT passed THEN 'city_range' END AS reason
FROM gate_ok"""))
def q_ingest_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-5..9: per-city plausibility gate on the declared-basis rows."""
    g = ingested(spark, sf_dir).gate_report
    return round_floats(g.select("city_key", "non_positive_prices", "median_area", "median_ppsf", "passed", "reason"))


@register("ingest_step_log", O.with_ctes(INGEST_SQL, """
, a AS (SELECT city_key, count(*) AS n_read, count(*) FILTER (WHERE _drop = 3) AS n_basis,
               count(*) FILTER (WHERE _drop = 4) AS n_band FROM tagged_i GROUP BY city_key),
b AS (SELECT city_key, CAST(sum(_copies) AS BIGINT) AS n_pre, count(*) AS n_dedup,
             count(*) FILTER (WHERE _drop = 7) AS n_unpriced, count(*) FILTER (WHERE _drop = 8) AS n_required,
             count(*) FILTER (WHERE _drop = 9) AS n_trim FROM staged GROUP BY city_key),
pc AS (SELECT a.*, b.* EXCLUDE (city_key), g.passed FROM a JOIN b USING (city_key) JOIN gate_ok g USING (city_key)),
st AS (
  SELECT city_key, 1 AS step_no, 'read' AS step, 0 AS removed, 0 AS before FROM pc
  UNION ALL SELECT city_key, 2, 'area_basis', n_basis, 0 FROM pc
  UNION ALL SELECT city_key, 3, 'gate',
                   CASE WHEN passed THEN 0 ELSE n_read - n_basis - n_band END, n_basis FROM pc
  UNION ALL SELECT city_key, 4, 'ppsf_band', n_band, n_basis FROM pc
  UNION ALL SELECT city_key, 5, 'amenities', 0, n_basis + n_band FROM pc
  UNION ALL SELECT city_key, 6, 'copies', n_pre - n_dedup, n_basis + n_band FROM pc
  UNION ALL SELECT city_key, 7, 'unpriced', n_unpriced, n_basis + n_band + n_pre - n_dedup FROM pc
  UNION ALL SELECT city_key, 8, 'required', n_required,
                   n_basis + n_band + n_pre - n_dedup + n_unpriced FROM pc
  UNION ALL SELECT city_key, 9, 'outliers', n_trim,
                   n_basis + n_band + n_pre - n_dedup + n_unpriced + n_required FROM pc
)
SELECT st.city_key, CAST(step_no AS INTEGER) AS step_no, step, CAST(n_read - before AS BIGINT) AS rows_in,
       CAST(removed AS BIGINT) AS rows_removed, CAST(n_read - before - removed AS BIGINT) AS rows_out
FROM st JOIN pc USING (city_key)"""))
def q_ingest_step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-1 for the ingest pipeline."""
    return ingested(spark, sf_dir).step_log


@register("ingest_parse_log", O.with_ctes(INGEST_SQL, """
SELECT city_key, entry, value FROM (
  SELECT city_key,
         count(*) FILTER (WHERE area IS NULL AND _raw_area IS NOT NULL) AS "parse_loss:area",
         count(*) FILTER (WHERE bedrooms IS NULL AND _raw_bedrooms IS NOT NULL) AS "parse_loss:bedrooms",
         count(*) FILTER (WHERE balcony IS NULL AND _raw_balcony IS NOT NULL) AS "parse_loss:balcony",
         count(DISTINCT _raw_locality) - count(DISTINCT sector) AS locality_merged,
         count(DISTINCT sector) AS localities
  FROM mapped GROUP BY city_key
) UNPIVOT (value FOR entry IN ("parse_loss:area", "parse_loss:bedrooms", "parse_loss:balcony", locality_merged,
                               localities))"""))
def q_ingest_parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-2 / LOG-3: values each parser could not read, locality spellings
    folded by normalisation."""
    log = ingested(spark, sf_dir).feed_log
    return log.where(F.col("entry").startswith("parse_loss:") | F.col("entry").isin("locality_merged", "localities")) \
              .select("city_key", "entry", "value")


@register("ingest_blank_counts", O.with_ctes(INGEST_SQL, """
SELECT city_key, unnest(['blank:area', 'blank:bedrooms']) AS entry,
       unnest([count(*) FILTER (WHERE area IS NULL), count(*) FILTER (WHERE bedrooms IS NULL)]) AS value
FROM staged0 WHERE _drop IS DISTINCT FROM 7 GROUP BY city_key"""))
def q_ingest_blank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6: blanks of every required column among the rows that have a price, before they are dropped."""
    return ingested(spark, sf_dir).feed_log.where(F.col("entry").startswith("blank:")).select("city_key", "entry", "value")


@register("area_basis_report", O.with_ctes(INGEST_SQL, """
SELECT city_key, CASE WHEN count(DISTINCT area_basis) = 1 THEN min(area_basis) END AS area_basis,
       count(DISTINCT area_basis) > 1 AS mixed
FROM ingested GROUP BY city_key"""))
def q_area_basis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-11 / MAP-6: the single area basis recorded on each city's rows."""
    from estatelens.operators.ingest import area_basis_per_city
    return area_basis_per_city(ingested(spark, sf_dir).listings)


@register("amenity_unknown_share", O.with_ctes(INGEST_SQL, """
SELECT city_key, count(*) FILTER (WHERE amenity_count IS NULL) AS unknown_rows, count(*) AS rows,
       round(100.0 * count(*) FILTER (WHERE amenity_count IS NULL) / count(*), 6) AS unknown_pct
FROM surv GROUP BY city_key"""))
def q_amenity_unknown_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DRV-1 log: rows whose amenities were never recorded (left blank, not
    counted as zero), on the rows after the price band, before copies are dropped."""
    res = ingested(spark, sf_dir)
    log = res.feed_log.where(F.col("entry") == "amenity_unknown").select("city_key", F.col("value").alias("unknown_rows"))
    rows = res.step_log.where(F.col("step_no") == 6).select("city_key", F.col("rows_in").alias("rows"))
    return round_floats(log.join(rows, "city_key").withColumn(
        "unknown_pct", 100.0 * F.col("unknown_rows") / F.col("rows")))
