"""Rate-table pricing queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.operators.rates import explain_lines, price_from_rates, rate_catalogue, rate_table_checks
from estatelens.plans import oracle as O
from estatelens.plans.common import cleaned, memo, round_floats
from estatelens.plans.registry import register
from estatelens.session import materialize
from estatelens.sources.derived import RATES_AS_OF, RATES_LAST_UPDATED, derived_rates, rate_queries


def rates_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(spark, sf_dir, "rates", lambda: materialize(derived_rates(cleaned(spark, sf_dir)[0])))


RATES_SQL = O.CLEAN_LISTINGS + """,
rq AS (
  SELECT sector AS zone, property_type,
         quantile_cont(price_per_sqft, 0.25) AS q25, quantile_cont(price_per_sqft, 0.75) AS q75,
         quantile_cont(price_per_sqft, 0.10) AS q10, quantile_cont(price_per_sqft, 0.90) AS q90
  FROM listings WHERE sector IS NOT NULL GROUP BY sector, property_type
),
rates AS (
  SELECT zone, property_type, q25 AS rate_low_per_sqft, q75 AS rate_high_per_sqft, 'listing quartiles' AS source,
         '2026-03-15' AS source_date FROM rq
  UNION ALL
  SELECT zone, property_type, q10, q90, 'listing deciles', '2026-02-28' FROM rq
),
queries AS (
  SELECT o_orderkey AS query_id,
         CASE WHEN o_orderkey % 41 = 0 THEN 'unknown zone' ELSE lower(n_name) END AS zone,
         CASE WHEN o_orderstatus = 'F' THEN 'house' ELSE 'flat' END AS property_type,
         CASE WHEN o_orderkey % 53 = 0 THEN 0.0 ELSE round(o_totalprice / 100, 0) END AS area_sqft,
         CASE WHEN o_orderkey % 37 = 0 THEN 'Near Amravati, ' || n_name ELSE n_name END AS locality
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
items AS (
  SELECT q.query_id, q.zone, q.property_type, r.source, r.source_date, r.rate_low_per_sqft, r.rate_high_per_sqft,
         r.rate_low_per_sqft * q.area_sqft / 1e7 AS low_cr, r.rate_high_per_sqft * q.area_sqft / 1e7 AS high_cr
  FROM queries q JOIN rates r USING (zone, property_type) WHERE q.area_sqft > 0
),
span AS (SELECT query_id, min(low_cr) AS low_cr, max(high_cr) AS high_cr, count(*) AS n_sources
         FROM items GROUP BY query_id)"""

_AGE = f"(DATE '{RATES_AS_OF}' - DATE '{RATES_LAST_UPDATED}')"


@register("rate_estimates", O.with_ctes(RATES_SQL, f"""
SELECT q.query_id, q.zone, q.property_type, round(q.area_sqft, 6) AS area_sqft,
       CASE WHEN NOT q.area_sqft > 0 THEN 'bad_area' WHEN s.n_sources IS NULL THEN 'no_rate' ELSE 'ok' END AS status,
       round(s.low_cr, 6) AS low_cr, round(s.high_cr, 6) AS high_cr, coalesce(s.n_sources, 0) AS n_sources,
       '{RATES_LAST_UPDATED}' AS table_last_updated, {_AGE} > 183 AS stale, CAST({_AGE} AS INTEGER) AS age_days,
       coalesce(regexp_matches(lower(q.locality), 'amravati|maharashtra|vidarbha'), false) AS contamination
FROM queries q LEFT JOIN span s USING (query_id)"""))
def q_rate_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF-1 + JOIN-5 + AGG-11 + FN-19/20: every order priced from the rate
    table of its zone, with staleness and contamination flags."""
    est, _ = price_from_rates(rate_queries(spark, sf_dir), rates_for(spark, sf_dir), RATES_LAST_UPDATED, RATES_AS_OF)
    return round_floats(est)


@register("rate_line_items", O.with_ctes(RATES_SQL, """
SELECT query_id, zone, property_type, source, source_date, round(rate_low_per_sqft, 6) AS rate_low_per_sqft,
       round(rate_high_per_sqft, 6) AS rate_high_per_sqft, round(low_cr, 6) AS low_cr, round(high_cr, 6) AS high_cr
FROM items"""))
def q_rate_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF-1 line items: one row per query and matching rate source."""
    _, items = price_from_rates(rate_queries(spark, sf_dir), rates_for(spark, sf_dir), RATES_LAST_UPDATED,
                                RATES_AS_OF)
    return round_floats(items)


@register("rate_catalogue", O.with_ctes(RATES_SQL, """
SELECT zone, property_type, count(*) AS sources FROM rates GROUP BY zone, property_type"""))
def q_rate_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF-2 / RPT-6: the (zone, property type) pairs on file."""
    return rate_catalogue(rates_for(spark, sf_dir))


@register("rate_table_checks", O.with_ctes(RATES_SQL, """
SELECT count(*) AS rows, count(*) FILTER (WHERE rate_low_per_sqft > rate_high_per_sqft) AS inverted_rows,
       true AS dated, count(*) > 0 AND count(*) FILTER (WHERE rate_low_per_sqft > rate_high_per_sqft) = 0 AS valid
FROM rates"""))
def q_rate_table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5 / DQ-12: the rate table is dated, non-empty and low <= high."""
    return rate_table_checks(rates_for(spark, sf_dir), RATES_LAST_UPDATED)


@register("rate_explain", O.with_ctes(RATES_SQL, f"""
, est AS (SELECT q.query_id, s.low_cr, s.high_cr,
                 coalesce(regexp_matches(lower(q.locality), 'amravati|maharashtra|vidarbha'), false) AS contamination
          FROM queries q JOIN span s USING (query_id)),
none AS (SELECT CAST(NULL AS VARCHAR) AS s, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS INTEGER) AS i)
SELECT *, 'from rates on file, not a prediction' AS label FROM (
  SELECT query_id, 'rate' AS part, source, CAST(source_date AS VARCHAR) AS source_date, round(rate_low_per_sqft, 6) AS rate_low_per_sqft,
         round(rate_high_per_sqft, 6) AS rate_high_per_sqft, round(low_cr, 6) AS low_cr, round(high_cr, 6) AS high_cr, i AS age_days
  FROM items, none
  UNION ALL SELECT query_id, 'range', s, s, d, d, round(low_cr, 6), round(high_cr, 6), i FROM est, none
  UNION ALL SELECT query_id, 'stale', s, '{RATES_LAST_UPDATED}', d, d, d, d, CAST({_AGE} AS INTEGER) FROM est, none WHERE {_AGE} > 183
  UNION ALL SELECT query_id, 'locality', s, s, d, d, d, d, i FROM est, none WHERE contamination)"""))
def q_rate_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22: the parts of every priced order's range."""
    est, items = price_from_rates(rate_queries(spark, sf_dir), rates_for(spark, sf_dir), RATES_LAST_UPDATED,
                                  RATES_AS_OF)
    # three of the four parts read the estimates: they are priced once
    return round_floats(explain_lines(materialize(est), items))


@register("rate_contamination_counts", O.with_ctes(RATES_SQL, """
SELECT zone, count(*) FILTER (WHERE coalesce(regexp_matches(lower(locality), 'amravati|maharashtra|vidarbha'), false))
         AS flagged, count(*) AS queries
FROM queries GROUP BY zone"""))
def q_rate_contamination_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-19 / DQ-17: per zone, queries whose locality names the similarly
    named city in Maharashtra (warned, never dropped)."""
    from estatelens.functions.columns import contamination_flag
    q = rate_queries(spark, sf_dir)
    return q.groupBy("zone").agg(F.count_if(contamination_flag(F.col("locality"))).alias("flagged"),
                                 F.count(F.lit(1)).alias("queries"))
