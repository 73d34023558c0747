"""DuckDB SQL for the oracle side of every registered query.

The driver registers the parquet tables as views (``lineitem``, ``orders``,
...); each query here starts from them.  The listing views of
``estatelens.sources.listings`` and the cleaning pipeline are written once as
common table expressions and prefixed to every query that needs them.
Floats are rounded to 6 places on both sides.
"""

from __future__ import annotations

_JOINED = """
joined AS (
  SELECT l.*, o.o_orderstatus, o.o_orderpriority, p.p_size, s.s_name, n.n_nationkey, n.n_name, r.r_name,
         md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT),
                       strftime(l_shipdate, '%Y-%m-%d'))) AS listing_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
jh AS (SELECT *, CAST('0x' || substr(listing_id, 1, 8) AS BIGINT) AS _h FROM joined)"""

_AGE = """CASE WHEN _h % 11 = 0 THEN 'Undefined'
            WHEN o_orderpriority = '1-URGENT' THEN 'Under Construction'
            WHEN o_orderpriority = '2-HIGH' THEN 'New Property'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'Relatively New'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Moderately Old'
            WHEN o_orderpriority = '5-LOW' THEN 'Old Property' END"""

_COMMON = {
    "city_key": "lower(r_name)",
    "sector": "lower(n_name)",
    "society": "CASE WHEN _h % 13 = 0 THEN NULL ELSE s_name END",
    "property_type": "CASE WHEN l_linestatus = 'F' THEN 'house' ELSE 'flat' END",
    "area": "l_quantity * 100.0",
    "bedrooms": "CAST(p_size % 5 + 1 AS INTEGER)",
    "bathrooms": "CAST(l_linenumber AS INTEGER)",
    "balcony": "CASE (_h // 7) % 6 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '3+' END",
    "furnishing_type": "CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS INTEGER)",
    "age_possession": _AGE,
    "luxury_score": "CAST(p_size * 3 AS INTEGER)",
    "lift": "CAST(CASE WHEN l_discount = 0 THEN -1 ELSE l_partkey % 2 END AS INTEGER)",
    "parking": "CAST(CASE WHEN l_discount = 0 THEN -1 ELSE l_suppkey % 2 END AS INTEGER)",
    "gym": "CAST(CASE WHEN l_discount = 0 THEN -1 ELSE l_linenumber % 2 END AS INTEGER)",
    "is_resale": "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER)",
    "area_type": """CASE WHEN _h % 17 = 0 THEN NULL WHEN _h % 4 <= 1 THEN 'Super built-up  Area'
                         WHEN _h % 4 = 2 THEN 'Carpet  Area' ELSE 'Built Up  Area' END""",
}

_PRICE = "CASE WHEN _h % 97 = 0 THEN NULL ELSE l_extendedprice / 1e4 END"

RAW_LISTINGS = _JOINED + f""",
raw_base AS (
  SELECT listing_id,
         {_COMMON['city_key']} AS city_key,
         {_COMMON['property_type']} AS property_type,
         {_COMMON['society']} AS society,
         {_COMMON['sector']} AS sector,
         {_PRICE} AS price,
         l_extendedprice * 1e3 / (l_quantity * 100.0) AS price_per_sqft,
         {_COMMON['area']} AS area,
         {_COMMON['bedrooms']} AS bedRoom,
         {_COMMON['bathrooms']} AS bathroom,
         {_COMMON['balcony']} AS balcony,
         {_AGE} AS agePossession,
         {_COMMON['furnishing_type']} AS furnishing_type,
         {_COMMON['luxury_score']} AS luxury_score,
         {_COMMON['lift']} AS lift, {_COMMON['parking']} AS parking, {_COMMON['gym']} AS gym,
         {_COMMON['is_resale']} AS is_resale,
         {_COMMON['area_type']} AS area_type,
         CASE _h % 3 WHEN 0 THEN '  ' || upper(n_name) WHEN 1 THEN n_name || chr(9) || '  ' ELSE lower(n_name) END
           AS locality_raw,
         CASE WHEN _h % 10 = 0 THEN CAST(CAST(l_quantity * 100 AS INTEGER) - 100 AS VARCHAR) || ' - '
                                    || CAST(CAST(l_quantity * 100 AS INTEGER) + 100 AS VARCHAR)
              WHEN _h % 23 = 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'Sq. Meter'
              ELSE CAST(CAST(l_quantity * 100 AS INTEGER) AS VARCHAR) END AS area_text,
         CASE WHEN _h % 19 = 0 THEN 'studio' ELSE CAST({_COMMON['bedrooms']} AS VARCHAR) || ' BHK' END AS size_label,
         ({_PRICE}) * 100 AS price_lakh,
         _h
  FROM jh
),
raw_listings AS (
  SELECT * EXCLUDE (_h) FROM raw_base
  UNION ALL
  SELECT * EXCLUDE (_h) FROM raw_base WHERE _h % 50 = 0
)"""

_PUBLIC_COLS = ("city_key, property_type, society, sector, price, price_per_sqft, area, bedrooms, "
                "bathrooms, balcony, age_possession, furnishing_type, luxury_score")

# PIPE-1 in SQL: rename, dedup (min id per copy group), label, drop unpriced, trim.
CLEAN_LISTINGS = RAW_LISTINGS + f""",
std AS (
  SELECT listing_id, city_key, property_type, society, sector, price, price_per_sqft, area,
         bedRoom AS bedrooms, bathroom AS bathrooms, balcony, agePossession AS age_possession,
         furnishing_type, luxury_score
  FROM raw_listings
),
dedup AS (
  SELECT min(listing_id) AS listing_id, {_PUBLIC_COLS}, count(*) AS _copies
  FROM std GROUP BY {_PUBLIC_COLS}
),
labeled AS (
  SELECT listing_id, city_key, property_type, society, sector, price, price_per_sqft, area, bedrooms, bathrooms,
         CASE WHEN balcony IN ('0', '1', '2', '3', '3+') THEN balcony END AS balcony,
         nullif(age_possession, 'Undefined') AS age_possession,
         CASE furnishing_type WHEN 0 THEN 'unfurnished' WHEN 1 THEN 'semi-furnished' WHEN 2 THEN 'furnished' END
           AS furnishing_type,
         luxury_score, _copies
  FROM dedup
),
bounds AS (
  SELECT city_key,
         quantile_cont(price_per_sqft, 0.005) AS price_per_sqft_lo, quantile_cont(price_per_sqft, 0.995) AS price_per_sqft_hi,
         quantile_cont(area, 0.005) AS area_lo, quantile_cont(area, 0.995) AS area_hi
  FROM labeled WHERE price IS NOT NULL GROUP BY city_key
),
tagged AS (
  SELECT l.*, CASE WHEN price IS NULL THEN 4
                   WHEN NOT coalesce(price_per_sqft BETWEEN price_per_sqft_lo AND price_per_sqft_hi
                                     AND area BETWEEN area_lo AND area_hi, false) THEN 5 END AS _drop
  FROM labeled l LEFT JOIN bounds b USING (city_key)
),
listings AS (
  SELECT listing_id, {_PUBLIC_COLS} FROM tagged WHERE _drop IS NULL
)"""

# Listings with their CV fold (CV-1): md5(listing_id || '|7'), first 32 bits, mod 5.
FOLDED = CLEAN_LISTINGS + """,
folded AS (
  SELECT *, CAST(CAST('0x' || substr(md5(listing_id || '|7'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM listings
)"""

# Fold encoders (AGG-1..5) and the out-of-fold rule predictions (CV-2).
OOF_RULES = FOLDED + """,
train AS (
  SELECT f.city_key, f.sector, f.society, f.price_per_sqft, t.enc_fold
  FROM folded f JOIN (SELECT CAST(range AS INTEGER) AS enc_fold FROM range(5)) t ON f.fold <> t.enc_fold
),
g_enc AS (
  SELECT city_key, enc_fold, quantile_cont(price_per_sqft, 0.5) AS g_median, avg(price_per_sqft) AS g_mean,
         stddev_samp(price_per_sqft) AS g_std, count(price_per_sqft) AS g_count
  FROM train GROUP BY city_key, enc_fold
),
s_enc AS (
  SELECT t.city_key, t.enc_fold, sector, quantile_cont(price_per_sqft, 0.5) AS s_median,
         avg(price_per_sqft) AS s_mean, stddev_samp(price_per_sqft) AS s_std_raw, count(price_per_sqft) AS s_count
  FROM train t WHERE sector IS NOT NULL GROUP BY t.city_key, t.enc_fold, sector
),
soc_enc AS (
  SELECT t.city_key, t.enc_fold, society,
         (count(*) * quantile_cont(price_per_sqft, 0.5) + 10.0 * any_value(g.g_median)) / (count(*) + 10.0) AS society_ppsf,
         count(*) AS soc_count
  FROM train t JOIN g_enc g USING (city_key, enc_fold)
  WHERE society IS NOT NULL GROUP BY t.city_key, t.enc_fold, society
),
oof AS (
  SELECT f.*,
         coalesce(s.s_median, g.g_median) AS sector_ppsf,
         coalesce(s.s_mean, g.g_mean) AS sector_ppsf_mean,
         coalesce(coalesce(s.s_std_raw, g.g_std), g.g_std) AS sector_ppsf_std,
         coalesce(CAST(s.s_count AS DOUBLE), 0.0) AS sector_count,
         coalesce(so.society_ppsf, s.s_median, g.g_median) AS society_ppsf,
         g.g_median AS global_ppsf,
         coalesce(s.s_median, g.g_median) * f.area / 1e7 AS pred_baseline_sector,
         g.g_median * f.area / 1e7 AS pred_baseline_global
  FROM folded f
  JOIN g_enc g ON g.city_key = f.city_key AND g.enc_fold = f.fold
  LEFT JOIN s_enc s ON s.city_key = f.city_key AND s.enc_fold = f.fold AND s.sector = f.sector
  LEFT JOIN soc_enc so ON so.city_key = f.city_key AND so.enc_fold = f.fold AND so.society = f.society
)"""


def with_ctes(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body.strip()


def rule_metrics_body(source: str = "oof") -> str:
    """AGG-6 over the two rule predictors, long format."""
    return f"""
, ybar AS (SELECT city_key, avg(price) AS _ybar FROM {source} GROUP BY city_key),
m AS (
  SELECT o.city_key, count(*) AS n, sum((price - _ybar) * (price - _ybar)) AS sst,
         avg(abs(pred_baseline_sector - price)) AS mae_s, avg(abs(pred_baseline_sector - price) / price) AS mape_s,
         sum((pred_baseline_sector - price) * (pred_baseline_sector - price)) AS sse_s,
         avg(abs(pred_baseline_global - price)) AS mae_g, avg(abs(pred_baseline_global - price) / price) AS mape_g,
         sum((pred_baseline_global - price) * (pred_baseline_global - price)) AS sse_g
  FROM {source} o JOIN ybar USING (city_key) GROUP BY o.city_key
)
SELECT city_key, 'baseline_sector' AS predictor, n, round(mae_s * 100, 6) AS mae_lakh, round(mape_s * 100, 6) AS mape_pct,
       round(CASE WHEN sst > 0 THEN 1 - sse_s / sst END, 6) AS r2 FROM m
UNION ALL
SELECT city_key, 'baseline_global' AS predictor, n, round(mae_g * 100, 6), round(mape_g * 100, 6),
       round(CASE WHEN sst > 0 THEN 1 - sse_g / sst END, 6) FROM m
"""
