"""Tables of trees walked, and estimates assembled from them, with SQL beside (ML-9, ML-10, VAL-1..3, FN-15, FN-17).

The trees are additive: one tree a feature, a leaf for each of its values, fitted in turn to what the trees before leave
of the log price.  Such trees are sums and means, so SQL builds the same table and walks it by a recursive query.  The feed
is the learnable one; one city has trees of the area alone (its rule wins), another has prices that neither can follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.functions import columns as fn
from estatelens.operators.evaluate import regression_metrics, residual_band, serving_decision
from estatelens.operators.quantiles import exact_quantiles
from estatelens.operators.serving import SIGNAL_FEATURES, assemble_estimates
from estatelens.operators.trees import Ensemble, predict
from estatelens.plans import oracle as O
from estatelens.plans.common import memo, round_floats
from estatelens.plans.registry import register
from estatelens.session import finished, materialize
from estatelens.sources.derived import valuation_queries
from estatelens.sources.listings import hash_bucket, signal_listings

FEATURES = ("area", "bedrooms", "sector_ppsf")
AREA_ONLY, NOISY = "america", "europe"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with the locality's median rate; the prices of one city are scattered."""
    def build():
        listings = signal_listings(spark, sf_dir).select("listing_id", "city_key", "society", "sector", "price", "price_per_sqft", "area", "bedrooms")
        scatter = 0.3 + 1.4 * F.pmod(hash_bucket(F.col("listing_id")), F.lit(1009)) / 1009.0
        listings = listings.withColumn("price", F.col("price") * F.when(F.col("city_key") == NOISY, scatter).otherwise(1.0))
        listings = materialize(listings)
        rates = exact_quantiles(listings, ["city_key", "sector"], "price_per_sqft", {"sector_ppsf": 0.5})
        return listings.join(rates, ["city_key", "sector"]).drop("price_per_sqft")
    return memo(spark, sf_dir, "tree_feed", lambda: finished(spark, build))


def additive_trees(listings: DataFrame) -> Ensemble:
    """One tree for each of ``FEATURES``, a chain of its values with a leaf each; values a city are few."""
    models = listings.groupBy("city_key").agg(F.avg(fn.log_target("price")).alias("init"))
    rows = listings.join(models, "city_key").withColumn("_left", fn.log_target("price") - F.col("init"))
    city = Window.partitionBy("city_key")
    out = None
    for t, f in enumerate(FEATURES):
        means = materialize(rows.groupBy("city_key", F.col(f).cast("double").alias("_v")).agg(F.avg("_left").alias("value"), F.count("*").alias("n")))
        rows = rows.join(means.select("city_key", F.col("_v").alias(f), F.col("value").alias("_mean")), ["city_key", f]) \
                   .withColumn("_left", F.col("_left") - F.col("_mean")).drop("_mean")
        at = means.withColumns({"_i": F.row_number().over(city.orderBy("_v")) - 1, "_m": F.count("*").over(city), "_next": F.lead("_v").over(city.orderBy("_v"))})
        leaf = at.select("city_key", (F.col("_m") - 1 + F.col("_i")).alias("node"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("threshold"),
                         F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "value", F.lit(0.0).alias("gain"), "n")
        last = F.col("_i") == F.col("_m") - 2
        inner = at.where("_i < _m - 1").select(
            "city_key", F.col("_i").alias("node"), F.lit(f).alias("feature"), ((F.col("_v") + F.col("_next")) / 2).alias("threshold"),
            (F.col("_m") - 1 + F.col("_i")).cast("long").alias("left"), F.when(last, 2 * F.col("_m") - 2).otherwise(F.col("_i") + 1).cast("long").alias("right"),
            F.lit(0.0).alias("value"), F.lit(0.0).alias("gain"), "n")
        tree = leaf.unionByName(inner).select("city_key", F.lit(-1).alias("fold"), F.lit(t).alias("tree"), F.col("node").cast("long").alias("node"), "feature",
                                              "threshold", "left", "right", "value", "gain", "n")
        out = tree if out is None else out.unionByName(tree)
    kept = materialize(out.where((F.col("city_key") != AREA_ONLY) | (F.col("tree") == 0)))
    return Ensemble(kept, materialize(models.select("city_key", F.lit(-1).alias("fold"), "init", F.lit(1.0).alias("rate"))))


def trees_of(spark: SparkSession, sf_dir: str) -> Ensemble:
    return memo(spark, sf_dir, "additive_trees", lambda: additive_trees(feed(spark, sf_dir)))


def walked(rows: DataFrame, ensemble: Ensemble, keep: list[str]) -> DataFrame:
    feats = rows.select(*keep, F.lit(-1).alias("fold"), *[F.col(f).cast("double").alias(f"_f_{f}") for f in FEATURES])
    named = {f: f"_f_{f}" for f in FEATURES}
    return predict(feats, ensemble, keep, {"_log": named}).select(*keep, F.exp("_log").alias("price_cr"))


_FEED = O._JOINED + f""",
signal0 AS (
  SELECT listing_id, {O._COMMON['city_key']} AS city_key, {O._COMMON['sector']} AS sector, {O._COMMON['society']} AS society,
         {O._COMMON['area']} AS area, {O._COMMON['bedrooms']} AS bedrooms, _h,
         (6000.0 + 500.0 * n_nationkey) * (1 + 0.18 * ({O._COMMON['bedrooms']} - 3)) * (0.8 + 0.4 * (l_suppkey % 100) / 100.0)
           * (1 + ((_h // 5) % 2001 - 1000) / 20000.0) AS price_per_sqft
  FROM jh
),
signal AS (
  SELECT *, area * price_per_sqft / 1e7 * CASE WHEN city_key = '{NOISY}' THEN 0.3 + 1.4 * (_h % 1009) / 1009.0 ELSE 1.0 END AS price FROM signal0
),
rates AS (SELECT city_key, sector, quantile_cont(price_per_sqft, 0.5) AS sector_ppsf FROM signal GROUP BY city_key, sector),
feed AS (SELECT signal.*, sector_ppsf FROM signal JOIN rates USING (city_key, sector)),
models AS (SELECT city_key, avg(ln(price)) AS init FROM feed GROUP BY city_key),
m0 AS (SELECT city_key, area AS v, avg(ln(price) - init) AS value FROM feed JOIN models USING (city_key) GROUP BY city_key, area),
l1 AS (SELECT feed.*, ln(price) - init - m0.value AS rest FROM feed JOIN models USING (city_key) JOIN m0 ON m0.city_key = feed.city_key AND m0.v = feed.area),
m1 AS (SELECT city_key, bedrooms AS v, avg(rest) AS value FROM l1 GROUP BY city_key, bedrooms),
l2 AS (SELECT l1.* EXCLUDE (rest), rest - m1.value AS rest FROM l1 JOIN m1 ON m1.city_key = l1.city_key AND m1.v = l1.bedrooms),
m2 AS (SELECT city_key, sector_ppsf AS v, avg(rest) AS value FROM l2 GROUP BY city_key, sector_ppsf),
chains AS (
  SELECT 0 AS tree, 'area' AS feature, * FROM m0 UNION ALL SELECT 1, 'bedrooms', * FROM m1 WHERE city_key <> '{AREA_ONLY}'
  UNION ALL SELECT 2, 'sector_ppsf', * FROM m2 WHERE city_key <> '{AREA_ONLY}'
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY city_key, tree ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY city_key, tree) AS m,
         lead(v) OVER (PARTITION BY city_key, tree ORDER BY v) AS nxt FROM chains
),
nodes AS (
  SELECT city_key, tree, m - 1 + i AS node, NULL::VARCHAR AS feature, NULL::DOUBLE AS threshold, NULL::BIGINT AS l, NULL::BIGINT AS r, value FROM placed
  UNION ALL
  SELECT city_key, tree, i, feature, (v + nxt) / 2, m - 1 + i, CASE WHEN i = m - 2 THEN 2 * m - 2 ELSE i + 1 END, 0.0 FROM placed WHERE i < m - 1
)"""

_WALK = """,
walk AS (
  SELECT id, asked.city_key, tree, 0::BIGINT AS node, asked.area, asked.bedrooms, asked.sector_ppsf
  FROM asked JOIN (SELECT DISTINCT city_key, tree FROM nodes) USING (city_key)
  UNION ALL
  SELECT w.id, w.city_key, w.tree, CASE WHEN CASE n.feature WHEN 'area' THEN w.area WHEN 'bedrooms' THEN w.bedrooms ELSE w.sector_ppsf END <= n.threshold
                                        THEN n.l ELSE n.r END, w.area, w.bedrooms, w.sector_ppsf
  FROM walk w JOIN nodes n USING (city_key, tree, node) WHERE n.feature IS NOT NULL
),
priced AS (
  SELECT id, city_key, exp(any_value(init) + sum(value)) AS price_cr
  FROM walk JOIN nodes USING (city_key, tree, node) JOIN models USING (city_key) WHERE nodes.feature IS NULL GROUP BY id, city_key
)"""


@register("tree_walk_prices", "WITH RECURSIVE " + _FEED.strip() + ",\nasked AS (SELECT listing_id AS id, city_key, area, bedrooms, sector_ppsf FROM feed)" + _WALK + """
SELECT id AS listing_id, city_key, round(price_cr, 6) AS price_cr FROM priced""")
def q_tree_walk_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-9 / ML-10 / VAL-1: every listing priced by the tables of trees of its city."""
    return round_floats(walked(feed(spark, sf_dir), trees_of(spark, sf_dir), ["listing_id", "city_key"]))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuation queries of localities on file and areas in range, with the locality's rate."""
    rates = feed(spark, sf_dir).select("city_key", "sector", "sector_ppsf").distinct()
    q = valuation_queries(spark, sf_dir).where("area <= 5000").select("query_id", "city_key", "sector", "society", "bedrooms", "area")
    return q.join(rates, ["city_key", "sector"])


@register("tree_estimates", "WITH RECURSIVE " + _FEED.strip() + """,
vq AS (
  SELECT o_orderkey AS query_id, lower(r_name) AS city_key, lower(n_name) AS sector, CAST(o_custkey % 5 + 1 AS INTEGER) AS bedrooms,
         CAST(((o_custkey % 49) + 1) * 100 AS DOUBLE) AS area,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE printf('Supplier#%09d', o_custkey % 100) END AS society
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE o_orderkey % 29 <> 0 AND o_orderkey % 43 <> 0
),
batch AS (SELECT vq.*, sector_ppsf FROM vq JOIN rates USING (city_key, sector)),
asked AS (
  SELECT listing_id AS id, city_key, area, bedrooms, sector_ppsf FROM feed
  UNION ALL SELECT 'q' || query_id, city_key, area, bedrooms, sector_ppsf FROM batch
)""" + _WALK + f""",
fit AS (SELECT f.*, p.price_cr AS pred, sector_ppsf * area / 1e7 AS rule FROM feed f JOIN priced p ON p.id = f.listing_id),
stats AS (
  SELECT city_key, avg(abs(pred - price) / price) * 100 AS model_mape, avg(abs(rule - price) / price) * 100 AS rule_mape,
         quantile_cont(ln(pred) - ln(price), 0.1) AS q10, quantile_cont(ln(pred) - ln(price), 0.9) AS q90,
         quantile_cont(ln(rule) - ln(price), 0.1) AS rule_q10, quantile_cont(ln(rule) - ln(price), 0.9) AS rule_q90
  FROM fit GROUP BY city_key
),
e AS (
  SELECT b.query_id, b.city_key, b.society, p.price_cr, b.sector_ppsf * b.area / 1e7 AS rule, s.*  EXCLUDE (city_key),
         CASE WHEN NOT least(model_mape, rule_mape) < 30 THEN 'not_served' WHEN model_mape < rule_mape THEN 'model' ELSE 'baseline' END AS served,
         EXISTS (SELECT 1 FROM feed f WHERE f.city_key = b.city_key AND f.society = b.society) AS known
  FROM batch b JOIN priced p ON p.id = 'q' || b.query_id JOIN stats s ON s.city_key = b.city_key
)
SELECT query_id, city_key, round(price_cr, 6) AS price_cr, round(price_cr * exp(-q90), 6) AS lo_cr, round(price_cr * exp(-q10), 6) AS hi_cr,
       round(rule, 6) AS baseline_price_cr, round(rule * exp(-rule_q90), 6) AS baseline_lo_cr, round(rule * exp(-rule_q10), 6) AS baseline_hi_cr,
       served AS served_by, CASE served WHEN 'not_served' THEN 'floor' WHEN 'baseline' THEN CASE WHEN abs(model_mape - rule_mape) < 1e-9 THEN 'tie' ELSE 'rule_ahead' END END AS served_reason,
       CASE WHEN served <> 'model' THEN '{",".join(SIGNAL_FEATURES)}' END AS missing_signals,
       round(CASE served WHEN 'model' THEN price_cr WHEN 'baseline' THEN rule END, 6) AS headline_cr,
       round(CASE served WHEN 'model' THEN price_cr * exp(-q90) WHEN 'baseline' THEN rule * exp(-rule_q90) END, 6) AS headline_lo_cr,
       round(CASE served WHEN 'model' THEN price_cr * exp(-q10) WHEN 'baseline' THEN rule * exp(-rule_q10) END, 6) AS headline_hi_cr,
       CASE WHEN served = 'model' THEN CASE WHEN known THEN 'model' ELSE 'model_no_society' END END AS accuracy_regime,
       round(CASE WHEN served = 'model' THEN model_mape END, 6) AS expected_mape_pct,
       CASE WHEN served = 'model' AND NOT known THEN CASE WHEN society IS NULL THEN 'no_society' ELSE 'unseen_society' END END AS regime_reason
FROM e""")
def q_tree_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-1..3, FN-17, SRV-1..4, AGG-7 on priced trees: estimates of a batch, served by the model in some cities, by the rule in one and
    not at all in another."""
    listings, ensemble = feed(spark, sf_dir), trees_of(spark, sf_dir)
    fit = materialize(walked(listings, ensemble, ["listing_id", "city_key"]).withColumnRenamed("price_cr", "pred_model").join(
        listings.select("listing_id", "price", (F.col("sector_ppsf") * F.col("area") / 1e7).alias("pred_baseline_sector")), "listing_id")
        .withColumn("pred_model_no_society", F.col("pred_model")))
    metrics = materialize(regression_metrics(fit, ["model", "model_no_society", "baseline_sector"]))
    bands = residual_band(fit, "pred_model").join(residual_band(fit, "pred_baseline_sector", prefix="rule_"), "city_key", "full")
    q = batch(spark, sf_dir).withColumns({"q_area": F.col("area"), "rule_ppsf": F.col("sector_ppsf")})
    scored = walked(q, ensemble, ["query_id", "city_key", "q_area", "society", "rule_ppsf"])
    lists = listings.select("city_key").distinct().withColumn(
        "features", F.when(F.col("city_key") == AREA_ONLY, F.array(F.lit("area"))).otherwise(F.array(*map(F.lit, FEATURES))))
    known = listings.where(F.col("society").isNotNull()).select("city_key", "society").distinct()
    return round_floats(assemble_estimates(scored, bands, serving_decision(metrics), lists, known, metrics))


@register("tree_leaf_support", "WITH " + _FEED.strip() + """
SELECT city_key, CAST(tree AS INTEGER) AS tree, count(*) FILTER (WHERE feature IS NULL) AS leaves, count(*) FILTER (WHERE feature IS NOT NULL) AS splits,
       round(min(threshold), 6) AS lowest, round(max(threshold), 6) AS highest, round(sum(CASE WHEN feature IS NULL THEN value END), 6) AS leaf_sum
FROM nodes GROUP BY city_key, tree""")
def q_tree_leaf_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-1 (exported trees): leaves, splits and thresholds of every tree of every city."""
    t = trees_of(spark, sf_dir).trees
    leaf = F.col("feature").isNull()
    return round_floats(t.groupBy("city_key", "tree").agg(F.count_if(leaf).alias("leaves"), F.count_if(~leaf).alias("splits"), F.min("threshold").alias("lowest"),
                                                          F.max("threshold").alias("highest"), F.sum(F.when(leaf, F.col("value"))).alias("leaf_sum")))
