"""Out-of-fold evaluation of the price-per-sq.ft. rules, metrics, residual
bands and the serving decision.

Every function works on all cities at once; metrics are pooled over all
out-of-fold rows of a city (not averaged per fold).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions import columns as fn
from estatelens.operators.encoders import Encoders, apply_encoders, fit_encoders
from estatelens.operators.folds import DEFAULT_SEED, DEFAULT_SPLITS, assign_fold
from estatelens.operators.quantiles import exact_quantiles

QUALITY_FLOOR_MAPE_PCT = 30.0
PREDICTORS = ("model", "model_no_society", "baseline_sector", "baseline_global")


def validate_prices(df: DataFrame, keys: Sequence[str] = ("city_key",)) -> DataFrame:
    """DQ-13: per city, the number of prices that are not finite and > 0
    (``bad_prices``); 0 means the city can be evaluated in log space."""
    p = F.col("price")
    bad = p.isNull() | F.isnan(p) | (p <= 0) | (p == F.lit(float("inf")))
    return df.groupBy(*keys).agg(F.count_if(bad).alias("bad_prices"))


def oof_rule_predictions(listings: DataFrame, n_splits: int = DEFAULT_SPLITS,
                         seed: int = DEFAULT_SEED, encoders: Encoders | None = None) -> DataFrame:
    """CV-2: every listing priced by the two rules learned without its fold.

    Adds ``fold``, the encoded columns and ``pred_baseline_sector`` /
    ``pred_baseline_global`` (crore).
    """
    df = listings if "fold" in listings.columns else assign_fold(listings, n_splits, seed)
    # the rules need no building encoder: leave that level out of the sort
    enc = encoders or fit_encoders(df, n_splits, with_society=False)
    out = apply_encoders(df, enc)
    return out.withColumns({
        "pred_baseline_sector": F.col("sector_ppsf") * F.col("area") / 1e7,
        "pred_baseline_global": F.col("global_ppsf") * F.col("area") / 1e7,
    })


def regression_metrics(oof: DataFrame, predictors: Sequence[str], keys: Sequence[str] = ("city_key",),
                       actual: str = "price") -> DataFrame:
    """AGG-6: MAE (lakh), MAPE (%) and R^2 per group and predictor, pooled.

    ``predictors`` name columns ``pred_<name>``.  Long output:
    ``keys..., predictor, n, mae_lakh, mape_pct, r2``.  R^2 is NULL when
    every actual price of a group is identical (DQ-14).
    """
    keys = list(keys)
    y = F.col(actual)
    # the total sum of squares is n times the variance: no second pass for the mean
    aggs = [F.count(F.lit(1)).alias("n"), (F.count(y) * F.var_pop(y)).alias("_sst"), (F.max(y) > F.min(y)).alias("_varies")]
    for p in predictors:
        e = F.col(f"pred_{p}") - y
        aggs += [F.avg(F.abs(e)).alias(f"_mae_{p}"), F.avg(F.abs(e) / y).alias(f"_mape_{p}"),
                 F.sum(e * e).alias(f"_sse_{p}")]
    wide = oof.groupBy(*keys).agg(*aggs)
    rows = [F.struct(F.lit(p).alias("predictor"),
                     (F.col(f"_mae_{p}") * 100).alias("mae_lakh"),
                     (F.col(f"_mape_{p}") * 100).alias("mape_pct"),
                     F.when(F.col("_varies"), 1 - F.col(f"_sse_{p}") / F.col("_sst")).alias("r2"))
            for p in predictors]
    return wide.select(*keys, "n", F.explode(F.array(*rows)).alias("m")).select(*keys, "n", "m.*")


def residual_band(oof: DataFrame, pred_col: str, keys: Sequence[str] = ("city_key",),
                  actual: str = "price", prefix: str = "") -> DataFrame:
    """AGG-7: 10th / 90th percentile of the out-of-fold log residuals."""
    res = oof.select(*keys, fn.residual_log(pred_col, actual).alias("_res"))
    return exact_quantiles(res, keys, "_res", {f"{prefix}q10": 0.10, f"{prefix}q90": 0.90})


def serving_decision(metrics: DataFrame, keys: Sequence[str] = ("city_key",),
                     floor: float = QUALITY_FLOOR_MAPE_PCT) -> DataFrame:
    """SRV-1..3 from a long metrics table with ``model`` and
    ``baseline_sector`` rows: ``model_beats_baseline`` (a tie loses),
    ``meets_quality_floor`` (better MAPE strictly below the floor),
    ``baseline_served`` and ``serving_status``."""
    keys = list(keys)
    wide = metrics.groupBy(*keys).agg(
        F.max(F.when(F.col("predictor") == "model", F.col("mape_pct"))).alias("model_mape"),
        F.max(F.when(F.col("predictor") == "baseline_sector", F.col("mape_pct"))).alias("baseline_mape"))
    beats = F.col("model_mape") < F.col("baseline_mape")
    better = F.when(beats, F.col("model_mape")).otherwise(F.col("baseline_mape"))
    return wide.select(
        *keys, "model_mape", "baseline_mape",
        beats.alias("model_beats_baseline"),
        (better < floor).alias("meets_quality_floor"),
        (~beats).alias("baseline_served"),
        F.when(~(better < floor), "not_served").when(beats, "model").otherwise("baseline").alias("serving_status"))
