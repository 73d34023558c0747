"""Fold-safe target encoders (AGG-1..5) and their lookups (JOIN-1/2).

Encoders are three tables keyed by ``(city_key, fold)``:

* ``global``  -- median, mean, sample std and count of price per sq.ft.;
* ``sector``  -- the same per locality (std of a one-row locality falls back
  to the global std; an unseen locality has count 0);
* ``society`` -- smoothed building median
  ``(n * median + m * global_median) / (n + m)``; rows without a building
  name are left out of the grouping.

``fold = f`` holds encoders learned on every row *outside* fold ``f`` (the
ones that may price fold ``f``); ``fold = -1`` holds encoders learned on all
rows (final model, valuations).  No row is copied per fold: values are counted
by fold, sorted once, and leaving a fold out is a running sum of its own, so
all folds of all cities come from one sort.  The table is written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.operators.folds import training_folds
from estatelens.operators.quantiles import weighted_quantiles
from estatelens.session import materialize

SOCIETY_SMOOTHING_M = 10.0
FULL_FOLD = -1
ENC_KEYS = ["city_key", "fold"]


@dataclass(frozen=True)
class Encoders:
    global_stats: DataFrame   # city_key, fold, g_median, g_mean, g_std, g_count
    sector_stats: DataFrame   # city_key, fold, sector, s_median, s_mean, s_std, s_count
    society_stats: DataFrame  # city_key, fold, society, society_ppsf, soc_count


def fit_encoders(df: DataFrame, n_splits: int | None = None, with_society: bool | None = None,
                 smoothing_m: float = SOCIETY_SMOOTHING_M) -> Encoders:
    """AGG-1..5 for every city (and every fold when ``n_splits`` is given:
    ``df`` then carries ``fold``).

    The three levels (city, locality, building) are stacked into one frame
    ``(city_key, level, key, ppsf, fold)`` so that all medians and moments come
    from a single distributed sort.
    """
    if with_society is None:
        with_society = "society" in df.columns
    levels = [F.struct(F.lit("g").alias("_lvl"), F.lit("").alias("_key")),
              F.struct(F.lit("s").alias("_lvl"), F.col("sector").alias("_key"))]
    if with_society:
        levels.append(F.struct(F.lit("o").alias("_lvl"), F.col("society").alias("_key")))
    fold = [] if n_splits is None else ["fold"]
    stacked = (df.select("city_key", *fold, "price_per_sqft", F.explode(F.array(*levels)).alias("_l"))
                 .select("city_key", *fold, "_l._lvl", "_l._key", "price_per_sqft")
                 .where(F.col("_key").isNotNull()))
    # the encoders of fold f count every row outside it
    folds = [FULL_FOLD] if n_splits is None else list(range(n_splits))
    weights = {f"q{i}": F.lit(1) if n_splits is None else (F.col("fold") != f).cast("int") for i, f in enumerate(folds)}
    wide = weighted_quantiles(stacked, ["city_key", "_lvl", "_key"], "price_per_sqft", weights, {"_median": 0.5}, moments=True)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"q{i}").alias("q")) for i, f in enumerate(folds)]))
    stats = materialize(wide.select("city_key", "_lvl", "_key", each.alias("e")).where(F.col("e.q").isNotNull()).select(
        "city_key", F.col("e.fold").alias("fold"), "_lvl", "_key", F.col("e.q._median").alias("_median"),
        F.col("e.q.mean").alias("_mean"), F.col("e.q.std").alias("_std"), F.col("e.q.n").alias("_count")))

    global_stats = stats.where(F.col("_lvl") == "g").select(
        *ENC_KEYS, F.col("_median").alias("g_median"), F.col("_mean").alias("g_mean"),
        F.col("_std").alias("g_std"), F.col("_count").alias("g_count"))
    g = global_stats.select(*ENC_KEYS, "g_median", "g_std")
    # written: a join's size is not known before it has run, and rows joined with it would be shuffled for nothing
    sector_stats = materialize(stats.where(F.col("_lvl") == "s").join(g, ENC_KEYS, "left")
                         .select(*ENC_KEYS, F.col("_key").alias("sector"), F.col("_median").alias("s_median"),
                                 F.col("_mean").alias("s_mean"), F.coalesce("_std", "g_std").alias("s_std"),
                                 F.col("_count").alias("s_count")))
    society_stats = None
    if with_society:
        society_stats = materialize(stats.where(F.col("_lvl") == "o").join(g, ENC_KEYS, "left")
                              .select(*ENC_KEYS, F.col("_key").alias("society"),
                                      ((F.col("_count") * F.col("_median") + smoothing_m * F.col("g_median"))
                                       / (F.col("_count") + smoothing_m)).alias("society_ppsf"),
                                      F.col("_count").alias("soc_count")))
    return Encoders(global_stats, sector_stats, society_stats)


def apply_encoders(rows: DataFrame, enc: Encoders, full: bool = False) -> DataFrame:
    """JOIN-1/2: add ``sector_ppsf, sector_ppsf_mean, sector_ppsf_std,
    sector_count``, ``global_ppsf`` and (when a society table exists)
    ``society_ppsf``.

    ``rows`` carry ``city_key``, ``sector``, ``society`` and, unless ``full``,
    the ``fold`` whose encoders price them; ``full`` uses the all-rows
    encoders.  Fallbacks: unseen locality -> global median / mean / std and
    count 0; unknown or missing building -> the row's own locality rate.  All
    tables are joined by key; the planner picks each join's strategy from the
    measured size.
    """
    df = rows.withColumn("_enc_fold", F.lit(FULL_FOLD) if full else F.col("fold"))
    keys = ["city_key", "_enc_fold"]

    def keyed(t: DataFrame) -> DataFrame:
        return t.withColumnRenamed("fold", "_enc_fold")

    g = keyed(enc.global_stats.select(*ENC_KEYS, "g_median", "g_mean", "g_std"))
    out = (df.join(g, keys, "left")
             .join(keyed(enc.sector_stats), keys + ["sector"], "left")
             .withColumns({
                 "sector_ppsf": F.coalesce("s_median", "g_median"),
                 "sector_ppsf_mean": F.coalesce("s_mean", "g_mean"),
                 "sector_ppsf_std": F.coalesce("s_std", "g_std"),
                 "sector_count": F.coalesce(F.col("s_count").cast("double"), F.lit(0.0)),
                 "global_ppsf": F.col("g_median"),
             }))
    drop = ["s_median", "s_mean", "s_std", "s_count", "g_median", "g_mean", "g_std", "_enc_fold"]
    if enc.society_stats is not None and "society" in df.columns:
        soc = keyed(enc.society_stats.select(*ENC_KEYS, "society", F.col("society_ppsf").alias("_soc")))
        out = (out.join(soc, keys + ["society"], "left")
                  .withColumn("society_ppsf", F.coalesce("_soc", "sector_ppsf")))
        drop.append("_soc")
    return out.drop(*drop)


def apply_training_encoders(rows: DataFrame, enc: Encoders, n_splits: int) -> DataFrame:
    """``rows`` (with their own ``fold``) once for every fold that they train, which is ``fold`` then, with the columns that
    ``apply_encoders`` adds.

    A row meets its locality and its building once, with the encoders of all folds side by side, and is copied for its folds
    after that: the joins shuffle every row once, not once a fold.
    """
    def by_fold(t: DataFrame, keys: list[str], *cols: str) -> DataFrame:
        entry = F.struct("fold", F.struct(*cols))
        return materialize(t.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(f"_by_{keys[-1]}")))  # an entry a fold

    out = (rows.join(by_fold(enc.global_stats, ["city_key"], "g_median", "g_mean", "g_std"), ["city_key"], "left")
               .join(by_fold(enc.sector_stats, ["city_key", "sector"], "s_median", "s_mean", "s_std", "s_count"), ["city_key", "sector"], "left"))
    with_society = enc.society_stats is not None and "society" in rows.columns
    if with_society:
        out = out.join(by_fold(enc.society_stats, ["city_key", "society"], "society_ppsf"), ["city_key", "society"], "left")
    out = out.withColumn("fold", F.explode(training_folds(F.col("fold"), n_splits)))
    g, s = F.col("_by_city_key")[F.col("fold")], F.col("_by_sector")[F.col("fold")]
    out = out.withColumns({
        "sector_ppsf": F.coalesce(s["s_median"], g["g_median"]),
        "sector_ppsf_mean": F.coalesce(s["s_mean"], g["g_mean"]),
        "sector_ppsf_std": F.coalesce(s["s_std"], g["g_std"]),
        "sector_count": F.coalesce(s["s_count"].cast("double"), F.lit(0.0)),
        "global_ppsf": g["g_median"],
    })
    if with_society:
        out = out.withColumn("society_ppsf", F.coalesce(F.col("_by_society")[F.col("fold")]["society_ppsf"], "sector_ppsf"))
    return out.drop("_by_city_key", "_by_sector", "_by_society")
