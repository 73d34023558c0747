"""Cleaning steps of the public listing feed, for all cities in one job.

Order is semantics: rename -> drop exact copies -> label categories -> drop
unpriced -> trim percentile outliers.  Trim bounds are per city and are
computed on the untrimmed (deduplicated, priced) rows of that city; a row is
kept only when both its price per sq.ft. and its area lie inside the
inclusive [0.5th, 99.5th] percentile band.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions import columns as fn
from estatelens.operators.quantiles import multi_quantiles
from estatelens.session import materialize

# Raw column name -> tidy name.
COLUMN_RENAMES = {
    "bedRoom": "bedrooms",
    "bathroom": "bathrooms",
    "floorNum": "floor_num",
    "areaWithType": "area_with_type",
    "agePossession": "age_possession",
    "study room": "has_study_room",
    "servant room": "has_servant_room",
    "store room": "has_store_room",
    "pooja room": "has_pooja_room",
    "others": "has_other_rooms",
}
TRIM_COLUMNS = ("price_per_sqft", "area")
TRIM_QUANTILES = (0.005, 0.995)
# Columns of the public feed, as delivered.
PUBLIC_FEED_COLUMNS = ("city_key", "property_type", "society", "sector", "price",
                       "price_per_sqft", "area", "bedRoom", "bathroom", "balcony",
                       "agePossession", "furnishing_type", "luxury_score")
ID_COL = "listing_id"

#: Codes of the cleaning steps, in order.
STEPS = ("rename", "copies", "labels", "unpriced", "outliers")


def public_feed(raw: DataFrame) -> DataFrame:
    """The public feed's own columns (plus the provenance id)."""
    return raw.select(ID_COL, *PUBLIC_FEED_COLUMNS)


def standardize_columns(df: DataFrame) -> DataFrame:
    """MAP-1: rename raw columns to snake_case; missing ones are ignored."""
    return df.withColumnsRenamed({k: v for k, v in COLUMN_RENAMES.items() if k in df.columns})


def drop_duplicates(df: DataFrame, with_counts: bool = False) -> DataFrame:
    """FLT-1: drop exact copies over every feed column (NULLs compare equal).

    The provenance id is not a feed column: each surviving row keeps the
    smallest id of its copies, so the result does not depend on task order.
    ``with_counts`` adds ``_copies`` (rows folded into the survivor).  Rows are
    dealt by a digest of all columns first: copies meet by it, and rows, nearly all
    of them unique, are sorted once, after the shuffle, not before it too.
    """
    cols = [c for c in df.columns if c != ID_COL]
    aggs = [F.min(ID_COL).alias(ID_COL)] if ID_COL in df.columns else []
    if with_counts:
        aggs.append(F.count(F.lit(1)).alias("_copies"))
    if not aggs:
        return df.dropDuplicates()
    # the digest itself need not travel: it deals the rows, and is made again where they arrive
    digest = F.xxhash64(*cols)
    out = df.repartition(digest).withColumn("_digest", digest).groupBy("_digest", *cols).agg(*aggs)
    return out.select(*([ID_COL] if ID_COL in df.columns else []), *cols,
                      *(["_copies"] if with_counts else []))


def encode_categories(df: DataFrame) -> DataFrame:
    """FN-7/8/9: furnishing code -> label, balcony outside the order -> NULL,
    'Undefined' possession -> NULL."""
    return df.withColumns({
        "furnishing_type": fn.label_furnishing("furnishing_type"),
        "balcony": fn.balcony_ordered("balcony"),
        "age_possession": fn.age_undefined_to_null("age_possession"),
    })


def drop_unpriced(df: DataFrame) -> DataFrame:
    """FLT-2: a listing without a price supports no price analysis."""
    return df.where(F.col("price").isNotNull())


def trim_bounds(df: DataFrame, keys: Sequence[str] = ("city_key",),
                columns: Sequence[str] = TRIM_COLUMNS,
                quantiles: tuple[float, float] = TRIM_QUANTILES) -> DataFrame:
    """Per-group inclusive trim bounds ``<col>_lo`` / ``<col>_hi`` (one sort
    for all columns)."""
    return multi_quantiles(df, keys, {c: {f"{c}_lo": quantiles[0], f"{c}_hi": quantiles[1]}
                                      for c in columns})


def trim_percentile_outliers(df: DataFrame, keys: Sequence[str] = ("city_key",),
                             bounds: DataFrame | None = None) -> DataFrame:
    """FLT-3: keep rows inside both percentile bands of their group.

    A NULL value or a group without bounds fails the test, as NaN fails
    ``between`` in pandas.
    """
    bounds = trim_bounds(df, keys) if bounds is None else bounds
    cond = F.lit(True)
    for c in TRIM_COLUMNS:
        cond = cond & F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi"))
    return (df.join(bounds, list(keys), "inner")
              .where(F.coalesce(cond, F.lit(False)))
              .select(*df.columns))


def clean_listings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PIPE-1: the public cleaning pipeline for every city in the feed.

    Returns ``(listings, step_log)``; the step log has one row per city and
    step with ``rows_in``, ``rows_removed`` and ``rows_out``, computed from
    one aggregate over the deduplicated rows tagged with the step that drops
    them.
    """
    std = standardize_columns(raw)
    dedup = drop_duplicates(std, with_counts=True)
    # read by the trim bounds, the listings and the step log: written once
    labeled = materialize(encode_categories(dedup), compression="zstd")  # ids in hex: half as large
    priced = drop_unpriced(labeled)
    bounds = trim_bounds(priced)
    in_band = F.lit(True)
    for c in TRIM_COLUMNS:
        in_band = in_band & F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi"))
    # the step that drops each row; the bounds are a row a city, so this is not worth a second copy of the feed
    tagged = labeled.join(materialize(bounds), "city_key", "left").withColumn(
        "_drop", F.when(F.col("price").isNull(), F.lit(4)).when(~F.coalesce(in_band, F.lit(False)), F.lit(5)))
    listings = tagged.where(F.col("_drop").isNull()).select(*[c for c in dedup.columns if c != "_copies"])
    step_log = _step_log(tagged)
    return listings, step_log


def _step_log(tagged: DataFrame) -> DataFrame:
    per_city = tagged.groupBy("city_key").agg(
        F.sum("_copies").alias("n_raw"),
        F.count(F.lit(1)).alias("n_dedup"),
        F.count_if(F.col("_drop") == 4).alias("n_unpriced"),
        F.count_if(F.col("_drop") == 5).alias("n_trimmed"))
    return step_log_from_counts(per_city, [
        (STEPS[0], F.lit(0)),
        (STEPS[1], F.col("n_raw") - F.col("n_dedup")),
        (STEPS[2], F.lit(0)),
        (STEPS[3], F.col("n_unpriced")),
        (STEPS[4], F.col("n_trimmed")),
    ], start=F.col("n_raw"))


def step_log_from_counts(per_city: DataFrame, steps: list[tuple[str, object]], start) -> DataFrame:
    """LOG-1: turn per-city removal counts into the step-log table
    ``(city_key, step_no, step, rows_in, rows_removed, rows_out)``."""
    rows = []
    removed_before = F.lit(0).cast("bigint")
    for i, (name, removed) in enumerate(steps, start=1):
        removed = removed if hasattr(removed, "alias") else F.lit(removed)
        rows_in = start.cast("bigint") - removed_before
        rows.append(F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"),
                             rows_in.alias("rows_in"), removed.cast("bigint").alias("rows_removed"),
                             (rows_in - removed.cast("bigint")).alias("rows_out")))
        removed_before = removed_before + removed.cast("bigint")
    return (per_city.select("city_key", F.explode(F.array(*rows)).alias("s"))
                    .select("city_key", "s.*"))


# PIPE registry: city key -> cleaning function (raw DataFrame) -> (listings, log).
PIPELINES: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {}


def pipeline_for(city_key: str, registered: Sequence[str]) -> Callable:
    """The cleaning function of a registered city; the public pipeline is the
    default for every registered city without its own entry."""
    if city_key not in registered:
        raise ValueError(f"Unknown city '{city_key}'. Valid: {', '.join(sorted(registered))}")
    return PIPELINES.get(city_key, clean_listings)
