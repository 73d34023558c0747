"""Feature catalogue, per-city feature availability, feature matrix and the
society masking used in training (ML-1..4, DQ-16).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import columns as fn
from estatelens.operators.folds import DEFAULT_SEED, hash01

# Catalogue order, sources of every feature, core features.
ALL_FEATURE_COLUMNS = [
    "area", "bedrooms", "bathrooms", "is_house", "furnishing_code",
    "luxury_score", "age_code", "sector_ppsf", "sector_ppsf_mean",
    "sector_ppsf_std", "sector_count", "society_ppsf", "balcony_code",
    "amenity_count", "is_resale",
]
FEATURE_SOURCES = {
    "area": ("area",), "bedrooms": ("bedrooms",), "bathrooms": ("bathrooms",),
    "is_house": ("property_type",), "furnishing_code": ("furnishing_type",),
    "luxury_score": ("luxury_score",), "age_code": ("age_possession",),
    "sector_ppsf": ("sector",), "sector_ppsf_mean": ("sector",), "sector_ppsf_std": ("sector",),
    "sector_count": ("sector",), "society_ppsf": ("society",), "balcony_code": ("balcony",),
    "amenity_count": ("amenity_count",), "is_resale": ("is_resale",),
}
CORE_FEATURE_COLUMNS = ["area", "bedrooms", "sector_ppsf", "sector_ppsf_mean", "sector_ppsf_std", "sector_count"]
SOCIETY_MASK_FRACTION = 0.5
ENCODED = ("sector_ppsf", "sector_ppsf_mean", "sector_ppsf_std", "sector_count", "society_ppsf")


def feature_availability(df: DataFrame, keys: Sequence[str] = ("city_key",)) -> DataFrame:
    """ML-3 + DQ-16: per city, the catalogue features it can supply (every
    source column holds a value on at least one of its rows), in catalogue
    order, the core features it cannot supply, and whether a model is
    possible.  Absent columns count as empty."""
    sources = sorted({s for srcs in FEATURE_SOURCES.values() for s in srcs})
    present = {s: (F.count(F.col(s)) > 0) if s in df.columns else F.lit(False) for s in sources}
    g = df.groupBy(*keys).agg(*[v.alias(f"_has_{k}") for k, v in present.items()])
    def have(f: str) -> Column:
        out = F.lit(True)
        for s in FEATURE_SOURCES[f]:
            out = out & F.col(f"_has_{s}")
        return out
    feats = F.filter(F.array(*[F.when(have(f), F.lit(f)) for f in ALL_FEATURE_COLUMNS]), lambda x: x.isNotNull())
    missing = F.filter(F.array(*[F.when(~have(f), F.lit(f)) for f in CORE_FEATURE_COLUMNS]), lambda x: x.isNotNull())
    return g.select(*keys, feats.alias("features"), missing.alias("missing_core"),
                    (F.size(missing) == 0).alias("can_model"))


def feature_expressions(columns: Sequence[str]) -> dict[str, Column]:
    """ML-4: DOUBLE expression per selected feature (encoded columns must
    already be on the frame, see ``apply_encoders``)."""
    exprs = {
        "area": F.col("area").cast("double"),
        "bedrooms": F.col("bedrooms").cast("double"),
        "bathrooms": F.col("bathrooms").cast("double"),
        "is_house": fn.is_house("property_type"),
        "furnishing_code": fn.furnishing_code("furnishing_type"),
        "luxury_score": F.col("luxury_score").cast("double"),
        "age_code": fn.age_code("age_possession"),
        "balcony_code": fn.balcony_code("balcony"),
        "amenity_count": fn.numeric_or_missing("amenity_count"),
        "is_resale": fn.numeric_or_missing("is_resale"),
    }
    for c in ENCODED:
        exprs[c] = F.col(c).cast("double")
    unknown = [c for c in columns if c not in exprs]
    if unknown:
        raise ValueError(f"Not catalogue feature(s): {unknown}. Valid: {', '.join(ALL_FEATURE_COLUMNS)}")
    return {c: exprs[c] for c in columns}


def build_features(encoded: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """ML-4: ``keep`` columns plus one DOUBLE column per feature, in order."""
    exprs = feature_expressions(columns)
    return encoded.select(*keep, *[e.alias(c) for c, e in exprs.items()])


def unknown_furnishing_labels(df: DataFrame, keys: Sequence[str] = ("city_key",)) -> DataFrame:
    """DQ-15: non-null furnishing labels outside the code map, per city."""
    known = list(fn.FURNISHING_CODES)
    return (df.where(F.col("furnishing_type").isNotNull() & ~F.col("furnishing_type").isin(*known))
              .select(*keys, "furnishing_type").distinct())


def mask_society(features: DataFrame, fold_col: str = "fold", seed: int = DEFAULT_SEED,
                 fraction: float = SOCIETY_MASK_FRACTION, id_col: str = "listing_id") -> DataFrame:
    """ML-1: on about ``fraction`` of training rows replace ``society_ppsf``
    by the row's own ``sector_ppsf``; a fresh seeded draw per fold.  No-op
    without a society feature."""
    if "society_ppsf" not in features.columns:
        return features
    draw = hash01(F.col(id_col), F.lit(str(seed)), F.col(fold_col).cast("string"))
    return features.withColumn("society_ppsf", F.when(draw < fraction, F.col("sector_ppsf"))
                               .otherwise(F.col("society_ppsf")))


def without_society(features: DataFrame) -> DataFrame:
    """ML-2: a caller who cannot name the building: society rate := sector rate."""
    if "society_ppsf" not in features.columns:
        return features
    return features.withColumn("society_ppsf", F.col("sector_ppsf"))
