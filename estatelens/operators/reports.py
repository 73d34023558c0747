"""Market statistics and report tables (AGG-9/10, EDA-*, RPT-*, SMP-1, WIN-*).

All statistics are per city in one job.  Medians and quantiles are exact
(``multi_quantiles``); histograms, counts and correlations are one
aggregate each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.operators.quantiles import multi_quantiles, top_k_per_group

CITY = "city_key"
SAMPLE_COLUMNS = ("sector", "property_type", "bedrooms", "area", "price")


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (CITY,)) -> DataFrame:
    """EDA-1: count, mean, sample std, min, quartiles, max per column, long
    format ``(keys, column, count, mean, std, min, p25, p50, p75, max)``."""
    keys = list(keys)
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")) \
        .select(*keys, "s.*")
    mom = stacked.groupBy(*keys, "column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = multi_quantiles(stacked, keys + ["column_name"], {"v": {"p25": 0.25, "p50": 0.5, "p75": 0.75}})
    return mom.join(q, keys + ["column_name"], "left").select(
        *keys, "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def duplicate_count(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (CITY,)) -> DataFrame:
    """EDA-2: rows that repeat an earlier row (all ``columns`` equal)."""
    g = df.groupBy(*keys, *[c for c in columns if c not in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy(*keys).agg((F.sum("_n") - F.count(F.lit(1))).alias("duplicates"))


def missing_share(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (CITY,)) -> DataFrame:
    """EDA-3: percent NULL per column, only columns with any NULL."""
    keys = list(keys)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"),
                              *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("column_name"), (100.0 * F.col(f"_null_{c}") / F.col("_rows")).alias("missing_pct"))
            for c in columns]
    return (g.select(*keys, F.explode(F.array(*rows)).alias("s")).select(*keys, "s.*")
             .where(F.col("missing_pct") > 0))


def value_counts(df: DataFrame, column: Column, keys: Sequence[str] = (CITY,), order: Sequence[str] | None = None,
                 label: str = "label") -> DataFrame:
    """EDA-4 / ORD-1: counts per label; with ``order`` the counts are laid on
    that fixed label order (absent label -> 0, ``ordinal`` = position) and
    labels outside it are dropped, as a reindex does."""
    keys = list(keys)
    counts = df.where(column.isNotNull()).groupBy(*keys, column.cast("string").alias(label)) \
               .agg(F.count(F.lit(1)).alias("n"))
    if order is None:
        return counts
    dims = df.select(*keys).distinct().select(*keys, F.posexplode(F.array(*[F.lit(o) for o in order]))
                                              .alias("ordinal", label))
    return (dims.join(counts, keys + [label], "left")
                .select(*keys, label, F.col("ordinal").cast("int").alias("ordinal"),
                        F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))


def histogram(df: DataFrame, column: str, bins: int, keys: Sequence[str] = (CITY,)) -> DataFrame:
    """AGG-9 / EDA-5: ``bins`` equal-width bins over [min, max] per group, the
    last bin closed; a zero range uses [x - 0.5, x + 0.5].  Empty bins are
    listed with n = 0.  ``(keys, bin, lo, hi, n)``."""
    keys = list(keys)
    x = F.col(column).cast("double")
    base = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    rng = base.groupBy(*keys).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    rng = rng.select(*keys, F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    binned = base.join((rng), keys).select(
        *keys, F.least(F.floor((F.col("_x") - F.col("_lo")) / w), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, keys + ["bin"], "left")
                .select(*keys, "bin", (F.col("_lo") + F.col("bin") * w).alias("lo"),
                        (F.col("_lo") + (F.col("bin") + 1) * w).alias("hi"),
                        F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))


def skew_corrected(x: Column) -> Column:
    """EDA-6: bias-corrected sample skewness (pandas / DuckDB ``skewness``)."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (CITY,)) -> DataFrame:
    """EDA-8: pairwise-complete Pearson correlation of every column pair, one
    aggregate, long format ``(keys, a, b, corr)``."""
    keys = list(keys)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    g = df.groupBy(*keys).agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_c{i}")
                                for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)]
    return g.select(*keys, F.explode(F.array(*rows)).alias("s")).select(*keys, "s.*")


def box_stats(df: DataFrame, value: str, group: str, keys: Sequence[str] = (CITY,)) -> DataFrame:
    """EDA-9: quartiles and 1.5 IQR whiskers (the last data point inside)."""
    keys = list(keys) + [group]
    q = multi_quantiles(df, keys, {value: {"q1": 0.25, "median": 0.5, "q3": 0.75}})
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col(value)
    w = (df.select(*keys, value).join((q), keys)
           .groupBy(*keys, "q1", "median", "q3")
           .agg(F.min(F.when(v >= lo, v)).alias("whisker_lo"), F.max(F.when(v <= hi, v)).alias("whisker_hi")))
    return w


def quintile_edges(df: DataFrame, value: str, keys: Sequence[str] = (CITY,)) -> DataFrame:
    """EDA-13: interpolated edges e0..e5 of ``qcut(value, 5)``.  A group whose
    edges are not all different has no quintiles: its row stops the query that
    reads it, as ``qcut`` raises."""
    edges = multi_quantiles(df, keys, {value: {f"e{i}": i / 5 for i in range(6)}})
    equal = F.lit(False)
    for i in range(5):
        equal = equal | (F.col(f"e{i}") == F.col(f"e{i + 1}"))
    return edges.withColumn("e0", F.when(equal, F.raise_error(F.concat(F.lit("equal quintile edges in "), F.concat_ws("/", *keys)))
                                         .cast("double")).otherwise(F.col("e0")))


def assign_quintile(value: Column) -> Column:
    """Right-closed bins on the edges, the first bin closed on the left; ties
    stay in one bin (unlike ``ntile``)."""
    return (F.when(value <= F.col("e1"), 1).when(value <= F.col("e2"), 2).when(value <= F.col("e3"), 3)
             .when(value <= F.col("e4"), 4).when(value <= F.col("e5"), 5))


def sample_listings(df: DataFrame, n: int = 400, seed: int = 7, keys: Sequence[str] = (CITY,),
                    columns: Sequence[str] = SAMPLE_COLUMNS) -> DataFrame:
    """SMP-1: a deterministic sample of up to ``n`` rows per city (the rows
    with the smallest seeded hash of their id), with the sample columns the
    city has."""
    cols = [c for c in columns if c in df.columns]
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("listing_id")))
    picked = top_k_per_group(df.withColumn("_h", h), keys, ["_h"], n, rank_col="_sample_rank")
    return picked.select(*keys, "listing_id", *cols)
