"""Hash-based k-fold assignment and seeded per-row uniform draws.

A fold is a pure function of the listing id and a seed, so it does not depend
on partitioning, task order or reruns, and the same expression is written
in DuckDB for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SEED = 7
DEFAULT_SPLITS = 5


def _hash32(*parts: Column) -> Column:
    """First 32 bits of md5 over ``parts`` joined by '|', as BIGINT."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def fold_of(listing_id: Column, n_splits: int = DEFAULT_SPLITS, seed: int = DEFAULT_SEED) -> Column:
    """CV-1: fold number in ``[0, n_splits)``."""
    return (_hash32(listing_id, F.lit(str(seed))) % n_splits).cast("int")


def assign_fold(df: DataFrame, n_splits: int = DEFAULT_SPLITS, seed: int = DEFAULT_SEED,
                id_col: str = "listing_id") -> DataFrame:
    """Add ``fold`` to every row."""
    return df.withColumn("fold", fold_of(F.col(id_col), n_splits, seed))


def hash01(listing_id: Column, *salt: Column) -> Column:
    """Seeded uniform draw in [0, 1) from the listing id and ``salt``."""
    return _hash32(listing_id, *salt) / F.lit(4294967296.0)


def training_folds(fold: Column, n_splits: int = DEFAULT_SPLITS) -> Column:
    """The encoder folds a row trains: every fold id except its own."""
    return F.array_remove(F.sequence(F.lit(0), F.lit(n_splits - 1)), fold)
