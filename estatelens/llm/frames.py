"""Small helpers on frames whose columns may have any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT = ("doc_id", "text", "source", "n_chars")


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by quoted name (a dot in a name is no field access)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with every column but those an operator reads named by its place, so that no name clashes
    with an operator's own; ``toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*[c if c in DOCUMENT else f"_col{i}" for i, c in enumerate(docs.columns)])
