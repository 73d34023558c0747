"""Feed readers and table writers (SRC-1..4, SRC-6..8, SNK-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from estatelens.functions.columns import na_to_null


def read_raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """SRC-1 / SRC-2: a listing CSV read with every column as STRING (types
    come from the contract, never from whole-file inference), pandas' missing
    tokens mapped to NULL."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", False)
    df = reader.csv(path)
    return df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_processed(spark: SparkSession, path: str, city_key: str | None = None) -> DataFrame:
    """SRC-3: the processed listings, pruned to one city's partition when asked."""
    df = spark.read.parquet(path)
    return df.where(F.col("city_key") == city_key) if city_key else df


def write_processed(df: DataFrame, path: str) -> None:
    """SNK-1: listings partitioned by city; only the cities present are
    replaced (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("city_key").parquet(path))


def write_report(df: DataFrame, path: str) -> None:
    """SNK-2 / SNK-3: a report table; refused when a float column holds NaN
    or infinity (JSON consumers cannot read them)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    if floats:
        bad = df.agg(*[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in floats]).first()
        offenders = [c for c in floats if bad[c]]
        if offenders:
            raise ValueError(f"report has NaN / infinite values in {offenders}")
    df.write.mode("overwrite").json(path)


def cities_table(spark: SparkSession, public: list[tuple[str, str]],
                 private: list[tuple[str, str]] | None = None) -> DataFrame:
    """SRC-6 / SRC-8: the city registry (``city_key, display, public``);
    private cities are merged in with ``public = false``."""
    rows = [(k, d, True) for k, d in public] + [(k, d, False) for k, d in (private or [])]
    df = spark.createDataFrame(rows, "city_key string, display string, public boolean")
    missing = [k for k, d, _ in rows if not k or not d]
    if missing:
        raise ValueError(f"city entries without key or display name: {missing}")
    return df


def unknown_cities(listings: DataFrame, cities: DataFrame) -> DataFrame:
    """SRC-6: city keys of the listings that the registry does not know."""
    return listings.select("city_key").distinct().join((cities), "city_key", "left_anti")


def public_listings(listings: DataFrame, cities: DataFrame) -> DataFrame:
    """SRC-7: listings of public cities only (semi join on a bounded table)."""
    return listings.join((cities.where("public").select("city_key")), "city_key", "left_semi")


def write_metrics(metrics: DataFrame, model_name: str, path: str) -> None:
    """SNK-3: the long metrics table of one model, keyed (city_key, model_name):
    a city's rows of that model are replaced, all others stay."""
    (metrics.withColumn("model_name", F.lit(model_name)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("city_key", "model_name").parquet(path))
