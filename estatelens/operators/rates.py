"""Rate-table pricing without a model (SRC-5, DQ-12, JOIN-5, AGG-11, REF-*).

A rate table is a DataFrame ``(zone, property_type, rate_low_per_sqft,
rate_high_per_sqft, source, source_date)`` plus its ``last_updated`` date.
A batch of queries ``(query_id, zone, property_type, area_sqft, locality)``
is priced in one join: every matching rate row becomes a line item, the span
is the minimum of the lows and the maximum of the highs.  Queries without a
matching rate or with a non-positive area get a status instead of an error.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions import columns as fn

#: Label of every answer.
REFERENCE_LABEL = "from rates on file, not a prediction"


def rate_table_checks(rates: DataFrame, last_updated: str | None) -> DataFrame:
    """DQ-12: one row: rows, inverted rows (low > high), dated, valid."""
    return rates.agg(F.count(F.lit(1)).alias("rows"),
                     F.count_if(F.col("rate_low_per_sqft") > F.col("rate_high_per_sqft")).alias("inverted_rows")) \
        .withColumn("dated", F.lit(last_updated is not None)) \
        .withColumn("valid", (F.col("rows") > 0) & (F.col("inverted_rows") == 0) & F.col("dated"))


def rate_catalogue(rates: DataFrame) -> DataFrame:
    """REF-2: the (zone, property type) pairs on file with their source count."""
    return rates.groupBy("zone", "property_type").agg(F.count(F.lit(1)).alias("sources")) \
                .orderBy("zone", "property_type")


def rate_sheet(rates: DataFrame, last_updated: str, as_of: str, staleness_days: int = fn.STALENESS_DAYS) -> DataFrame:
    """RPT-6: the rate rows, each with the table's date, the threshold in days and whether it is past it."""
    return rates.select("zone", "property_type", "source", F.col("source_date").cast("string").alias("source_date"),
                        "rate_low_per_sqft", "rate_high_per_sqft", F.lit(last_updated).alias("last_updated"),
                        F.lit(staleness_days).alias("staleness_days"),
                        fn.is_stale(F.lit(last_updated).cast("date"), F.lit(as_of).cast("date"), staleness_days).alias("stale"))


def read_rates(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """SRC-5: a rate table from a JSON-lines folder of rows that each carry
    ``last_updated``; ``(rates, last_updated)``.  Refused if it is empty,
    undated, of several dates, or holds a row whose low rate is above its high one."""
    schema = ("zone string, property_type string, rate_low_per_sqft double, rate_high_per_sqft double, source string, "
              "source_date string, last_updated string")
    df = spark.read.schema(schema).json(path)
    n, dates, undated, inverted, first = df.agg(
        F.count(F.lit(1)), F.count_distinct("last_updated"), F.count_if(F.col("last_updated").isNull()),
        F.count_if(~F.coalesce(F.col("rate_low_per_sqft") <= F.col("rate_high_per_sqft"), F.lit(False))), F.min("last_updated")).first()
    for wrong, what in ((n == 0, "no rows"), (undated > 0 or dates != 1, "not one last_updated date"), (inverted > 0, f"{inverted} rows with low above high")):
        if wrong:
            raise ValueError(f"rate table {path}: {what}")
    return df.drop("last_updated"), first


def price_from_rates(queries: DataFrame, rates: DataFrame, last_updated: str, as_of: str,
                     staleness_days: int = fn.STALENESS_DAYS) -> tuple[DataFrame, DataFrame]:
    """REF-1: ``(estimates, line_items)`` for a batch of queries.

    ``estimates``: query_id, zone, property_type, area_sqft, status
    (``ok`` / ``no_rate`` / ``bad_area``), low_cr, high_cr, n_sources,
    table_last_updated, stale, age_days, contamination.  The zones on file
    for a ``no_rate`` answer are the ``rate_catalogue``.
    ``line_items``: one row per query and matching rate row.
    """
    q = queries.select("query_id", "zone", "property_type", F.col("area_sqft").cast("double").alias("area_sqft"),
                       "locality")
    ok_area = F.col("area_sqft") > 0
    items = (q.where(ok_area).join(rates, ["zone", "property_type"])
              .select("query_id", "zone", "property_type", "source", "source_date", "rate_low_per_sqft",
                      "rate_high_per_sqft",
                      (F.col("rate_low_per_sqft") * F.col("area_sqft") / 1e7).alias("low_cr"),
                      (F.col("rate_high_per_sqft") * F.col("area_sqft") / 1e7).alias("high_cr")))
    span = items.groupBy("query_id").agg(F.min("low_cr").alias("low_cr"), F.max("high_cr").alias("high_cr"),
                                         F.count(F.lit(1)).alias("n_sources"))
    age = F.datediff(F.lit(as_of).cast("date"), F.lit(last_updated).cast("date"))
    est = (q.join(span, "query_id", "left")
             .withColumn("status", F.when(~ok_area, "bad_area").when(F.col("n_sources").isNull(), "no_rate")
                         .otherwise("ok"))
             .select("query_id", "zone", "property_type", "area_sqft", "status", "low_cr", "high_cr",
                     F.coalesce("n_sources", F.lit(0).cast("bigint")).alias("n_sources"),
                     F.lit(last_updated).alias("table_last_updated"),
                     (age > staleness_days).alias("stale"), age.alias("age_days"),
                     fn.contamination_flag(F.col("locality")).alias("contamination")))
    return est, items


def explain_lines(estimates: DataFrame, items: DataFrame) -> DataFrame:
    """FN-22: what each priced query's range was made from, a row for each part:
    ``rate`` rows (source, date, rates, bounds), one ``range`` row (the span)
    and, if they apply, ``stale`` (age in days) and ``locality`` rows.  Every
    row carries ``label``: the range is arithmetic over the rates on file."""
    priced = estimates.where(F.col("status") == "ok")
    none = lambda t: F.lit(None).cast(t)

    def part(df, kind, source=None, date=None, rate_low=None, rate_high=None, low=None, high=None, age=None):
        pick = lambda c, t: none(t) if c is None else F.col(c).cast(t)
        return df.select("query_id", F.lit(kind).alias("part"), pick(source, "string").alias("source"),
                         pick(date, "string").alias("source_date"), pick(rate_low, "double").alias("rate_low_per_sqft"),
                         pick(rate_high, "double").alias("rate_high_per_sqft"), pick(low, "double").alias("low_cr"),
                         pick(high, "double").alias("high_cr"), pick(age, "int").alias("age_days"), F.lit(REFERENCE_LABEL).alias("label"))

    return (part(items, "rate", "source", "source_date", "rate_low_per_sqft", "rate_high_per_sqft", "low_cr", "high_cr")
            .unionByName(part(priced, "range", low="low_cr", high="high_cr"))
            .unionByName(part(priced.where("stale"), "stale", date="table_last_updated", age="age_days"))
            .unionByName(part(priced.where("contamination"), "locality")))


def default_as_of() -> str:
    return dt.date.today().isoformat()
