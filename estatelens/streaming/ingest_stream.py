"""Row-wise ingest under Structured Streaming.

The reference has no streaming.  The stateless part of ingest -- mapping,
parsing, unit conversion, locality normalisation, the per-row basis filter,
the per-row price-per-sq.ft. band and the amenity count -- needs no state, so
it runs unchanged on a stream of raw feed files.  Percentile trims, dedup
over all time and model fits stay batch jobs over the accumulated table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from estatelens.operators.contract import ListingContract
from estatelens.operators.ingest import amenity_count, basis_of, map_and_convert


def rowwise_ingest(raw: DataFrame, contract: ListingContract) -> DataFrame:
    """Stateless ingest steps; works on a batch or a streaming frame."""
    df = map_and_convert(raw, contract)
    keep = F.lit(True)
    if contract.area_basis_column:
        keep = keep & F.coalesce(basis_of(df, contract) == contract.area_basis, F.lit(False))
    if contract.expected_ppsf_range:
        keep = keep & F.coalesce(F.col("price_per_sqft").between(*contract.expected_ppsf_range), F.lit(False))
    df = df.where(keep)
    if contract.amenity_columns:
        df = df.withColumn("amenity_count", amenity_count(contract))
    helper = [c for c in df.columns if c.startswith("_")]
    return df.drop(*helper).withColumn("area_basis", F.lit(contract.area_basis))


def start_stream_ingest(spark: SparkSession, source_dir: str, schema: StructType, contract: ListingContract,
                        sink_dir: str, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Read new parquet feed files from ``source_dir`` and append the
    row-wise ingested listings to ``sink_dir`` (partitioned by city).

    ``checkpoint_dir`` is the stream's own folder, kept next to the sink and
    for as long: a stream started again, also by another application, with the
    same source, sink and checkpoint resumes where the last one stopped.  (The
    session's checkpoint folder would not do: Spark gives every application a
    new one under it.)"""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    out = rowwise_ingest(stream, contract)
    writer = (out.writeStream.format("parquet").option("path", sink_dir)
                 .option("checkpointLocation", checkpoint_dir)
                 .partitionBy("city_key").outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
