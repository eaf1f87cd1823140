"""Incremental ingest of arriving site files.

No event time exists in this data, so there is no watermark: the file source's own log
makes each file count once, and the sink's keys make a replayed batch harmless.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

RANGES = 32  # most ranges of keys that a batch asks of the sink
ORDERED = (T.StringType, T.IntegralType, T.DateType, T.TimestampType)  # types whose ranges reach the scan


def site_stream(spark: SparkSession, source: str, schema: T.StructType, files_per_trigger: int = 10_000,
                glob: str = "*.parquet") -> DataFrame:
    """Stream of per-site files with the file name as a column."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(source)
        .withColumn("filename", F.col("_metadata.file_name"))
    )


def key_ranges(rows: DataFrame, key: str, parts: int = RANGES) -> list[tuple]:
    """At most ``parts`` disjoint (smallest, largest) that cover the values of a column; NULLs are in none."""
    values = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    found = (values.repartitionByRange(parts, key).groupBy(F.spark_partition_id())
             .agg(F.min(key).alias("least"), F.max(key).alias("most")).collect())
    return sorted((r["least"], r["most"]) for r in found)


def held_keys(sink: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the sink in the ranges of the leading key of ``rows``.

    The ranges are pushed into the scan, where the smallest and largest values that Parquet keeps of each row group
    and page, and for a range of one value its Bloom filter, rule out what earlier batches wrote elsewhere. Every
    key that ``rows`` and the sink share is in the result, whatever partition it is in.
    """
    present = sink.select(*keys)
    kind = present.schema[keys[0]].dataType
    if not isinstance(kind, ORDERED) or rows.schema[keys[0]].dataType != kind:
        return present
    ranges = key_ranges(rows, keys[0])
    lead = F.col(keys[0])
    tests = [lead == least if least == most else (lead >= least) & (lead <= most) for least, most in ranges]
    return present.filter(functools.reduce(Column.__or__, tests, F.lit(False)))


def append_new(sink: str, keys: list[str], partition: list[str] | None = None,
               transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer that adds only keys the sink does not hold, in whatever partition.

    Of the sink the key columns alone are read, and of these what lies in the batch's ranges of the leading key: name
    first the key by which data arrive together. Batches are written in key order with Bloom filters of the leading
    key. A NULL in the key equals nothing. A sink that does not exist yet holds no key; any other failure to read it
    stops the batch.
    """
    partition = partition or []

    def write(batch: DataFrame, batch_id: int) -> None:
        arrived = transform(batch) if transform else batch
        rows = arrived.dropDuplicates(keys)
        try:
            present = batch.sparkSession.read.parquet(sink)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            present = None
        if present is not None:
            rows = rows.join(held_keys(present, arrived, keys), keys, "left_anti")
        writer = (rows.sortWithinPartitions(*partition, *keys).write.mode("append").option("compression", "zstd")
                  .option(f"parquet.bloom.filter.enabled#{keys[0]}", "true"))
        (writer.partitionBy(*partition) if partition else writer).parquet(sink)

    return write


def ingest_available(stream: DataFrame, sink: str, checkpoint: str, keys: list[str],
                     partition: list[str] | None = None,
                     transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process everything that has arrived, then stop; the next run continues from there."""
    query = (
        stream.writeStream.foreachBatch(append_new(sink, keys, partition, transform))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
