"""Writers. All go through Spark's output committer, so a table appears whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import columns as C


def write_profiles(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None,
                   force: bool = False) -> None:
    """Parquet (zstd), csv or csv.gz; an existing table is only replaced when forced."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    if fmt == "parquet":
        writer.option("compression", compression or "zstd").parquet(path)
    elif fmt in ("csv", "csv.gz"):
        writer.option("header", True).option("compression", "gzip" if fmt == "csv.gz" else "none").csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def publish_sorted(df: DataFrame, path: str, keys: list[str], force: bool = False) -> None:
    """Globally ordered parquet: range partitions, sorted inside."""
    ordered = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    write_profiles(ordered, path, force=force)


def write_site_tree(df: DataFrame, path: str, model: str = "Metadata_model", codec: str = "Metadata_compression",
                    files_per_plate: int = 1, force: bool = False) -> None:
    """``model_codec/source/batch/plate`` partitions with few files instead of one per site.

    Rows of one plate go to ``files_per_plate`` tasks, so a large plate can be spread.
    """
    cols = ["model_codec", C.SOURCE, C.BATCH, C.PLATE]
    tagged = df.withColumn("model_codec", F.concat_ws("-", model, codec))
    salt = F.pmod(F.xxhash64(C.WELL, C.SITE), F.lit(files_per_plate))
    spread = tagged.repartition(*[F.col(c) for c in cols], salt)
    spread.write.mode("overwrite" if force else "errorifexists").option("compression", "zstd").partitionBy(
        *cols).parquet(path)


def write_membership(members: DataFrame, path: str) -> None:
    """Step membership as one table partitioned by step; a rerun replaces only its steps."""
    members.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def without_existing(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the sink yet."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")
