"""Long-to-wide profile building and profile aggregation."""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise import columns as C
from platewise.functions.arrow import column_medians
from platewise.functions.expressions import as_col
from platewise.functions.keys import well_key_of_file
from platewise.operators.blocks import exact_median, group_sizes
from platewise.operators.packed import from_long, to_long
from platewise.operators.similarity import text_key

TASK_BYTES = 128 << 20


def explode_values(df: DataFrame, values: str = "values", value: str = "value") -> DataFrame:
    """List-valued measurements to one row per value."""
    return df.withColumn(value, F.explode(values)).drop(values) if values in df.columns else df


def with_well_key(df: DataFrame, file_col: str = "filename", name: str = "Metadata_id") -> DataFrame:
    return df.withColumn(name, well_key_of_file(file_col))


def pivot_cells(df: DataFrame, keys: list[str], name: Column | str, names: list[str],
                value: Column) -> DataFrame:
    """Pivot with a known name list, so no extra job is needed to discover it."""
    return df.withColumn("__name", as_col(name)).groupBy(*keys).pivot("__name", names).agg(value)


def median_profiles(df: DataFrame, keys: list[str], name: Column, names: list[str], value: str) -> DataFrame:
    """Exact median per (key, feature), pivoted; a feature holding most rows is ranged."""
    named = df.select(*keys, name.alias("__name"), value)
    medians = exact_median(named, [*keys, "__name"], value)
    return medians.groupBy(*keys).pivot("__name", names).agg(F.first("median"))


def embedding_profiles(df: DataFrame, names: list[str], key: str = "Metadata_id", branch: str = "branch",
                       metric: str = "metric", value: str = "value") -> DataFrame:
    """Median per (well, branch and metric), one column per feature."""
    return median_profiles(df, [key], F.concat(F.col(branch), F.col(metric)), names, value)


def object_profiles(df: DataFrame, names: list[str], key: str = "Metadata_id", obj: str = "object",
                    branch: str = "branch", metric: str = "metric", value: str = "value") -> DataFrame:
    """Median per (well, object, branch, metric), named ``object_branch_metric``."""
    full = F.concat_ws("_", F.col(obj), F.concat(F.col(branch), F.col(metric)))
    return median_profiles(df, [key], full, names, value)


def site_means(df: DataFrame, names: list[str], key: list[str], name: Column | str,
               value: str = "value") -> DataFrame:
    return pivot_cells(df, key, name, names, F.avg(value))


def packed_profiles(df: DataFrame, key: list[str], name: Column | str, names: list[str],
                    value: str = "value", method: str = "median") -> DataFrame:
    """Long measurements to a packed profile, for feature counts too wide to pivot.

    Features that a key lacks are NULL, as in a pivot.
    """
    known = {n: i for i, n in enumerate(names)}
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    placed = df.withColumn("pos", lookup[as_col(name)]).filter(F.col("pos").isNotNull())
    if method == "median":
        cells = exact_median(placed, [*key, "pos"], value, "cell")
    else:
        cells = placed.groupBy(*key, "pos").agg(F.avg(value).alias("cell"))
    held = F.map_from_entries(F.collect_list(F.struct("pos", "cell")))
    slots = F.array(*[F.lit(i) for i in range(len(names))])
    return cells.groupBy(*key).agg(held.alias("__m")).select(
        *key, F.transform(slots, lambda i: F.col("__m")[i]).alias(C.FEATURES))


def object_counts(df: DataFrame, key: list[str], objects: dict[str, str], obj: str = "object",
                  label: str = "label", within: list[str] | None = None) -> DataFrame:
    """Distinct labels per object kind.

    Labels restart in every file; ``within`` (e.g. the file name) makes them distinct
    per file, without it a label number counts once per key.
    """
    ident = F.struct(*[F.col(c) for c in (within or [])], F.col(label))
    return df.groupBy(*key).agg(*[
        F.count_distinct(F.when(F.col(obj) == kind, ident)).alias(out) for kind, out in objects.items()])


def tile_means(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Mean over tiles of a wide embedding table."""
    return df.groupBy(*key).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in columns])


def diagonal_union(frames: list[DataFrame]) -> DataFrame:
    """Union of tables whose columns differ; absent ones are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def group_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise mean, folded on the map side."""
    mean = Summarizer.metrics("mean").summary(array_to_vector(C.FEATURES))["mean"]
    return df.groupBy(*keys).agg(vector_to_array(mean).alias(C.FEATURES))


def group_medians(df: DataFrame, keys: list[str], in_memory: bool | None = None) -> DataFrame:
    """Element-wise exact median per group: NULL items are left out, NaN is the largest value, NULL keys are a key.

    While every group provably fits a task, many groups share one task and numpy takes
    the medians. Beyond that the long form is used, whose hot groups are ranged.
    """
    packed = df.select(*keys, C.FEATURES)
    biggest = None
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if in_memory is None:
        first = df.select(F.size(C.FEATURES)).first()
        biggest, rows = group_sizes(df, keys)
        width = 0 if first is None else max(first[0] or 0, 1)
        in_memory = biggest * width * 8 <= TASK_BYTES
        buckets = max(buckets, 2 * rows * width * 8 // TASK_BYTES)
    if not in_memory:
        long = to_long(packed, keys)
        return from_long(exact_median(long, [*keys, "pos"], probe=biggest), keys, "median")
    keyed = packed.withColumn("__pool", text_key(keys)).withColumn(
        "__bucket", F.pmod(F.xxhash64("__pool"), F.lit(buckets)))
    # medians may be NULL where the features may not
    schema = T.StructType([*packed.schema.fields[:-1], T.StructField(C.FEATURES, T.ArrayType(T.DoubleType(), True))])

    def run(table: pa.Table) -> pa.Table:
        codes = table.column("__pool").combine_chunks().dictionary_encode()
        codes = codes.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.nonzero(np.diff(codes[order], prepend=-1))[0]
        medians = column_medians(table.column(C.FEATURES), np.split(order, starts[1:]))
        first = table.select(keys).take(pa.array(order[starts]))
        return pa.table([*first.columns, medians], names=[*keys, C.FEATURES])

    return keyed.groupBy("__bucket").applyInArrow(run, schema)


def aggregate_strata(df: DataFrame, strata: list[str], method: str = "median",
                     keep: list[str] | None = None, order: str | None = None) -> DataFrame:
    """One profile per stratum; other metadata comes from the first row by ``order``."""
    keep = [c for c in df.columns if c not in (*strata, C.FEATURES)] if keep is None else keep
    values = group_medians(df, strata) if method == "median" else group_means(df, strata)
    if not keep:
        return values
    first = df.groupBy(*strata).agg(*[
        F.min_by(F.col(c), F.col(order) if order else F.col(c)).alias(c) for c in keep])
    return first.join(values, strata)


def consensus(df: DataFrame, compound: str = C.PERT, group: str = C.GROUP,
              extra: list[str] | None = None) -> DataFrame:
    """Median profile per (compound, group); ``extra`` columns join the key."""
    return group_medians(df, [compound, group, *(extra or [])])


def plate_manifest(df: DataFrame) -> DataFrame:
    return df.groupBy(*C.PLATE_PARTS).agg(
        F.count_distinct(C.WELL).alias("well_count"), F.count(F.lit(1)).alias("site_count"))


def count_features(df: DataFrame, cells: str = "Metadata_n_cells", nuclei: str | None = "Metadata_n_nuclei") -> DataFrame:
    """Baseline profiles whose only features are object counts."""
    picks = [F.col(cells).cast("double").alias("Cells_Count")]
    if nuclei and nuclei in df.columns:
        picks.append(F.col(nuclei).cast("double").alias("Nuclei_Count"))
    meta = [c for c in df.columns if c.startswith(C.META) and c not in (cells, nuclei)]
    return df.select(*meta, *picks)
