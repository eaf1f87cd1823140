"""Feature selection on packed profiles.

Each operation returns the kept names; statistics come from one aggregation over the
long form, with partial aggregation per (position[, value]).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.expressions import is_valid
from platewise.operators.moments import gram_edges
from platewise.operators.packed import Profiles, to_long

# Name parts that mark positional or technical measurements.
BLOCKLIST = [
    "Location_Center", "Location_Max", "Location_Min", "Number_Object_Number",
    "ExecutionTime", "BoundingBox", "ObjectNumber",
]


def kept(profiles: Profiles, positions: DataFrame) -> list[str]:
    """Names at the given positions; the result is as small as the feature list."""
    keep = {r[0] for r in positions.select("pos").collect()}
    return [n for i, n in enumerate(profiles.names) if i in keep]


def invalid_share(long: DataFrame) -> DataFrame:
    """Share of NULL, NaN and infinite values per position."""
    return long.groupBy("pos").agg(
        (F.count_if(~is_valid("value")) / F.count(F.lit(1))).alias("invalid_share"))


def drop_invalid(profiles: Profiles, cutoff: float = 0.05) -> list[str]:
    return kept(profiles, invalid_share(to_long(profiles.df, [])).filter(F.col("invalid_share") <= cutoff))


def clean_rows(profiles: Profiles, cutoff: float = 0.30) -> Profiles:
    """Drop bad features, then rows with any invalid value left."""
    slim = profiles.keep(drop_invalid(profiles, cutoff))
    return slim.with_df(slim.df.filter(F.forall(C.FEATURES, is_valid)))


def variance_statistics(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, distinct valid values, the two highest value counts, and the NaN-aware variance.

    Values are counted first, so the second aggregation sees each distinct value once and
    only needs the two largest counts.
    """
    keys = keys or ["pos"]
    valid = is_valid("value")
    counted = long.withColumn("value", F.when(valid, F.col("value"))).groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n"))
    top = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value"))
    best = counted.filter("value is not null").withColumn("top", top).filter("top <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("top") == 1, F.col("n"))).alias("first_count"),
        F.max(F.when(F.col("top") == 2, F.col("n"))).alias("second_count"))
    usable = F.when(~F.isnan("value"), F.col("value"))
    whole = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.var_pop(usable).alias("variance"))
    distinct = counted.groupBy(*keys).agg(F.count("value").alias("n_unique"))
    return whole.join(distinct, keys).join(best, keys, "left")


def variance_rule(freq_cut: float = 0.05, unique_cut: float = 0.01, var_threshold: float | None = None) -> Column:
    rule = (F.col("n_unique") > 0) & (F.col("n_unique") / F.col("n_rows") >= unique_cut) & (
        F.col("second_count").isNull() | (F.col("second_count") / F.col("first_count") >= freq_cut))
    if var_threshold is not None:
        rule = rule & is_valid("variance") & (F.col("variance") >= var_threshold)
    return rule


def variance_threshold(profiles: Profiles, freq_cut: float = 0.05, unique_cut: float = 0.01,
                       var_threshold: float | None = None) -> list[str]:
    stats = variance_statistics(to_long(profiles.df, []))
    return kept(profiles, stats.filter(variance_rule(freq_cut, unique_cut, var_threshold)))


def extreme_scores(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Largest absolute z score per position, derived from the raw extremes."""
    usable = F.when(~F.isnan("value"), F.col("value"))
    stats = long.groupBy(*(keys or ["pos"])).agg(
        F.avg(usable).alias("mean"), F.stddev_pop(usable).alias("std"),
        F.min(usable).alias("low"), F.max(usable).alias("high"))
    z = lambda v: F.abs((v - F.col("mean")) / (F.col("std") + F.lit(1e-8)))
    return stats.withColumn("max_z", F.greatest(z(F.col("low")), z(F.col("high"))))


def drop_outliers(profiles: Profiles, cutoff: float = 500.0) -> list[str]:
    scores = extreme_scores(to_long(profiles.df, []))
    return kept(profiles, scores.filter(is_valid("max_z") & (F.col("max_z") <= cutoff)))


def has_part(names: list[str], parts: list[str]) -> set[str]:
    return {n for n in names if any(p in n for p in parts)}


def blocklist(profiles: Profiles, parts: list[str] | None = None) -> list[str]:
    hit = has_part(profiles.names, BLOCKLIST if parts is None else parts)
    return [n for n in profiles.names if n not in hit]


def include_parts(profiles: Profiles, parts: list[str]) -> list[str]:
    hit = has_part(profiles.names, parts)
    return [n for n in profiles.names if n in hit]


def exclude_parts(profiles: Profiles, parts: list[str]) -> list[str]:
    return blocklist(profiles, parts)


def listed_names(profiles: Profiles, path: str, column: str = "feature") -> set[str]:
    """Names of a list file that occur in the table."""
    listed = profiles.df.sparkSession.read.option("header", True).csv(path)
    if column not in listed.columns:
        raise ValueError(f"no column {column!r} in {path}; it has {listed.columns}")
    mine = profiles.df.sparkSession.createDataFrame([(n,) for n in profiles.names], [column])
    return {r[0] for r in mine.join(listed.select(column), column, "left_semi").collect()}


def include_listed(profiles: Profiles, path: str, column: str = "feature") -> list[str]:
    listed = listed_names(profiles, path, column)
    return [n for n in profiles.names if n in listed]


def exclude_listed(profiles: Profiles, path: str, column: str = "feature") -> list[str]:
    listed = listed_names(profiles, path, column)
    return [n for n in profiles.names if n not in listed]


def independent_set(size: int, edges: list[tuple[int, int]]) -> list[int]:
    """Greedy independent set: keep the node of least degree, drop its neighbours.

    The graph has one node per feature, so it is bounded by the feature count.
    """
    around = [set() for _ in range(size)]
    for i, j in edges:
        around[i].add(j)
        around[j].add(i)
    left, chosen = set(range(size)), []
    while left:
        node = min(left, key=lambda v: (len(around[v]), v))
        chosen.append(node)
        gone = around[node] | {node}
        left -= gone
        for v in gone:
            for w in around[v]:
                if w not in gone:
                    around[w].discard(v)
            around[v] = set()
    return sorted(chosen)


def prune_correlated(profiles: Profiles, threshold: float = 0.9) -> list[str]:
    edges = [(i, j) for i, j, _ in gram_edges(profiles.df, threshold)]
    return [profiles.names[i] for i in independent_set(len(profiles.names), edges)]


OPERATIONS: dict[str, Callable[..., list[str]]] = {
    "variance_threshold": variance_threshold,
    "drop_outliers": lambda p, outlier_cutoff=500.0: drop_outliers(p, outlier_cutoff),
    "drop_na_columns": lambda p, threshold=0.05: drop_invalid(p, threshold),
    "blocklist": lambda p, blocklist_=None: blocklist(p, blocklist_),
    "include_features": lambda p, patterns=(): include_parts(p, list(patterns)),
    "exclude_features": lambda p, patterns=(): exclude_parts(p, list(patterns)),
    "include_from_csv": lambda p, csv_path, column="feature": include_listed(p, csv_path, column),
    "exclude_from_csv": lambda p, csv_path, column="feature": exclude_listed(p, csv_path, column),
    "prune_correlated": prune_correlated,
}
DEFAULT_OPERATIONS = [
    {"name": "variance_threshold", "freq_cut": 0.05, "unique_cut": 0.01},
    {"name": "drop_outliers", "outlier_cutoff": 500},
]


def filter_features(profiles: Profiles, operations: list[dict] | None = None) -> tuple[Profiles, list[dict]]:
    """Run operations in order; one that would remove everything restores all features.

    Returns the projected profiles and a report of each step.
    """
    report = []

    def step(names: list[str], op: dict) -> list[str]:
        params = {("blocklist_" if k == "blocklist" else k): v for k, v in op.items() if k != "name"}
        left = OPERATIONS[op["name"]](profiles.keep(names), **params) if names else []
        restored = not left and bool(names)
        report.append({"name": op["name"], "before": len(names), "after": len(left), "restored": restored})
        return list(profiles.names) if restored else left

    names = reduce(step, DEFAULT_OPERATIONS if operations is None else operations, list(profiles.names))
    return profiles.keep(names), report


# ---- object filters on long measurements ----------------------------------------------

# The four bounding-box measurements.
BOX = {"minr": "BoundingBoxMinimum_Y", "minc": "BoundingBoxMinimum_X",
       "maxr": "BoundingBoxMaximum_Y", "maxc": "BoundingBoxMaximum_X"}


def interior_objects(long: DataFrame, file: str = "filename", ident: list[str] | None = None,
                     metric: str = "metric", value: str = "value", box: dict[str, str] | None = None) -> DataFrame:
    """Measurements of objects that do not touch the image border.

    The box of an object comes from its four box measurements; the image extent is the
    largest box edge of the file. Both are aggregations, joined back as a semi join.
    """
    ident = ident or ["Metadata_id", file, "label", "object"]
    box = BOX if box is None else box
    edge = lambda name: F.max(F.when(F.col(metric) == box[name], F.col(value)))
    boxes = long.groupBy(*ident).agg(*[edge(n).alias(n) for n in box])
    extent = boxes.groupBy(file).agg(F.max("maxr").alias("rows"), F.max("maxc").alias("cols"))
    inside = boxes.join(extent, file).filter("minr > 0 and minc > 0 and maxr < rows and maxc < cols")
    return long.join(inside.select(*ident), ident, "left_semi")


def large_objects(long: DataFrame, least: float, ident: list[str] | None = None, metric: str = "metric",
                  value: str = "value", size: str = "EquivalentDiameter") -> DataFrame:
    """Measurements of objects whose diameter is at least ``least``."""
    ident = ident or ["Metadata_id", "filename", "label", "object"]
    big = long.filter(F.col(metric) == size).groupBy(*ident).agg(F.max(value).alias("d")).filter(
        F.col("d") >= least)
    return long.join(big.select(*ident), ident, "left_semi")


def typical_sites(counts: DataFrame, percentile: float, count: str = "n_cells",
                  by: list[str] | None = None) -> DataFrame:
    """Sites whose cell count lies between a low and the matching high percentile."""
    low, high = percentile / 100, 1 - percentile / 100
    keys = by or ["__all"]
    rows = counts if by else counts.withColumn("__all", F.lit(0))
    limits = rows.groupBy(*keys).agg(
        F.percentile(count, F.lit(low)).alias("__low"), F.percentile(count, F.lit(high)).alias("__high"))
    return rows.join(limits, keys).filter(
        F.col(count).between(F.col("__low"), F.col("__high"))).select(*counts.columns)
