"""The metric bundle of one normalised profile table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions import linalg
from platewise.operators import retrieval
from platewise.operators.moments import global_moments
from platewise.session import cut_lineage


def scored(ap: DataFrame, by: list[str], null_size: int, seed: int, threshold: float) -> DataFrame:
    maps = retrieval.mean_average_precision(ap, by)
    return cut_lineage(retrieval.with_significance(maps, ap, by, null_size, threshold, seed))


def totals(maps: DataFrame, prefix: str, unit: str) -> DataFrame:
    """Long ``(metric, value)`` rows of an overall summary."""
    one = retrieval.activity_summary(maps.withColumn("__all", F.lit(prefix)), ["__all"], unit)
    names = [c for c in one.columns if c != "__all"]
    return one.select(*[F.col(c).cast("double").alias(f"{prefix}_{c}") for c in names]).unpivot(
        [], [f"{prefix}_{c}" for c in names], "metric", "value")


def by_group(maps: DataFrame, prefix: str, group: str, unit: str) -> DataFrame:
    one = retrieval.activity_summary(maps, [group], unit)
    names = [c for c in one.columns if c != group]
    long = one.select(group, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [group], names, "stat", "value")
    return long.select(F.concat_ws("_", F.lit(prefix), group, "stat").alias("metric"), "value")


def evaluate(df: DataFrame, row_id: str = C.ROW_ID, compound: str = C.PERT, group: str = C.GROUP,
             null_size: int = 10_000, threshold: float = 0.05, seed: int = 0, batch_effects: bool = False,
             pc_groups: list[str] | None = None, min_compounds: int = 3) -> DataFrame:
    """All metrics as ``(metric, value)`` rows.

    Activity, consistency, consistency of the replicable compounds only, the variance of
    the first two components, and optionally both batch effects. With at most two features
    distances are Euclidean.
    """
    df = cut_lineage(df)
    width = df.select(F.size(C.FEATURES)).first()[0]
    metric = "euclidean" if width <= 2 else "cosine"
    pa = scored(retrieval.phenotypic_activity(df, row_id, compound, group, metric=metric),
                [compound, group], null_size, seed, threshold)
    parts = [totals(pa, "PA", compound), by_group(pa, "PA", group, compound)]

    def consistency(rows: DataFrame, prefix: str) -> list[DataFrame]:
        profiles = cut_lineage(retrieval.target_profiles(rows, compound, group, groups=pc_groups))
        if profiles.limit(2).count() < 2:
            return []
        ap = retrieval.phenotypic_consistency(profiles, [group], compound=compound, metric=metric,
                                              min_compounds=min_compounds)
        maps = scored(ap, ["target", group], null_size, seed, threshold)
        return [totals(maps, prefix, "target"), by_group(maps, prefix, group, "target")]

    if C.TARGET_LIST in df.columns:
        parts += consistency(df, "PC")
        active = pa.filter("below_corrected_p").select(compound, group)
        parts += consistency(df.join(active, [compound, group], "left_semi"), "PC_replicable")
    if batch_effects:
        for prefix, ap, by in (
                ("well_effect", retrieval.well_position_effect(df, row_id, compound, group, metric=metric), C.WELL),
                ("plate_effect", retrieval.plate_effect(df, row_id, compound, group, metric=metric), C.PLATE)):
            parts.append(totals(scored(ap, [group, by], null_size, seed, threshold), prefix, by))
    values = linalg.eigen_desc(global_moments(df).cov())[0]
    share = values / values.sum()
    facts = [("PC1_variance", float(share[0])), ("PC2_variance", float(share[1]) if width > 1 else 0.0),
             ("n_features", float(width))]
    parts.append(df.sparkSession.createDataFrame(facts, "metric string, value double"))
    return reduce(DataFrame.unionByName, parts)
