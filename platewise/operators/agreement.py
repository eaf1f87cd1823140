"""Agreement of features between data variants and between replicate wells."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.expressions import average_rank, clean_number, exact_std, safe_corr
from platewise.functions.naming import feature_group
from platewise.operators.blocks import exact_median, largest_group, running_totals
from platewise.operators.moments import global_moments
from platewise.operators.packed import Profiles
from platewise.session import cut_lineage


def cell_features(long: DataFrame, object_type: str = "cell") -> DataFrame:
    """Per-cell measurements with one name each.

    Shape measurements are the same in every channel and come from channel 0; all others
    carry their channel.
    """
    channel = F.regexp_extract("branch", r"^(\d+)/", 1)
    kind = F.regexp_extract("branch", "/max/(.+)$", 1)
    shape = kind.isin("sizeshape", "ferret")
    return long.filter((F.col("object") == object_type) & (~shape | (channel == "0"))).withColumn(
        "feature", F.when(shape, F.col("metric")).otherwise(F.concat_ws("_", channel, "metric")))


def nearest_threshold(mapping: DataFrame, thresh: float = 0.5) -> DataFrame:
    """Matched pairs at the stored threshold closest to ``thresh``."""
    gap = F.abs(F.col("thresh") - F.lit(thresh))
    best = mapping.agg(F.min_by("thresh", F.struct(gap, "thresh")).alias("thresh"))
    kept = mapping.join(best, "thresh", "left_semi")
    return kept.filter(F.col("match_type").isin("TP", "BELOW_THRESH")).select(
        "source_id", "file", "gt_id", "pred_id", "iou_score")


def matched_features(reference: DataFrame, mapping: DataFrame, variant: DataFrame,
                     site: list[str] | None = None) -> DataFrame:
    """Long reference and variant measurements of matched objects, all sites at once.

    Both inputs are ``(site..., label, feature, value)``.
    """
    site = site or ["source_id", "file"]
    left = reference.select(*site, F.col("label").alias("gt_id"), "feature", F.col("value").alias("value_ref"))
    extra = [c for c in variant.columns if c not in (*site, "label", "feature", "value")]
    right = variant.select(*site, *extra, F.col("label").alias("pred_id"), "feature", F.col("value").alias("value_codec"))
    return left.join(mapping.select(*site, "gt_id", "pred_id"), [*site, "gt_id"]).join(
        right, [*site, "pred_id", "feature"])


def pair_correlation(pairs: DataFrame, keys: list[str], a: str = "value_ref", b: str = "value_codec",
                     medians: bool = True) -> DataFrame:
    """Pearson per key on pairwise complete values, with diagnostics.

    Fewer than two pairs or a constant side give NULL.
    """
    both = pairs.withColumns({"__a": clean_number(a), "__b": clean_number(b)})
    ok = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    x, y = F.when(ok, F.col("__a")), F.when(ok, F.col("__b"))
    out = [
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"),
        F.avg(x).alias("mean_ref"), F.avg(y).alias("mean_codec"),
        exact_std(x).alias("std_ref"), exact_std(y).alias("std_codec"),
        F.covar_pop(x, y).alias("covariance"), safe_corr(x, y).alias("__r")]
    agg = both.groupBy(*keys).agg(*out)
    if medians:
        complete = both.filter(ok)
        probe = largest_group(complete, keys)
        for side, name in (("__a", "median_ref"), ("__b", "median_codec")):
            agg = agg.join(exact_median(complete, keys, side, name, probe=probe), keys, "left")
    defined = (F.col("n_valid") >= 2) & (F.col("std_ref") > 0) & (F.col("std_codec") > 0)
    return agg.withColumn("r", F.when(defined, clean_number("__r"))).withColumn(
        "nan_rate", 1 - F.col("n_valid") / F.col("n")).drop("__r")


def site_medians(pairs: DataFrame, site: list[str], keys: list[str]) -> DataFrame:
    """Median of both sides per site before correlating."""
    return pairs.groupBy(*site, *keys).agg(
        F.median("value_ref").alias("value_ref"), F.median("value_codec").alias("value_codec"))


def match_rate(reference: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Share of reference objects that found a partner."""
    total = reference.select(*keys, "source_id", "file", "label").distinct().groupBy(*keys).count()
    found = mapping.groupBy(*keys).agg(F.count_distinct("source_id", "file", "gt_id").alias("matched"))
    return total.join(found, keys, "left").select(
        *keys, F.col("count").alias("n_objects"), F.coalesce("matched", F.lit(0)).alias("matched"),
        (F.coalesce("matched", F.lit(0)) / F.col("count")).alias("match_rate"))


def rank_features(stats: DataFrame, codec: str = "codec", feature: str = "feature", r: str = "r") -> DataFrame:
    """Features present in every codec, ranked by mean correlation.

    Also carries the spread between codecs, to list large differences from.
    """
    n_codecs = stats.select(codec).distinct().count()
    agg = stats.groupBy(feature).agg(
        F.count_distinct(codec).alias("n"), F.avg(r).alias("mean_r"), F.max(r).alias("__hi"), F.min(r).alias("__lo"))
    common = agg.filter(F.col("n") == n_codecs)
    return common.select(feature, "mean_r", (F.col("__hi") - F.col("__lo")).alias("spread"))


def level_differences(cell: DataFrame, site: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """Features whose cell-level and site-level correlations differ by more than ``least``."""
    both = cell.select(*keys, F.col("r").alias("r_cell")).join(site.select(*keys, F.col("r").alias("r_site")), keys)
    return both.withColumn("mean_r", (F.col("r_cell") + F.col("r_site")) / 2).withColumn(
        "difference", F.col("r_site") - F.col("r_cell")).filter(F.abs("difference") > least)


def weak_cause(stats: DataFrame, feature: str = "feature") -> DataFrame:
    """Why a correlation is near zero. The thresholds."""
    low_std = F.least("std_ref", "std_codec")
    shift = F.abs(F.col("mean_ref") - F.col("mean_codec")) / F.greatest(F.col("std_ref"), F.lit(1e-10))
    spread = F.col("std_ref") * F.col("std_codec")
    noise = (
        F.when(F.col(feature).contains("Phase"), "circular")
        .when(F.col(feature).rlike("Frac|RadialDistribution"), "quantised")
        .otherwise("noisy"))
    cause = (
        F.when(low_std < 1e-10, "constant")
        .when(low_std < 1e-6, "near constant")
        .when(shift > 3, "mean shift")
        .when(F.col("nan_rate") > 0.05, "many missing")
        .when(F.abs("covariance") < spread * 0.01, noise)
        .otherwise("orthogonal"))
    return stats.filter(F.abs(F.coalesce("r", F.lit(0.0))) < 0.01).withColumn("cause", cause)


def table_correlation(pairs: DataFrame, key: str, site: str = "site", feature: str = "feature",
                      cutoff: float = 0.30) -> DataFrame:
    """Pearson per (codec, feature) on complete cases of the whole table.

    Features missing in more than ``cutoff`` of the sites go first; then sites with any
    missing value among the remaining features go as a whole.
    """
    rows = pairs.withColumns({"value_ref": clean_number("value_ref"), "value_codec": clean_number("value_codec")})
    missing = F.col("value_ref").isNull() | F.col("value_codec").isNull()
    sites = rows.groupBy(key).agg(F.count_distinct(site).alias("__sites"))
    have = rows.groupBy(key, feature).agg(
        F.count("value_ref").alias("__a"), F.count("value_codec").alias("__b")).join(sites, key)
    floor = F.floor(F.lit(1 - cutoff) * F.col("__sites"))
    good = have.filter((F.col("__a") >= floor) & (F.col("__b") >= floor)).select(key, feature)
    n_good = good.groupBy(key).agg(F.count(F.lit(1)).alias("__need"))
    kept = rows.join(good, [key, feature], "left_semi")
    whole = kept.groupBy(key, site).agg(F.count_if(~missing).alias("__have")).join(n_good, key).filter(
        F.col("__have") == F.col("__need")).select(key, site)
    return kept.join(whole, [key, site], "left_semi").groupBy(key, feature).agg(
        safe_corr("value_ref", "value_codec").alias("corr"), F.count(F.lit(1)).alias("size"))


# ---- replicate wells ---------------------------------------------------------------


def replicate_wells(wells: DataFrame, plate: str, treatment: str, well: str) -> DataFrame:
    """First two wells, in name order, of each (plate, treatment) that has two."""
    pairs = wells.select(plate, treatment, well).distinct()
    place = F.row_number().over(Window.partitionBy(plate, treatment).orderBy(well))
    first = pairs.withColumn("place", place).filter("place <= 2")
    two = first.groupBy(plate, treatment).agg(F.max("place").alias("__n")).filter("__n = 2")
    return first.join(two, [plate, treatment], "left_semi").withColumn(
        "side", F.when(F.col("place") == 1, "a").otherwise("b")).drop("place")


def distribution_distance(long: DataFrame, keys: list[str], side: str = "side", value: str = "value",
                          least: int = 5) -> DataFrame:
    """KS, Cohen's d, scaled Wasserstein and variance ratio between two sides.

    Values are counted per side first; both distances then come from running counts over
    the merged distinct values.
    """
    rows = long.filter(F.col(value).isNotNull() & ~F.isnan(value))
    is_a, is_b = F.col(side) == "a", F.col(side) == "b"
    x, y = F.when(is_a, F.col(value)), F.when(is_b, F.col(value))
    # partial variances of a constant need not merge to zero
    spread = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) > 1), F.lit(0.0)).otherwise(F.var_samp(c))
    shape = rows.groupBy(*keys).agg(
        F.count(x).alias("n_a"), F.count(y).alias("n_b"), F.avg(x).alias("__ma"), F.avg(y).alias("__mb"),
        spread(x).alias("__va"), spread(y).alias("__vb"))
    # the counted values are read twice: to find the largest key and to run over them
    steps = cut_lineage(rows.groupBy(*keys, F.col(value).alias("__v")).agg(
        F.count_if(is_a).alias("a"), F.count_if(is_b).alias("b")))
    run = running_totals(steps, keys, "__v", ["a", "b"], "__next").join(shape, keys)
    gap = F.abs(F.col("run_a") / F.greatest("n_a", F.lit(1)) - F.col("run_b") / F.greatest("n_b", F.lit(1)))
    width = F.coalesce(F.col("__next") - F.col("__v"), F.lit(0.0))
    carried = ["n_a", "n_b", "__ma", "__mb", "__va", "__vb"]
    out = run.groupBy(*keys).agg(F.max(gap).alias("__ks"), F.sum(gap * width).alias("__w"),
                                 *[F.first(c).alias(c) for c in carried])
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    pooled = (F.col("__va") + F.col("__vb")) / 2
    low, high = F.least("__va", "__vb"), F.greatest("__va", "__vb")
    d = F.when(pooled > 0, F.abs(F.col("__ma") - F.col("__mb")) / F.sqrt(pooled)).otherwise(0.0)
    return out.select(
        *keys, "n_a", "n_b", F.when(enough, F.col("__ks")).alias("ks_stat"),
        F.when(enough, d).alias("cohens_d"),
        F.when(enough & (pooled > 1e-30), F.col("__w") / F.sqrt(pooled)).alias("wasserstein_norm"),
        F.when(enough & (low > 1e-30), F.least(high / low, F.lit(100.0))).alias("variance_ratio"))


def spearman(pairs: DataFrame, keys: list[str], a: str, b: str, least: int) -> DataFrame:
    """Spearman correlation per key from average ranks of complete pairs."""
    rows = pairs.filter(clean_number(a).isNotNull() & clean_number(b).isNotNull())
    ranked = rows.withColumn("__ra", average_rank(F.col(a), keys)).withColumn(
        "__rb", average_rank(F.col(b), keys))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr("__ra", "__rb").alias("__r")).select(
        *keys, "n", F.when(F.col("n") >= least, clean_number("__r")).alias("rho"))


def well_medians(long: DataFrame, keys: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """Both wells' medians per (keys) in one row."""
    x = F.when(F.col(side) == "a", clean_number(value))
    y = F.when(F.col(side) == "b", clean_number(value))
    return long.groupBy(*keys).agg(F.median(x).alias("median_a"), F.median(y).alias("median_b"))


def well_profile_correlation(medians: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Spearman over features between two replicate wells."""
    return spearman(medians, keys, "median_a", "median_b", least)


def replicate_correlation(medians: DataFrame, keys: list[str], feature: str = "feature", least: int = 5) -> DataFrame:
    """Spearman per feature across replicate groups, with the green and red lists marked."""
    out = spearman(medians, [*keys, feature], "median_a", "median_b", least).filter(F.col("n") >= least)
    listing = F.when(F.col("rho") >= 0.9, "green").when(F.col("rho") < 0.5, "red")
    return out.withColumn("feature_group", feature_group(feature)).withColumn("listing", listing)


def codec_delta(metrics: DataFrame, keys: list[str], reference: str, values: list[str],
                codec: str = "codec") -> DataFrame:
    """Difference of each codec's metrics from the reference codec's."""
    base = metrics.filter(F.col(codec) == reference).select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    joined = metrics.filter(F.col(codec) != reference).join(base, keys)
    return joined.select(*keys, codec, *[(F.col(v) - F.col(f"__{v}")).alias(f"delta_{v}") for v in values])


def feature_similarity(profiles: Profiles) -> DataFrame:
    """Mean, deviation and extremes of each feature's cosine similarity to all others.

    The d-by-d similarity comes from one pass of moments; averaged by base name.
    """
    df = profiles.df.select(F.transform(C.FEATURES, lambda x: F.coalesce(clean_number(x), F.lit(0.0))).alias(C.FEATURES))
    m = global_moments(df)
    gram = m.scatter + m.n * np.outer(m.mean, m.mean)
    norm = np.sqrt(np.maximum(np.diag(gram), 0.0))
    cos = gram / np.outer(np.where(norm == 0, 1, norm), np.where(norm == 0, 1, norm))
    np.fill_diagonal(cos, np.nan)
    rows = [(n, float(np.nanmean(r)), float(np.nanstd(r)), float(np.nanmax(r)), float(np.nanmin(r)))
            for n, r in zip(profiles.names, cos)]
    table = profiles.df.sparkSession.createDataFrame(
        rows, "full_feature string, sim_mean double, sim_std double, sim_max double, sim_min double")
    base = F.element_at(F.split("full_feature", "/"), -1)
    return table.groupBy(base.alias("feature")).agg(
        *[F.avg(c).alias(c) for c in ("sim_mean", "sim_std", "sim_max", "sim_min")])


def correlation_pivot(corr: DataFrame, rows: str, columns: str, names: list[str], how: str = "median") -> DataFrame:
    agg = F.median("corr") if how == "median" else F.avg("corr")
    return corr.groupBy(rows).pivot(columns, names).agg(agg)


def cross_well_summary(metrics: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    values = values or ["ks_stat", "cohens_d", "wasserstein_norm", "variance_ratio"]
    return metrics.groupBy(*keys).agg(
        *[F.avg(v).alias(f"mean_{v}") for v in values], *[F.median(v).alias(f"median_{v}") for v in values])


def reference_ranking(metrics: DataFrame, reference: str, value: str, codec: str = "codec",
                      feature: str = "feature", keep: int | None = None) -> DataFrame:
    """Features by the mean metric of the reference codec, best first."""
    out = metrics.filter(F.col(codec) == reference).groupBy(feature).agg(F.avg(value).alias("mean_value")).orderBy(
        F.asc_nulls_last("mean_value"), feature)
    return out if keep is None else out.limit(keep)


def matched_sites(reference: DataFrame, variant: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files of a variant that match a file of the reference by source and name; of repeated ones the last path counts."""
    keys = keys or ["source_id", "file"]
    paths = variant.groupBy(*keys).agg(F.max("path").alias("variant_path"))
    return reference.select(*keys, F.col("path").alias("reference_path")).join(paths, keys)


def joined_statistics(statistics: dict[str, DataFrame], feature: str = "feature", keys: list[str] | None = None) -> DataFrame:
    """One row per feature that all statistics tables have; their columns get the table's name as prefix."""
    keys, out = [feature, *(keys or [])], None
    for name, df in statistics.items():
        own = df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])
        out = own if out is None else out.join(own, keys)
    return out
