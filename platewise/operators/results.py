"""Analytics over sweep results: selection, deltas against a baseline, ranks."""

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.expressions import average_rank, clean_number, is_valid, null_safe_all, safe_corr
from platewise.functions.stats import correlation_p

# Model families by the start of a model name, and codecs from best to worst.
FAMILIES = {
    "cellprofiler_lite": "cellprofiler_lite", "dinov2_random_lite": "dinov2_random_lite",
    "dinov2_lite": "dinov2_lite", "morphem_lite": "morphem_lite",
    "subcell__clip01_lite": "subcell__clip01_lite", "subcell_lite": "subcell_lite",
    "openphenom_lite": "openphenom_lite", "cellprofiler": "cellprofiler",
    "openphenom_stdscale_false": "openphenom_stdscale_false", "openphenom_stdscale": "openphenom_stdscale",
    "openphenom_nonclip": "openphenom_nonclip", "openphenom_8clip_std": "openphenom_8clip_std",
    "openphenom": "openphenom", "morphem": "morphem", "subcell_wrongchannels": "subcell_wrongchannels",
    "subcell__clip01": "subcell__clip01", "subcell__nonstd": "subcell__nonstd",
    "subcell_nonstd": "subcell_nonstd", "subcell": "subcell", "cell_count_lite": "cell_count_lite",
    "cell_count": "cell_count", "dinov2_490": "dinov2_490", "dinov2_random": "dinov2_random",
    "dinov2_cl": "dinov2", "dinov2": "dinov2",
}
CODEC_ORDER = ["zstd", "raw", "hq", "mq", "d20"]
KEYS = ["family", "codec", "config"]


# ---- names -------------------------------------------------------------------------


def with_family(df: DataFrame, prefixes: DataFrame, model: str = "model") -> DataFrame:
    """Family of the longest matching prefix; ``prefixes`` is a small ``(prefix, family)`` table.

    Candidates come from an equality join on the name's leading parts, not from comparing
    every name with every prefix.
    """
    name = F.lower(model)
    parts = F.split(name, "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    names = df.select(model).distinct()
    hits = names.withColumn("prefix", F.explode(heads)).join(prefixes, "prefix")
    best = hits.groupBy(model).agg(F.max_by("family", F.length("prefix")).alias("family"))
    return df.join(best, model, "left")


def family_table(spark, families: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((families or FAMILIES).items()), ["prefix", "family"])


def codec_of(model: Column | str) -> Column:
    """Codec part of ``family_..._<codec>_raw``; plain names are raw."""
    model = F.col(model) if isinstance(model, str) else model
    codec = F.regexp_extract(model, "(zstd|jpegxl_lossy_[a-z0-9]+)", 1)
    short = F.regexp_replace(codec, "^jpegxl_lossy_", "")
    return F.when(short == "", "raw").otherwise(short)


def short_model(folder: Column | str, dataset: str) -> Column:
    """Model name of a feature folder ``<model>_<dataset>_[updated_]<codec>_features``.

    ``dataset`` is a pattern for the dataset tag in the folder name.
    """
    folder = F.col(folder) if isinstance(folder, str) else folder
    pattern = f"^(.+?)_{dataset}_(?:updated_)?(.*?)(?:_features)?$"
    model = F.regexp_extract(folder, pattern, 1)
    codec = F.regexp_extract(folder, pattern, 2)
    return F.when(model == "", folder).when(codec == "", model).otherwise(F.concat_ws("_", model, codec))


def config_settings(config: Column | str) -> dict[str, Column]:
    """Decode a configuration name into its settings."""
    config = F.col(config) if isinstance(config, str) else config
    pick = lambda pattern, kind: F.nullif(F.regexp_extract(config, pattern, 1), F.lit("")).cast(kind)
    part = lambda name: config.rlike(f"(^|__){name}")
    sphere = r"(?:^|__)ZCA-cor_(?:global_)?(?:ctrl|all)_e([0-9.]+)"
    eps_text = F.regexp_extract(config, sphere, 1)
    eps = F.nullif(eps_text, F.lit("")).cast("double")
    efaar = part("tvn_efaar")
    return {
        "norm_method": F.when(part("robustmad"), "robustmad").when(part("std"), "standardize").otherwise("unknown"),
        "outlier_cutoff": pick(r"(?:^|__)outlier(\d+)(?:__|$)", "int"),
        "use_int": config.rlike("(^|__)INT(__|$)"),
        "prune_thresh": pick(r"(?:^|__)prune([0-9.]+)(?:__|$)", "double"),
        "use_pca": part("pca"),
        "pca_components": pick(r"(?:^|__)pca(\d+)(?:__|$)", "int"),
        "batch_method": (
            F.when(part("ZCA-cor_global_"), "spherize_global").when(part("ZCA-cor_"), "spherize")
            .when(part("cascade_tvn"), "cascade_tvn").when(efaar, "tvn_efaar")
            .when(part("tvn_original"), "tvn_original").otherwise("none")),
        "spherize_fit": F.nullif(F.regexp_extract(config, r"(?:^|__)ZCA-cor_(?:global_)?(ctrl|all)_e", 1), F.lit("")),
        "spherize_epsilon": F.when(~eps_text.contains(".") & (eps >= 2), F.pow(F.lit(10.0), -eps)).otherwise(eps),
        "tvn_epsilon": pick(r"(?:^|__)tvn_efaar_e([0-9.]+)", "double"),
        "tvn_efaar_n_components": F.when(efaar, F.coalesce(
            pick(r"(?:^|__)tvn_efaar_e[0-9.]+_c(\d+)", "int"), F.lit(128))),
        "tvn_original_k": pick(r"(?:^|__)tvn_original_k(\d+)", "int"),
        "tvn_cascade_k1": pick(r"(?:^|__)cascade_tvn_k(\d+)_k\d+", "int"),
        "tvn_cascade_k2": pick(r"(?:^|__)cascade_tvn_k\d+_k(\d+)", "int"),
    }


def quality_rank(codec: Column | str, order: list[str] | None = None) -> Column:
    """Position in the quality order; unknown codecs get NULL, to be sorted last."""
    codec = F.col(codec) if isinstance(codec, str) else codec
    pairs = [F.lit(x) for i, c in enumerate(order or CODEC_ORDER) for x in (c, i)]
    return F.create_map(*pairs)[codec]


def sort_by_quality(df: DataFrame, codec: str = "codec", order: list[str] | None = None) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(quality_rank(codec, order)), codec)


# ---- filters -----------------------------------------------------------------------


def without_degenerate(df: DataFrame, config: str = "config") -> DataFrame:
    """Spherize without PCA is degenerate."""
    settings = config_settings(config)
    return df.filter(~(settings["batch_method"].startswith("spherize") & ~settings["use_pca"]))


def filter_results(df: DataFrame, only_families: list[str] | None = None,
                   exclude_families: list[str] | None = None, exclude_codecs: list[str] | None = None) -> DataFrame:
    if only_families:
        df = df.filter(F.col("family").isin(only_families))
    if exclude_families:
        df = df.filter(~F.col("family").isin(exclude_families))
    if exclude_codecs:
        df = df.filter(~F.col("codec").isin(exclude_codecs))
    return df


def panel(df: DataFrame, task: str, modality: str | None, group: str | None) -> DataFrame:
    """Rows of one panel, where an absent modality or group is itself a value."""
    return df.filter((F.col("task") == task) & F.col("modality").eqNullSafe(F.lit(modality))
                     & F.col("group").eqNullSafe(F.lit(group)))


def top_configs(df: DataFrame, metric: str, n: int, keys: list[str] | None = None,
                config: str = "config") -> DataFrame:
    """The n best configurations per key; missing metrics never count."""
    place = F.row_number().over(Window.partitionBy(*(keys or ["family", "codec"])).orderBy(
        F.desc(metric), config))
    return df.filter(is_valid(metric)).withColumn("place", place).filter(F.col("place") <= n)


# ---- scores and selection ------------------------------------------------------------


def score_column(df: DataFrame, mode: str = "balanced", name: str = "score") -> DataFrame:
    """``balanced`` PA·PC/100, ``nap_balanced`` scaled by the table's maxima, ``pc``,
    ``pc_nap``, or ``geometric`` mean of the two NAPs (undefined when one is not positive)."""
    pa, pc = F.col("PA_mean_nap"), F.col("PC_mean_nap")
    if mode == "balanced":
        return df.withColumn(name, F.col("PA") * F.col("PC") / 100)
    if mode == "pc":
        return df.withColumn(name, F.col("PC"))
    if mode == "pc_nap":
        return df.withColumn(name, pc)
    if mode == "geometric":
        return df.withColumn(name, F.when((pa > 0) & (pc > 0), F.sqrt(pa * pc)))
    if mode == "nap_balanced":
        top = df.agg(F.max("PA_mean_nap"), F.max("PC_mean_nap")).first()
        scaled = [c / F.lit(t) if t is not None and t > 0 else c for c, t in zip((pa, pc), top)]
        return df.withColumn(name, scaled[0] * scaled[1])
    raise ValueError(f"unknown score {mode!r}")


def best_of(score: str, config: str) -> Column:
    """Configuration of the highest valid score, ties by name; NULL when none is valid."""
    return F.min(F.when(is_valid(score), F.struct((-F.col(score)).alias("s"), F.col(config).alias("c"))))["c"]


def select_best(df: DataFrame, score: str = "score", mode: str = "per_codec", reference: str = "zstd",
                family: str = "family", codec: str = "codec", config: str = "config") -> DataFrame:
    """One configuration per (family, codec).

    Modes other than ``per_codec`` pin one configuration per family: that of the reference
    codec, of the best codec, or the best on average over codecs. Codecs lacking the pinned
    configuration fall back to their own best.
    """
    rows = df
    if mode == "per_codec":
        pins = None
    elif mode == "zstd_reference":
        pins = df.filter(F.col(codec) == reference).groupBy(family).agg(best_of(score, config).alias("__pin"))
    elif mode == "best_any_codec":
        pins = df.groupBy(family).agg(best_of(score, config).alias("__pin"))
    elif mode == "best_avg_codec":
        means = df.groupBy(family, config).agg(F.avg(clean_number(score)).alias("__mean"))
        pins = means.groupBy(family).agg(best_of("__mean", config).alias("__pin"))
    else:
        raise ValueError(f"unknown selection {mode!r}")
    if pins is not None:
        rows = rows.join(pins, family, "left")
    pinned = F.lit(None).cast("string") if pins is None else F.max(
        F.when(F.col(config) == F.col("__pin"), F.col(config)))
    choice = rows.groupBy(family, codec).agg(F.coalesce(pinned, best_of(score, config)).alias(config))
    return df.join(choice, [family, codec, config], "left_semi")


# ---- deltas ------------------------------------------------------------------------


def baseline_codec(df: DataFrame, preferred: list[str], family: str = "family", codec: str = "codec") -> DataFrame:
    """First codec of the preference list that a family has."""
    rank = quality_rank(codec, preferred)
    known = df.select(family, codec).distinct().filter(rank.isNotNull())
    return known.groupBy(family).agg(F.min_by(codec, rank).alias("baseline"))


def build_deltas(df: DataFrame, value: str, preferred: list[str],
                 keys: tuple[str, ...] = ("config", "task", "modality", "group")) -> DataFrame:
    """Each codec's result minus its family baseline at equal keys, NULL keys being equal."""
    tagged = df.join(baseline_codec(df, preferred), "family")
    base = tagged.filter(F.col("codec") == F.col("baseline")).select(
        "family", *keys, F.col(value).alias("baseline_value")).alias("b")
    rest = tagged.filter(F.col("codec") != F.col("baseline")).alias("o")
    joined = rest.join(base, null_safe_all("o", "b", ["family", *keys]))
    return joined.select("o.family", "o.codec", "o.baseline", *[f"o.{k}" for k in keys], "b.baseline_value",
                         F.col(f"o.{value}").alias("codec_value")).withColumn(
        "delta", F.col("codec_value") - F.col("baseline_value"))


def percent_deltas(deltas: DataFrame, keys: list[str], clip: bool = False) -> DataFrame:
    """Mean, deviation and count of percent deltas; a vanishing baseline gives none.

    ``clip`` raises both sides to at least zero first.
    """
    low = lambda c: F.greatest(F.col(c), F.lit(0.0)) if clip else F.col(c)
    base, value = low("baseline_value"), low("codec_value")
    pct = F.when(F.abs(base) > 1e-12, (value - base) / F.abs(base) * 100)
    return deltas.withColumn("__pct", pct).groupBy(*keys).agg(
        F.avg("__pct").alias("mean"), F.stddev_samp("__pct").alias("std"), F.count("__pct").alias("n"))


def group_deltas(df: DataFrame, metrics: list[str], preferred: list[str]) -> DataFrame:
    """Absolute and percent change of group metrics from the baseline, clipped at zero."""
    long = df.unpivot(["family", "codec"], metrics, "metric", "value").withColumn(
        "value", F.greatest("value", F.lit(0.0)))
    deltas = build_deltas(long, "value", preferred, ("metric",))
    return deltas.withColumn("delta_pct", F.when(
        F.abs("baseline_value") > 1e-12, F.col("delta") / F.abs("baseline_value") * 100))


def table_means(df: DataFrame, value: str = "value") -> DataFrame:
    """Mean over tasks per (model, codec), then the unweighted mean over models per codec."""
    per_task = df.filter(is_valid(value)).groupBy("family", "codec", "task").agg(F.avg(value).alias("m"))
    per_model = per_task.groupBy("family", "codec").agg(F.avg("m").alias("mean_over_tasks"))
    across = per_task.groupBy("codec", "task").agg(F.avg("m").alias("a")).groupBy("codec").agg(
        F.avg("a").alias("codec_mean"))
    return per_model.join(across, "codec")


# ---- axes, ranks, stability ----------------------------------------------------------


def axis_table(df: DataFrame, value: str, drop_orf: bool = False) -> DataFrame:
    """Four task axes and their product per (family, codec, config), in one aggregation."""
    gene = F.lit(True) if not drop_orf else (F.col("modality").isNull() | (F.col("modality") != "orf"))
    axes = {
        "cc": F.col("task") == "CC",
        "gg": (F.col("task") == "GG") & F.col("group").isNull() & gene,
        "cg_div": (F.col("task") == "CG") & (F.col("group") == "group_high") & gene,
        "cg_bio": (F.col("task") == "CG") & (F.col("group") == "group_low") & gene,
    }
    wide = df.groupBy(*KEYS).agg(*[F.avg(F.when(c, F.col(value))).alias(n) for n, c in axes.items()])
    return wide.dropna(subset=list(axes)).withColumn(
        "score", F.col("cc") * F.col("gg") * F.col("cg_div") * F.col("cg_bio"))


def sweep_summary(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Count, best and mean score per single attribute, all attributes in one pass."""
    long = df.select(score, F.explode(F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("level")) for c in by])).alias("a"))
    return long.groupBy("a.attribute", "a.level").agg(
        F.count(F.lit(1)).alias("n"), F.max(score).alias("best"), F.avg(score).alias("mean"))


def codec_pairs(df: DataFrame, value: str, codecs: list[str], keys: list[str], unit: str = "family") -> DataFrame:
    """Values of every ordered codec pair side by side.

    The pair list is expanded on each row and joined by equality, so only rows that
    belong together meet.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("codec_1"), F.lit(b).alias("codec_2"))
                      for a, b in combinations(codecs, 2)])
    side = lambda end, name: df.withColumn("p", F.explode(F.filter(pairs, lambda p: p[end] == F.col("codec")))).select(
        *keys, unit, "p.codec_1", "p.codec_2", F.col(value).alias(name))
    return side("codec_1", "x").join(side("codec_2", "y"), [*keys, unit, "codec_1", "codec_2"])


def rank_stability(df: DataFrame, value: str, codecs: list[str], keys: list[str] | None = None,
                   least: int = 3) -> DataFrame:
    """Spearman correlation of family scores between codecs, with its p value.

    Ranks are taken among the families both codecs share.
    """
    keys = keys or []
    cell = [*keys, "codec_1", "codec_2"]
    rows = codec_pairs(df.filter(is_valid(value)), value, codecs, keys)
    ranked = rows.withColumn("rx", average_rank(F.col("x"), cell)).withColumn("ry", average_rank(F.col("y"), cell))
    out = ranked.groupBy(*cell).agg(safe_corr("rx", "ry").alias("__r"), F.count(F.lit(1)).alias("n_models")).filter(
        F.col("n_models") >= least)

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(None if pd.isna(a) else a, int(b)) for a, b in zip(r, n)], dtype="float64")

    return out.select(*cell, clean_number("__r").alias("rho"), "n_models").withColumn(
        "p_value", p_value("rho", "n_models"))


def rank_table(df: DataFrame, value: str, codecs: list[str], unit: str = "family") -> DataFrame:
    """Average rank of each family per codec, highest value first, one column per codec."""
    ranked = df.filter(is_valid(value)).withColumn("rank", average_rank(-F.col(value), ["codec"]))
    return ranked.groupBy(unit).pivot("codec", codecs).agg(F.first("rank"))


def task_ranking(df: DataFrame, value: str, unit: str = "family", task: str = "task") -> DataFrame:
    """Mean over tasks of each unit's value relative to the best unit of the task."""
    top = df.groupBy(task).agg(F.max(value).alias("__top"))
    share = F.when(F.col("__top") != 0, F.col(value) / F.col("__top"))
    return df.join(top, task).groupBy(unit).agg(F.avg(share).alias("score"))


def saturation_curve(df: DataFrame, metric: str, keys: tuple[str, ...] = ("model", "n_actual")) -> DataFrame:
    """Best value per seed, then mean and deviation over seeds."""
    best = df.filter(is_valid(metric)).groupBy(*keys, "seed").agg(F.max(metric).alias("best"))
    return best.groupBy(*keys).agg(F.avg("best").alias("mean"), F.stddev_samp("best").alias("std"),
                                   F.count(F.lit(1)).alias("n_seeds"))


def replace_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which the right side's columns replace equally named ones."""
    return left.drop(*[c for c in right.columns if c not in keys]).join(right, keys, "left")


def full_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "full")
