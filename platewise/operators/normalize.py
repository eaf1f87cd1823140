"""Normalisation, batch correction and dimensionality reduction of packed profiles.

Every model is a table of per-batch statistics from partial aggregation. ``batch_col``
of ``None`` means one global batch; ``control`` is the flag column of the rows to fit on.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions import linalg
from platewise.functions.arrow import list_column, matrix_of
from platewise.functions.expressions import normal_quantile, row_norm
from platewise.operators.blocks import exact_median, largest_group, ordinal_rank, with_block
from platewise.operators.factors import Factor, factor_table, factors_of, global_factor
from platewise.operators.moments import Moments, global_moments, moment_table, moments_of, pilot_of
from platewise.operators.packed import from_long, to_long

EPSILON = 1e-18
IN_MEMORY_GROUP = 128 << 20
BAND_BYTES = 16 << 20  # features of a group that one call holds, where the group is larger
CLOSURE_MODELS = 64 << 20
NO_BATCH = "\u0000no batch"


def batch_key(batch_col: str | None) -> Column:
    """The batch as text; rows without a batch form one of their own."""
    return F.lit("all") if not batch_col else F.coalesce(F.col(batch_col).cast("string"), F.lit(NO_BATCH))


def fit_rows(df: DataFrame, batch_col: str | None, control: str | None) -> DataFrame:
    """Rows to fit on: controls, or the whole batch where it has none."""
    keyed = df.select(batch_key(batch_col).alias("grp"), C.FEATURES,
                      (F.lit(True) if control is None else F.col(control)).alias("fit"))
    if control is None:
        return keyed.drop("fit")
    bare = keyed.groupBy("grp").agg(F.max(F.col("fit").cast("int")).alias("any"))
    without = bare.filter(F.coalesce("any", F.lit(0)) == 0).select("grp")
    return keyed.filter("fit").drop("fit").unionByName(
        keyed.join(without, "grp", "left_semi").drop("fit"))


def scale_by(df: DataFrame, model: DataFrame, batch_col: str | None) -> DataFrame:
    """(x - centre) / (scale + epsilon) with per-batch vectors."""
    out = df.withColumn("grp", batch_key(batch_col)).join(model, "grp")
    moved = F.zip_with(C.FEATURES, "center", lambda x, c: x - c)
    return out.withColumn(
        C.FEATURES, F.zip_with(moved, "scale", lambda x, s: x / (s + F.lit(EPSILON)))
    ).drop("grp", "center", "scale")


def standard_model(df: DataFrame, batch_col: str | None, control: str | None) -> DataFrame:
    """``grp, center, scale``: mean and population deviation, in one aggregation.

    Controls and other rows are summarised apart; a batch without controls has only the
    other rows, which then are the whole batch.
    """
    fit = F.lit(True) if control is None else F.coalesce(F.col(control), F.lit(False))
    keyed = df.select(batch_key(batch_col).alias("grp"), fit.alias("fit"), array_to_vector(C.FEATURES).alias("v"))
    stats = keyed.groupBy("grp", "fit").agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    n = F.col("s.count").cast("double")
    each = stats.select(
        "grp", "fit", vector_to_array(F.col("s.mean")).alias("center"),
        F.transform(vector_to_array(F.col("s.variance")), lambda v: F.sqrt(v * (n - 1) / n)).alias("scale"))
    best = F.max_by(F.struct("center", "scale"), "fit")
    return each.groupBy("grp").agg(best.alias("m")).select("grp", "m.center", "m.scale")


def standardize(df: DataFrame, batch_col: str | None = C.PLATE, control: str | None = C.NEGCON) -> DataFrame:
    return scale_by(df, standard_model(df, batch_col, control), batch_col)


def numpy_mad(table: pa.Table, factor: float) -> pa.Table:
    x = matrix_of(table.column("features"))
    center = np.median(x, axis=0)
    spread = np.median(np.abs(x - center), axis=0) * factor
    return pa.table({"grp": table.column("grp").slice(0, 1), "band": table.column("band").slice(0, 1),
                     "center": list_column(center[None, :]), "scale": list_column(spread[None, :])})


def feature_bands(rows: DataFrame, width: int, biggest: int) -> DataFrame:
    """``grp, band, features``: rows cut into bands of features, of at most ``BAND_BYTES`` in the largest group."""
    step = max(1, BAND_BYTES // (8 * max(biggest, 1)))
    if step >= width:
        return rows.select("grp", F.lit(0).alias("band"), C.FEATURES)
    starts = list(range(0, width, step))
    # the last band is open, so that longer arrays are still noticed
    pieces = [F.struct(F.lit(i).alias("band"), F.slice(C.FEATURES, at + 1, step if i + 1 < len(starts) else 2**31 - 1).alias(C.FEATURES))
              for i, at in enumerate(starts)]
    return rows.select("grp", F.explode(F.array(*pieces)).alias("piece")).select("grp", "piece.*")


def long_medians(rows: DataFrame, biggest: int) -> DataFrame:
    """Medians per batch and position of the long form; NaN where a value is missing."""
    long = to_long(rows)
    gap = F.max((F.col("value").isNull() | F.isnan("value")).cast("int")).alias("gap")
    found = exact_median(long, ["grp", "pos"], probe=biggest).join(
        long.groupBy("grp", "pos").agg(gap), ["grp", "pos"])
    whole = F.when(F.col("gap") == 1, F.lit(float("nan"))).otherwise(F.col("median")).alias("median")
    return from_long(found.select("grp", "pos", whole), ["grp"], "median")


def mad_model(df: DataFrame, batch_col: str | None, control: str | None, factor: float = 1.0) -> DataFrame:
    """``grp, center, scale``: exact median and median absolute deviation.

    A NULL or NaN among a batch's rows makes that feature's centre and scale NaN. Groups are reduced in
    bands of features that fit a task; groups of which one feature does not go through exact medians of
    the long form, with the same result.
    """
    rows = fit_rows(df, batch_col, control)
    first = df.select(F.size(C.FEATURES)).first()
    biggest = largest_group(rows, ["grp"])
    if first is not None and biggest * 8 <= IN_MEMORY_GROUP:
        found = feature_bands(rows, first[0], biggest).groupBy("grp", "band").applyInArrow(
            lambda table: numpy_mad(table, factor),
            "grp string, band int, center array<double>, scale array<double>")
        bands = F.array_sort(F.collect_list(F.struct("band", "center", "scale")))
        whole = lambda name: F.flatten(F.col("bands")[name]).alias(name)
        return found.groupBy("grp").agg(bands.alias("bands")).select("grp", whole("center"), whole("scale"))
    middle = long_medians(rows, biggest).withColumnRenamed(C.FEATURES, "center")
    apart = rows.join(middle, "grp").select(
        "grp", F.zip_with(C.FEATURES, "center", lambda x, c: F.abs(x - c)).alias(C.FEATURES))
    spread = long_medians(apart, biggest)
    return middle.join(spread, "grp").select(
        "grp", "center", F.transform(C.FEATURES, lambda s: s * F.lit(factor)).alias("scale"))


def robust_mad(df: DataFrame, batch_col: str | None = C.PLATE, control: str | None = C.NEGCON,
               factor: float = 1.0) -> DataFrame:
    """(x - median) / MAD; ``factor`` rescales the raw MAD."""
    return scale_by(df, mad_model(df, batch_col, control, factor), batch_col)


def nan_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise mean per key that skips NULL and NaN."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x)
    total = Summarizer.metrics("sum")
    cleaned = df.select(
        *keys,
        array_to_vector(F.transform(C.FEATURES, lambda x: F.when(usable(x), x).otherwise(0.0))).alias("x"),
        array_to_vector(F.transform(C.FEATURES, lambda x: usable(x).cast("double"))).alias("n"))
    summed = cleaned.groupBy(*keys).agg(
        vector_to_array(total.summary(F.col("x"))["sum"]).alias("x"),
        vector_to_array(total.summary(F.col("n"))["sum"]).alias("n"))
    return summed.select(*keys, F.zip_with("x", "n", lambda x, n: F.when(n > 0, x / n)).alias("mean"))


def well_position_correct(df: DataFrame, well_col: str = C.WELL) -> DataFrame:
    """Subtract the mean of each well position over all plates; rows without a well are one position."""
    keyed = df.withColumn("__well", batch_key(well_col))
    return keyed.join(nan_mean(keyed, ["__well"]), "__well").withColumn(
        C.FEATURES, F.zip_with(C.FEATURES, "mean", lambda x, m: x - m)).select(*df.columns)


def inverse_normal(df: DataFrame, row_id: str = C.ROW_ID) -> DataFrame:
    """Rank-based normal scores per feature; ties by row id, NaN and NULL ranked last and NaN."""
    total = df.count()
    nan = F.lit(float("nan"))
    long = to_long(df, [row_id]).withColumn("value", F.coalesce("value", nan))
    ranked = ordinal_rank(long, ["pos"], "value", row_id, probe=total)
    score = normal_quantile((F.col("rank") - 0.375) / (F.lit(total) + 0.25))
    scored = ranked.withColumn("score", F.when(F.isnan("value"), nan).otherwise(score))
    return df.drop(C.FEATURES).join(from_long(scored, [row_id], "score"), row_id).select(*df.columns)


def sample_normalize(df: DataFrame, norm: str = "l2") -> DataFrame:
    size = row_norm(C.FEATURES, norm) + F.lit(1e-10)
    return df.withColumn("__size", size).withColumn(
        C.FEATURES, F.transform(C.FEATURES, lambda x: x / F.col("__size"))).drop("__size")


# ---- linear maps -------------------------------------------------------------------


def map_features(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a matrix function to every Arrow batch of feature rows."""
    at = df.columns.index(C.FEATURES)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = list_column(fn(matrix_of(batch.column(at))))
                yield batch.set_column(at, C.FEATURES, out)

    return df.mapInArrow(run, df.schema)


def map_by_batch(df: DataFrame, batch_col: str | None, models: DataFrame, width: int,
                 fn: Callable[[list | None, np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a per-batch model ``(grp, status, payload array<array<double>>)``.

    Models whose total size is proven small travel with the task; otherwise rows are
    split into bounded blocks and each block is co-grouped with its batch's model.
    """
    count = models.count()
    out = df.withColumn("grp", batch_key(batch_col)).withColumn("model_status", F.lit(""))
    names = out.columns
    at, grp_at, status_at = (names.index(c) for c in (C.FEATURES, "grp", "model_status"))

    def apply(batch, lookup):
        x = matrix_of(batch.column(at))
        groups = batch.column(grp_at).dictionary_encode()
        if isinstance(groups, pa.ChunkedArray):
            groups = groups.combine_chunks()
        codes = groups.indices.to_numpy(zero_copy_only=False)
        done, status = [None] * len(x), np.empty(len(x), dtype=object)
        for code, group in enumerate(groups.dictionary.to_pylist()):
            rows = np.nonzero(codes == code)[0]
            state, payload = lookup(group)
            status[rows] = state
            for r, y in zip(rows, fn(payload, x[rows])):
                done[r] = y
        batch = batch.set_column(at, C.FEATURES, list_column(np.vstack(done)))
        return batch.set_column(status_at, "model_status", pa.array(status, pa.string()))

    if count * width * 8 <= CLOSURE_MODELS:
        held = {r["grp"]: (r["status"], None if r["payload"] is None else [np.asarray(p) for p in r["payload"]])
                for r in models.collect()}
        shared = df.sparkSession.sparkContext.broadcast(held)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield apply(batch, lambda g: shared.value.get(g, ("no model", None)))

        return out.mapInArrow(run, out.schema).drop("grp")

    blocked = with_block(out, ["grp"], C.FEATURES, 4096)
    places = blocked.select("grp", "block").distinct()

    def pair(key, rows, model):
        found = model.to_pylist()
        state, payload = ("no model", None)
        if found:
            state = found[0]["status"]
            payload = found[0]["payload"] and [np.asarray(p) for p in found[0]["payload"]]
        return apply(rows.combine_chunks(), lambda g: (state, payload)).drop_columns(["block"])

    right = places.join(models, "grp")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return blocked.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(
        pair, out.schema).drop("grp")


def batch_models(fitted: DataFrame, read: Callable, fit: Callable) -> DataFrame:
    """Turn each row of a table of moments or factors into a model inside a task.

    ``read`` yields (group, statistics) from an Arrow batch, ``fit`` makes (status, payload) of the statistics.
    """
    def run(batches):
        for batch in batches:
            models = [(group, *fit(found)) for group, found in read(batch)]
            yield pa.RecordBatch.from_pydict({
                "grp": pa.array([m[0] for m in models], pa.string()),
                "status": pa.array([m[1] for m in models], pa.string()),
                "payload": pa.array([None if m[2] is None else [np.ravel(p) for p in m[2]] for m in models],
                                    pa.list_(pa.list_(pa.float64()))),
            })

    return fitted.mapInArrow(run, "grp string, status string, payload array<array<double>>")


def moment_models(moments: DataFrame, pilot: np.ndarray,
                  fit: Callable[[Moments], tuple[str, list[np.ndarray] | None]]) -> DataFrame:
    return batch_models(moments, lambda batch: moments_of(batch, pilot), fit)


def controls_of(df: DataFrame, control: str | None) -> DataFrame:
    return df if control is None else df.filter(F.col(control))


def tvn(df: DataFrame, batch_col: str | None = C.PLATE, control: str | None = C.NEGCON,
        alpha: float = 0.5, epsilon: float = 1.0) -> DataFrame:
    """Centre by controls and multiply by (cov + eps I)^-alpha.

    Batches with fewer than two controls stay as they are; a global fit without enough
    controls uses all rows.
    """
    source = controls_of(df, control)
    if not batch_col and source.limit(2).count() < 2:
        source = df
    pilot = pilot_of(df)
    d = pilot.size

    def fit(m: Moments):
        if m.n < 2:
            return "too few controls", None
        cov = m.cov()
        cond = linalg.condition(cov)
        bad = cond > linalg.ILL_CONDITIONED
        eps = max(epsilon, cond / 1e8) if bad else epsilon
        power = linalg.sym_power(cov + eps * np.eye(d), -alpha)
        return ("ill conditioned" if bad else "ok"), [m.mean, power]

    models = moment_models(moment_table(source, batch_key(batch_col), pilot), pilot, fit)
    return map_by_batch(df, batch_col, models, d * d + d, lambda p, x: x if p is None else
                        (x - p[0]) @ p[1].reshape(d, d))


def clamp_dimensions(k: int, fewest: int, threshold: float = 2.5, action: str = "clamp") -> int:
    """Keep the output dimension in proportion to the controls per batch."""
    if fewest <= 0 or k / fewest <= threshold:
        return k
    if action == "abort":
        raise ValueError(f"{k} dimensions against {fewest} controls per batch")
    return fewest - 1


def fewest_controls(df: DataFrame, batch_col: str | None, control: str) -> int:
    """Smallest control count of the batches having at least two."""
    counts = controls_of(df, control).groupBy(batch_key(batch_col).alias("grp")).count()
    return counts.filter("count >= 2").agg(F.min("count")).first()[0] or 0


def tvn_efaar(df: DataFrame, batch_col: str | None = C.PLATE, control: str = C.NEGCON,
              epsilon: float = 0.5, n_components: int = 128, dim_ratio_threshold: float = 2.5,
              dim_ratio_action: str = "clamp") -> tuple[DataFrame, list[str]]:
    """Global z-score and PCA on controls, per-batch z-score, then CORAL to the pooled controls.

    All affine parts are derived from two rounds of control moments, then applied in one
    pass over the rows.
    """
    controls = controls_of(df, control)
    overall = global_moments(controls)
    d = overall.mean.size
    fewest = fewest_controls(df, batch_col, control) if batch_col else 0
    k = min(n_components, d, overall.n - 1)
    k = clamp_dimensions(k, fewest or overall.n, dim_ratio_threshold, dim_ratio_action)
    scale = overall.std() + EPSILON
    _, vectors = linalg.eigen_desc(overall.scatter / np.outer(scale, scale))
    project = vectors[:, :k] / scale[:, None]
    center = overall.mean
    reduced = map_features(df, lambda x: (x - center) @ project)
    zero = np.zeros(k)
    table = moment_table(controls_of(reduced, control), batch_key(batch_col), zero)

    def batch_scale(m: Moments):
        if m.n < 2 or not batch_col:
            return np.zeros(k), np.ones(k)
        return m.mean, m.std() + EPSILON

    def pooled(m: Moments):
        shift, spread = batch_scale(m)
        mean = (m.mean - shift) / spread
        second = m.scatter / np.outer(spread, spread) + m.n * np.outer(mean, mean)
        return "part", [np.array([m.n]), m.n * mean, second]

    parts = moment_models(table, zero, pooled)
    flat = parts.select(array_to_vector(F.flatten("payload")).alias("v"))
    total = np.asarray(flat.agg(Summarizer.sum(F.col("v"))).first()[0].toArray())
    n, first, second = total[0], total[1:k + 1], total[k + 1:].reshape(k, k)
    target = (second - np.outer(first, first) / n) / (n - 1) + epsilon * np.eye(k)
    recolor = linalg.sym_power(target, 0.5)
    bad_target = linalg.condition(target) > linalg.ILL_CONDITIONED

    def fit(m: Moments):
        shift, spread = batch_scale(m)
        if not batch_col:
            return "ok", [shift, np.eye(k)]
        if m.n < 2:
            return "too few controls", None
        source = m.cov() / np.outer(spread, spread) + epsilon * np.eye(k)
        bad = bad_target or linalg.condition(source) > linalg.ILL_CONDITIONED
        move = (linalg.sym_power(source, -0.5) @ recolor) / spread[:, None]
        return ("ill conditioned" if bad else "ok"), [shift, move]

    models = moment_models(table, zero, fit)
    out = map_by_batch(reduced, batch_col, models, k * k + k, lambda p, x: x if p is None else
                       (x - p[0]) @ p[1].reshape(k, k))
    return out, [f"PC_{i}" for i in range(k)]


def batches_with(df: DataFrame, batch_col: str, control: str, least: int = 2) -> DataFrame:
    """Control rows of the batches with at least ``least`` controls."""
    controls = controls_of(df, control)
    enough = controls.groupBy(batch_col).count().filter(F.col("count") >= least).select(batch_col)
    return controls.join(enough, batch_col, "left_semi")


def shrinkage_models(reduced: DataFrame, controls: DataFrame, batch_col: str, k: int) -> DataFrame:
    """Inverse square root of each batch's shrunk control covariance."""
    zero = np.zeros(k)

    def fit(m: Moments):
        cov = linalg.shrunk_cov(m.n, m.scatter, m.fourth)
        bad = linalg.condition(cov) > linalg.ILL_CONDITIONED
        return ("ill conditioned" if bad else "ok"), [linalg.sym_power(cov, -0.5)]

    return moment_models(moment_table(controls, batch_key(batch_col), zero, True), zero, fit)


def apply_shrinkage(reduced: DataFrame, models: DataFrame, batch_col: str, k: int) -> DataFrame:
    """Rows of batches without a model become zeros."""
    return map_by_batch(reduced, batch_col, models, k * k, lambda p, x: np.zeros_like(x) if p is None
                        else x @ p[0].reshape(k, k))


def tvn_original(df: DataFrame, batch_col: str = C.PLATE, control: str = C.NEGCON, k: int = 50,
                 epsilon: float = 1e-8, dim_ratio_threshold: float = 2.5,
                 dim_ratio_action: str = "clamp") -> tuple[DataFrame, list[str]]:
    """Whiten on pooled controls, then per-batch inverse root of the shrunk covariance."""
    fitted = batches_with(df, batch_col, control)
    k = clamp_dimensions(k, fewest_controls(df, batch_col, control), dim_ratio_threshold, dim_ratio_action)
    m = global_moments(fitted)
    k = min(k, m.mean.size)
    center, w = m.mean, linalg.whitening(m.cov(), k, epsilon)
    reduced = map_features(df, lambda x: (x - center) @ w)
    models = shrinkage_models(reduced, batches_with(reduced, batch_col, control), batch_col, k)
    return apply_shrinkage(reduced, models, batch_col, k), [f"TVN_{i}" for i in range(k)]


def tvn_cascade(df: DataFrame, batch_col: str = C.PLATE, control: str = C.NEGCON, k1: int | None = None,
                k2: int | None = None, epsilon: float = 1e-8) -> tuple[DataFrame, list[str]]:
    """Two whitenings in a row, then per-batch inverse root of the shrunk covariance."""
    m = global_moments(batches_with(df, batch_col, control))
    k1 = min(100, m.mean.size) if k1 is None else min(k1, m.mean.size)
    k2 = min(10, k1) if k2 is None else min(k2, k1)
    w1 = linalg.whitening(m.cov(), k1, epsilon)
    # the second whitening only needs the covariance seen through the first
    w2 = linalg.whitening(w1.T @ m.cov() @ w1, k2, epsilon)
    center, w = m.mean, w1 @ w2
    reduced = map_features(df, lambda x: (x - center) @ w)
    models = shrinkage_models(reduced, batches_with(reduced, batch_col, control), batch_col, k2)
    return apply_shrinkage(reduced, models, batch_col, k2), [f"TVN_Cascade_{i}" for i in range(k2)]


def removed_components(values: np.ndarray, n: int, d: int, method: str, threshold: float | None,
                       random_max: np.ndarray | None = None) -> int:
    """How many leading components a truncating spherize drops; 0 means none."""
    rank = len(values)
    if method == "pa":
        below = np.nonzero(np.sqrt(values) <= random_max)[0]
        k = int(below[0]) if len(below) else rank
        return 0 if k >= rank else min(k, rank - 1)
    if method == "mp":
        edge = (1.0 + np.sqrt(d / n)) ** 2
        return min(int((values / (n - 1) > edge).sum()), rank - 1)
    if threshold is None:
        return 0
    share = np.cumsum(values) / values.sum()
    return min(int(np.searchsorted(share, threshold)) + 1, rank - 1)


def spherize_parts(m: Factor, method: str, center: bool):
    """(shift, scale, singular values, vectors) of the working matrix, from its triangular factor.

    The factor has the singular values of the rows themselves, so a condition of 1e12 is still told from one of 1e10;
    the square root of Gram eigenvalues ends at about 1e8.
    """
    scale = np.ones(m.mean.size)
    if "cor" in method:
        scale = m.std()
        scale = np.where(scale < 1e-10, 1.0, scale)
    centred = "cor" in method or center
    shift = m.mean if centred else np.zeros(m.mean.size)
    _, sigma, vectors = np.linalg.svd((m.root if centred else m.raw_root()) / scale)
    vectors = linalg.fixed_signs(vectors.T)
    rank = min(m.n, m.mean.size)
    sigma = np.append(sigma, np.zeros(max(0, rank - len(sigma))))
    return shift, scale, sigma[:rank], vectors[:, :rank]


def spherize_map(m: Factor, method: str, epsilon: float, center: bool) -> tuple[str, list[np.ndarray]]:
    """Whitening model of one batch: shift, scale and a d-by-d matrix."""
    shift, scale, sigma, vectors = spherize_parts(m, method, center)
    cond = float("inf") if sigma[-1] <= 0 else sigma[0] / sigma[-1]
    d, rank = vectors.shape
    w = vectors / (sigma + epsilon) * np.sqrt(max(m.n - 1, 0))
    if "ZCA" in method:
        w = w @ vectors.T
    elif rank < d:
        padded = np.eye(d)
        padded[:, :rank] = w
        w = padded
    return ("ill conditioned" if cond > linalg.ILL_CONDITIONED else "ok"), [shift, scale, w]


def permuted_spectrum(work: DataFrame, row_id: str, rounds: int, seed: int) -> np.ndarray:
    """Largest singular values seen when every column is shuffled on its own.

    A shuffle is a hash order per (row, column, round); ranks are re-paired into rows.
    """
    best = None
    total = work.count()
    long = to_long(work, [row_id])
    for turn in range(rounds):
        mixed = long.withColumn("key", F.xxhash64(F.col(row_id), F.col("pos"), F.lit(seed + turn)))
        ranked = ordinal_rank(mixed, ["pos"], "key", row_id, probe=total)
        shuffled = from_long(ranked, ["rank"])
        gram = global_moments(shuffled)
        centred = gram.scatter + gram.n * np.outer(gram.mean, gram.mean)
        values = np.sqrt(np.maximum(linalg.eigen_desc(centred)[0][:min(gram.n, len(centred))], 0.0))
        best = values if best is None else np.maximum(best, values)
    return best


def spherize(df: DataFrame, batch_col: str | None = C.PLATE, control: str | None = None,
             method: str = "ZCA-cor", epsilon: float = 1e-6, center: bool = True,
             remove_variance_method: str = "threshold", remove_variance_threshold: float | None = None,
             n_permutations: int = 10, row_id: str = C.ROW_ID, seed: int = 0) -> DataFrame:
    """Whitening on the covariance or correlation matrix.

    Truncating variants drop the leading components and need a global fit, because the
    number dropped must be the same for all rows.
    """
    truncating = remove_variance_method in ("mp", "pa") or remove_variance_threshold is not None
    if not truncating:
        pilot = pilot_of(df)
        d = pilot.size
        rows = fit_rows(df, batch_col, control)
        models = batch_models(factor_table(rows, "grp", pilot), lambda batch: factors_of(batch, pilot),
                              lambda m: spherize_map(m, method, epsilon, center))
        return map_by_batch(df, batch_col, models, d * d + 2 * d,
                            lambda p, x: ((x - p[0]) / p[1]) @ p[2].reshape(d, d))
    if batch_col:
        raise ValueError("truncating spherize needs batch_col=None")
    source = controls_of(df, control)
    if source.limit(1).count() == 0:
        source = df
    m = global_factor(source)
    d = m.mean.size
    shift, scale, sigma, vectors = spherize_parts(m, method, center)
    random_max = None
    if remove_variance_method == "pa":
        work = map_features(source.select(row_id, C.FEATURES), lambda x: (x - shift) / scale)
        random_max = permuted_spectrum(work, row_id, n_permutations, seed)
    k = removed_components(sigma ** 2, m.n, d, remove_variance_method, remove_variance_threshold, random_max)
    w = vectors[:, k:] if k else spherize_map(m, method, epsilon, center)[1][2]
    return map_features(df, lambda x: ((x - shift) / scale) @ w).withColumn(
        "model_status", F.lit(f"removed {k}" if k else "ok"))


def pca(df: DataFrame, n_components: int | float = 128, whiten: bool = False,
        control: str | None = C.NEGCON) -> tuple[DataFrame, list[str]]:
    """Project on leading components of the controls; a fraction selects by variance."""
    m = global_moments(controls_of(df, control))
    d = m.mean.size
    most = min(m.n, d)
    values, vectors = linalg.eigen_desc(m.cov())
    if isinstance(n_components, float):
        share = np.cumsum(values) / values.sum()
        n_components = min(int(np.searchsorted(share, n_components)) + 1, d)
    if n_components >= most:
        if most <= 1:
            return df, []
        n_components = most - 1
    k = int(n_components)
    w = vectors[:, :k] / (np.sqrt(np.maximum(values[:k], EPSILON)) if whiten else 1.0)
    center = m.mean
    return map_features(df, lambda x: (x - center) @ w), [f"PC_{i + 1}" for i in range(k)]


def leading_variance(df: DataFrame) -> float:
    """Share of the variance on the first component."""
    m = global_moments(df)
    values = linalg.eigen_desc(m.cov())[0]
    return float(values[0] / values.sum()) if values.sum() > 0 else 0.0


def leading_variance_gate(df: DataFrame, limit: float = 0.40) -> tuple[bool, float]:
    share = leading_variance(df)
    return share <= limit, share
