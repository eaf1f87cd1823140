"""Instance overlap, matching and foreground metrics of label masks held as pixel rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.blocks import ordinal_rank

SITE = ["source_id", "file", "method"]
THRESHOLDS = (0.5, 0.7, 0.8, 0.9)


def label_overlap(pixels: DataFrame, site: list[str] | None = None) -> DataFrame:
    """Pixel counts per (site, gt label, pred label), background included."""
    return pixels.groupBy(*(site or SITE), F.col("gt_label").alias("gt_id"), F.col("pred_label").alias("pred_id")).agg(
        F.count(F.lit(1)).alias("overlap"))


def overlap_scores(overlap: DataFrame, site: list[str] | None = None) -> DataFrame:
    """IoU, overlap over truth and overlap over prediction of touching label pairs."""
    site = site or SITE
    gt = overlap.groupBy(*site, "gt_id").agg(F.sum("overlap").alias("gt_area"))
    pred = overlap.groupBy(*site, "pred_id").agg(F.sum("overlap").alias("pred_area"))
    pairs = overlap.filter("gt_id > 0 and pred_id > 0").join(gt, [*site, "gt_id"]).join(pred, [*site, "pred_id"])
    return pairs.select(
        *site, "gt_id", "pred_id", "overlap", "gt_area", "pred_area",
        (F.col("overlap") / (F.col("gt_area") + F.col("pred_area") - F.col("overlap"))).alias("iou"),
        (F.col("overlap") / F.col("gt_area")).alias("iot"), (F.col("overlap") / F.col("pred_area")).alias("iop"))


def label_list(overlap: DataFrame, label: str, site: list[str] | None = None) -> DataFrame:
    return overlap.filter(F.col(label) > 0).select(*(site or SITE), label).distinct()


def assign(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-weight assignment of a small dense matrix by shortest augmenting paths."""
    flip = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flip else weight)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        best, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
        used = np.zeros(m + 1, dtype=bool)
        while owner[j0] != 0:
            used[j0] = True
            slack = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~used[1:] & (slack < best[1:])
            best[1:][better] = slack[better]
            back[1:][better] = j0
            free = np.where(used[1:], np.inf, best[1:])
            j1 = int(free.argmin()) + 1
            step = free[j1 - 1]
            u[owner[used]] += step
            v[used] -= step
            best[1:][~used[1:]] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    cols = np.nonzero(owner[1:])[0]
    rows = owner[1:][cols] - 1
    return (cols, rows) if flip else (rows, cols)


def match_site(gt, pred, score, thresh: float) -> list[tuple[int, int, float]]:
    """Best one-to-one pairs of one site: most pairs at the threshold, then most score.

    Touching labels split into independent clusters, each assigned on its own.
    """
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for g, p in zip(gt, pred):
        parent[root(("g", g))] = root(("p", p))
    clusters = {}
    for k, g in enumerate(gt):
        clusters.setdefault(root(("g", g)), []).append(k)
    smaller = max(min(len(set(gt)), len(set(pred))), 1)
    out = []
    for members in clusters.values():
        gs, ps = sorted({gt[k] for k in members}), sorted({pred[k] for k in members})
        value, raw = np.zeros((len(gs), len(ps))), np.zeros((len(gs), len(ps)))
        for k in members:
            at = gs.index(gt[k]), ps.index(pred[k])
            raw[at] = score[k]
            value[at] = float(score[k] >= thresh) + score[k] / (2 * smaller)
        out += [(gs[i], ps[j], raw[i, j]) for i, j in zip(*assign(value)) if raw[i, j] > 0]
    return out


def instance_mapping(overlap: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, criterion: str = "iou",
                     site: list[str] | None = None) -> DataFrame:
    """One row per match, missed and surplus object at each threshold.

    Every site is matched in one task; a site is one image, so its labels are bounded by
    the image. Leftover objects of both sides are paired in id order with score zero, as
    a full assignment pairs them, up to the smaller count; the rest are FN or FP.
    """
    site = site or SITE
    scores = overlap_scores(overlap, site).select(*site, "gt_id", "pred_id", F.col(criterion).alias("score"))
    rows = scores.unionByName(
        label_list(overlap, "gt_id", site).withColumns(
            {"pred_id": F.lit(0).cast("bigint"), "score": F.lit(0.0)})).unionByName(
        label_list(overlap, "pred_id", site).withColumns(
            {"gt_id": F.lit(0).cast("bigint"), "score": F.lit(0.0)}))
    types = dict(overlap.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in site] + [
        "thresh double", "gt_id bigint", "pred_id bigint", "iou_score double", "match_type string"])

    def run(key, table):
        gt, pred = table.column("gt_id").to_pylist(), table.column("pred_id").to_pylist()
        score = table.column("score").to_pylist()
        touching = [k for k in range(len(gt)) if gt[k] > 0 and pred[k] > 0]
        out = []
        for thresh in thresholds:
            pairs = match_site([gt[k] for k in touching], [pred[k] for k in touching],
                               [score[k] for k in touching], thresh)
            lone_g = sorted({g for g in gt if g > 0} - {g for g, _, _ in pairs})
            lone_p = sorted({p for p in pred if p > 0} - {p for _, p, _ in pairs})
            both = min(len(lone_g), len(lone_p))
            pairs += [(g, p, 0.0) for g, p in zip(lone_g[:both], lone_p[:both])]
            out += [(thresh, g, p, s, "TP" if s >= thresh else "BELOW_THRESH") for g, p, s in pairs]
            out += [(thresh, g, None, 0.0, "FN") for g in lone_g[both:]]
            out += [(thresh, None, p, 0.0, "FP") for p in lone_p[both:]]
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        arrays = [pa.array([k.as_py()] * len(out), k.type) for k in key] + [
            pa.array(list(c), t) for c, t in zip(cols, kinds)]
        return pa.table(arrays, names=[*site, "thresh", "gt_id", "pred_id", "iou_score", "match_type"])

    return rows.groupBy(*site).applyInArrow(run, schema)


def true_positives(overlap: DataFrame, thresh: float, site: list[str] | None = None) -> DataFrame:
    """Matches above one half, where a label has at most one partner: a plain filter."""
    if thresh <= 0.5:
        raise ValueError("partners are unique only above 0.5; use instance_mapping")
    return overlap_scores(overlap, site).filter(F.col("iou") >= thresh)


def matching_metrics(mapping: DataFrame, site: list[str] | None = None) -> DataFrame:
    """Detection metrics per site and threshold from the instance mapping."""
    site = site or SITE
    hit = F.col("match_type") == "TP"
    agg = mapping.groupBy(*site, "thresh").agg(
        F.count_if(hit).alias("tp"), F.count("gt_id").alias("n_true"), F.count("pred_id").alias("n_pred"),
        F.coalesce(F.sum(F.when(hit, F.col("iou_score"))), F.lit(0.0)).alias("__score"))
    tp = F.col("tp")
    rows = agg.withColumn("fp", F.col("n_pred") - tp).withColumn("fn", F.col("n_true") - tp)
    ratio = lambda top, bottom: F.when(tp > 0, top / bottom).otherwise(0.0)
    share = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    return rows.select(
        *site, "thresh", "tp", "fp", "fn", "n_true", "n_pred",
        ratio(tp, tp + F.col("fp")).alias("precision"), ratio(tp, tp + F.col("fn")).alias("recall"),
        ratio(tp, tp + F.col("fp") + F.col("fn")).alias("accuracy"),
        ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"),
        share(F.col("__score"), tp).alias("mean_matched_score"),
        share(F.col("__score"), F.col("n_true")).alias("mean_true_score"),
        share(F.col("__score"), tp + F.col("fp") / 2 + F.col("fn") / 2).alias("panoptic_quality"))


def foreground_metrics(pixels: DataFrame, site: list[str] | None = None) -> DataFrame:
    """Dice, IoU, precision and recall of foreground against background."""
    gt, pred = F.col("gt_label") > 0, F.col("pred_label") > 0
    agg = pixels.groupBy(*(site or SITE)).agg(
        F.count_if(gt & pred).alias("tp"), F.count_if(~gt & pred).alias("fp"), F.count_if(gt & ~pred).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    safe = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    return agg.select(
        *(site or SITE), safe(2 * tp, 2 * tp + fp + fn).alias("dice"), safe(tp, tp + fp + fn).alias("iou"),
        safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"))


def border(mask: np.ndarray) -> np.ndarray:
    """Foreground cells with a background or missing neighbour among their four."""
    wide = np.pad(mask, 1)
    return mask & ~(wide[:-2, 1:-1] & wide[2:, 1:-1] & wide[1:-1, :-2] & wide[1:-1, 2:])


def column_distances(marks: np.ndarray) -> np.ndarray:
    """Distance of every cell to the next mark of its column, by one sweep down and one up; marks in every column."""
    h = len(marks)
    at = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(marks, at, -2 * h), axis=0)
    below = np.minimum.accumulate(np.where(marks, at, 3 * h)[::-1], axis=0)[::-1]
    return np.minimum(at - above, below - at)


def squared_distances(marks: np.ndarray) -> np.ndarray:
    """Squared distance of every cell of a grid to the nearest mark.

    Separable: distances within columns first, then along every row the lower envelope of the parabolas that stand
    on the columns. Both are linear in the cells; all rows of the grid go through a sweep together.
    """
    h, w = marks.shape
    used = np.flatnonzero(marks.any(axis=0))
    height = column_distances(marks[:, used]).astype(np.float64) ** 2
    rows = np.arange(h)
    hull, start = np.zeros((h, len(used)), np.int64), np.full((h, len(used) + 1), np.inf)
    start[:, 0] = -np.inf
    top = np.zeros(h, np.int64)
    for k in range(1, len(used)):
        left = np.zeros(h)
        open_rows = rows
        while len(open_rows):
            last = hull[open_rows, top[open_rows]]
            meet = ((height[open_rows, k] + used[k] ** 2) - (height[open_rows, last] + used[last] ** 2)) / (2 * (used[k] - used[last]))
            left[open_rows] = meet
            open_rows = open_rows[meet <= start[open_rows, top[open_rows]]]
            top[open_rows] -= 1
        top += 1
        hull[rows, top], start[rows, top] = k, left
        start[rows, top + 1] = np.inf
    out = np.empty((h, w))
    at = np.zeros(h, np.int64)
    for x in range(w):
        behind = rows[start[rows, at + 1] < x]
        while len(behind):
            at[behind] += 1
            behind = behind[start[behind, at[behind] + 1] < x]
        own = hull[rows, at]
        out[:, x] = (x - used[own]) ** 2 + height[rows, own]
    return out


def surface_distances(pixels: DataFrame, site: list[str] | None = None) -> DataFrame:
    """95th percentile and maximum Hausdorff distance and mean surface distance.

    An image is drawn on a grid in one task; its borders and the distances to them take time linear in the grid.
    Images without foreground in one of the masks have no distances, those without any are left out.
    """
    site = site or SITE
    foreground = pixels.select(
        *site, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.col("gt_label") > 0).alias("gt"),
        (F.col("pred_label") > 0).alias("pred")).filter("gt or pred")
    types = dict(pixels.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in site] + [
        "hausdorff_95 double", "hausdorff_max double", "asd double"])

    def run(key, table):
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        sides = []
        for name in ("gt", "pred"):
            mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
            on = table.column(name).to_numpy(zero_copy_only=False).astype(bool)
            mask[y[on] - y.min(), x[on] - x.min()] = True
            sides.append(border(mask))
        gt, pred = sides
        values = [None, None, None]
        if gt.any() and pred.any():
            there, back = np.sqrt(squared_distances(gt)[pred]), np.sqrt(squared_distances(pred)[gt])
            merged = np.concatenate([there, back])
            values = [float(np.percentile(merged, 95)), float(merged.max()), float(there.mean())]
        arrays = [pa.array([k.as_py()], k.type) for k in key] + [pa.array([v], pa.float64()) for v in values]
        return pa.table(arrays, names=[*site, "hausdorff_95", "hausdorff_max", "asd"])

    return foreground.groupBy(*site).applyInArrow(run, schema)


def match_type_shares(mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Count and share of each match type within the keys, one column per type."""
    kinds = ["TP", "BELOW_THRESH", "FN", "FP"]
    total = F.count(F.lit(1))
    return mapping.groupBy(*keys).agg(
        *[F.count_if(F.col("match_type") == k).alias(f"n_{k.lower()}") for k in kinds],
        *[(F.count_if(F.col("match_type") == k) / total).alias(f"share_{k.lower()}") for k in kinds])


def threshold_ablation(wide: DataFrame, metric: str, codec: str = "codec",
                       thresholds: tuple[int, ...] = (50, 70, 80, 90)) -> DataFrame:
    """Mean and deviation of ``inst_<metric>_<threshold>`` columns per codec and threshold."""
    names = [f"inst_{metric}_{t}" for t in thresholds]
    long = wide.unpivot([codec], names, "name", "value")
    return long.groupBy(codec, F.regexp_extract("name", r"_(\d+)$", 1).cast("int").alias("threshold")).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def extreme_samples(metrics: DataFrame, value: str = "iou", keys: list[str] | None = None) -> DataFrame:
    """Worst, median and best site by its mean value over methods.

    Only three positions of the ranking are kept; a large ranking is split by value.
    """
    keys = keys or ["source_id", "file"]
    means = metrics.groupBy(*keys).agg(F.avg(value).alias("mean")).withColumns(
        {"__all": F.lit(0), "__ident": F.xxhash64(*keys)})
    n = means.count()
    wanted = {1: "worst", n // 2 + 1: "median", n: "best"}
    placed = ordinal_rank(means, ["__all"], "mean", "__ident", "place", probe=n)
    label = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col("place")]
    return placed.filter(F.col("place").isin(list(wanted))).select(*keys, "mean", label.alias("sample"))
