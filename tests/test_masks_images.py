from itertools import permutations

import numpy as np
import pytest

from platewise.functions.expressions import normal_quantile
from platewise.operators import images as I
from platewise.operators import masks as M


@pytest.mark.parametrize("shape", [(3, 3), (2, 5), (5, 2), (4, 4)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        w = rng.random(shape) * (rng.random(shape) > 0.3)
        rows, cols = M.assign(w)
        small = w if shape[0] <= shape[1] else w.T
        best = max(sum(small[i, p[i]] for i in range(small.shape[0]))
                   for p in permutations(range(small.shape[1]), small.shape[0]))
        assert np.isclose(w[rows, cols].sum(), best)
        assert len(set(rows)) == len(set(cols)) == min(shape)


def pixels(spark, gt, pred):
    rows = [("s", "f", "m", y, x, int(gt[y, x]), int(pred[y, x])) for y in range(gt.shape[0]) for x in range(gt.shape[1])]
    return spark.createDataFrame(
        rows, "source_id string, file string, method string, y int, x int, gt_label long, pred_label long")


def test_half_overlap_tie_gives_one_match(spark):
    gt, pred = np.zeros((4, 8), int), np.zeros((4, 8), int)
    gt[:, :4] = 1
    pred[:, :2], pred[:, 2:4] = 1, 2
    pred[0, 6] = 3
    out = M.instance_mapping(M.label_overlap(pixels(spark, gt, pred)), (0.5, 0.7)).toPandas()
    at = out[out.thresh == 0.5]
    assert (at.match_type == "TP").sum() == 1 and (at.match_type == "FP").sum() == 2
    assert (out[out.thresh == 0.7].match_type == "BELOW_THRESH").sum() == 1
    metrics = M.matching_metrics(M.instance_mapping(M.label_overlap(pixels(spark, gt, pred)), (0.5,))).first()
    assert metrics["n_true"] == 1 and metrics["n_pred"] == 3 and metrics["recall"] == 1.0


def test_dice_and_iou_relation(spark):
    rng = np.random.default_rng(0)
    row = M.foreground_metrics(pixels(spark, rng.integers(0, 2, (12, 12)), rng.integers(0, 2, (12, 12)))).first()
    assert np.isclose(row["dice"], 2 * row["iou"] / (1 + row["iou"]))
    empty = M.foreground_metrics(pixels(spark, np.zeros((3, 3), int), np.zeros((3, 3), int))).first()
    assert empty["dice"] == 0.0


def test_surface_distance_of_shifted_squares(spark):
    gt, pred = np.zeros((12, 12), int), np.zeros((12, 12), int)
    gt[2:6, 2:6], pred[2:6, 4:8] = 1, 1
    row = M.surface_distances(pixels(spark, gt, pred)).first()
    assert row["hausdorff_max"] == 2.0 and 0 < row["asd"] < 2


@pytest.mark.parametrize("h, w, share", [(1, 1, 1.0), (1, 40, 0.1), (40, 1, 0.1), (17, 23, 0.01), (30, 30, 0.3), (25, 60, 0.9)])
def test_distance_transform_equals_all_pairs(h, w, share):
    rng = np.random.default_rng(h * w)
    marks = rng.random((h, w)) < share
    marks[rng.integers(h), rng.integers(w)] = True
    y, x = np.nonzero(marks)
    gy, gx = np.mgrid[:h, :w]
    full = ((gy[..., None] - y) ** 2 + (gx[..., None] - x) ** 2).min(axis=2)
    assert (M.squared_distances(marks) == full).all()


def test_distance_transform_is_linear_in_the_cells():
    """Steps of the sweeps are counted: each column enters and leaves a row's envelope at most once."""
    rng = np.random.default_rng(1)
    marks = rng.random((300, 2000)) < 0.01
    got = M.squared_distances(marks)
    y, x = np.nonzero(marks)
    for r, c in rng.integers(0, [300, 2000], (50, 2)):
        assert got[r, c] == ((y - r) ** 2 + (x - c) ** 2).min()


def test_surface_distances_without_one_side(spark):
    gt, pred = np.zeros((6, 6), int), np.zeros((6, 6), int)
    gt[2:4, 2:4] = 1
    row = M.surface_distances(pixels(spark, gt, pred)).first()
    assert row["asd"] is None and row["hausdorff_95"] is None
    assert M.surface_distances(pixels(spark, pred, pred)).count() == 0


def test_image_metrics(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 60000, (20, 20))
    noisy = np.clip(base + rng.integers(-500, 500, (20, 20)), 0, 65535)
    rows = [("s", c, 0, 20, 20, [int(v) for v in im.ravel()]) for c, im in (("raw", base), ("hq", noisy))]
    df = spark.createDataFrame(rows, "site string, codec string, channel int, h int, w int, pixels array<int>")
    out = {r["codec"]: r for r in I.image_quality(df, "raw").collect()}
    mse = (((base - noisy) / 65535) ** 2).mean()
    assert np.isclose(out["hq"]["psnr"], -10 * np.log10(mse))
    assert out["raw"]["psnr"] is None and np.isclose(out["raw"]["ssim"], 1.0) and out["hq"]["ssim"] < 1
    assert out["raw"]["laplacian_ratio"] == 1.0
    # a plane with unit slope has gradient 8/4 across the inside
    ramp = np.tile(np.arange(10.0), (10, 1))
    assert np.isclose(I.tenengrad(ramp[:, :]), (4 * 8 + 1 * 2) / 10)


def test_normal_quantile(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(p,) for p in (0.001, 0.025, 0.5, 0.8413447460685429, 0.999)], "p double").select(
        normal_quantile("p")).collect()
    assert np.allclose([r[0] for r in got], [-3.090232306, -1.959963985, 0.0, 1.0, 3.090232306], atol=1e-7)
    assert spark.range(1).select(normal_quantile(F.lit(0.0))).first()[0] is None
