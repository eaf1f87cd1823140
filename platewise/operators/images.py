"""Pixel fidelity and sharpness of image planes, one plane per row.

A row is one channel of one site, so a task only ever holds single planes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_VALUE = 65535.0
SSIM_SIGMA, SSIM_WIDTH = 1.5, 11
SSIM_C1, SSIM_C2 = 0.01 ** 2, 0.03 ** 2


def plane_site(name: Column) -> Column:
    """Site key of a plane file: the first four and the sixth name part."""
    parts = F.split(name, "__")
    return F.concat_ws("__", F.slice(parts, 1, 4), parts[5])


def group_planes(planes: DataFrame, site: str = "site", channel: str = "channel") -> DataFrame:
    """All channel planes of a site in channel order; a site has a fixed few channels."""
    keys = [c for c in planes.columns if c not in (channel, "pixels")]
    return planes.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(channel).alias("channel"), "pixels"))).alias("planes"))


def gaussian_valid(image: np.ndarray) -> np.ndarray:
    """Separable Gaussian filter without border."""
    half = SSIM_WIDTH // 2
    kernel = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * SSIM_SIGMA ** 2))
    kernel /= kernel.sum()
    rows = sum(k * image[i:image.shape[0] - SSIM_WIDTH + 1 + i] for i, k in enumerate(kernel))
    return sum(k * rows[:, i:image.shape[1] - SSIM_WIDTH + 1 + i] for i, k in enumerate(kernel))


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean SSIM of two planes scaled to [0, 1]; NULL for planes below the window size."""
    if min(a.shape) < SSIM_WIDTH:
        return None
    ma, mb = gaussian_valid(a), gaussian_valid(b)
    va = gaussian_valid(a * a) - ma * ma
    vb = gaussian_valid(b * b) - mb * mb
    cov = gaussian_valid(a * b) - ma * mb
    top = (2 * ma * mb + SSIM_C1) * (2 * cov + SSIM_C2)
    return float((top / ((ma ** 2 + mb ** 2 + SSIM_C1) * (va + vb + SSIM_C2))).mean())


def laplacian_variance(image: np.ndarray) -> float:
    p = np.pad(image, 1, mode="symmetric")
    lap = 4 * image - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]
    return float(lap.var())


def tenengrad(image: np.ndarray) -> float:
    """Mean squared Sobel gradient."""
    p = np.pad(image, 1, mode="symmetric")
    down = (p[:-2] - p[2:]) / 4
    across = (p[:, :-2] - p[:, 2:]) / 4
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    return float((gx ** 2 + gy ** 2).mean())


def plane_metrics(planes: DataFrame, reference: str, codec: str = "codec") -> DataFrame:
    """Per (site, codec, channel): squared error, SSIM and both planes' sharpness."""
    base = planes.filter(F.col(codec) == reference).select(
        "site", "channel", F.col("pixels").alias("base"), F.col("h").alias("bh"), F.col("w").alias("bw"))
    pairs = planes.join(base, ["site", "channel"]).select(
        "site", codec, "channel", "h", "w", "pixels", "base")
    schema = f"site string, `{codec}` string, channel int, n bigint, sse double, ssim double, " \
             "lap_orig double, lap_comp double, ten_orig double, ten_comp double"

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for h, w, mine, theirs in zip(*(batch.column(i).to_pylist() for i in (3, 4)),
                                          batch.column(5), batch.column(6)):
                comp = mine.values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w)
                orig = theirs.values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w)
                a, b = orig / MAX_VALUE, comp / MAX_VALUE
                row = (h * w, float(((a - b) ** 2).sum()), structural_similarity(a, b),
                       laplacian_variance(orig), laplacian_variance(comp), tenengrad(orig), tenengrad(comp))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] + [pa.float64()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2).cast(pa.int32()),
                 *[pa.array(c, t) for c, t in zip(out, kinds)]],
                ["site", codec, "channel", "n", "sse", "ssim", "lap_orig", "lap_comp", "ten_orig", "ten_comp"])

    return pairs.mapInArrow(run, schema)


def image_quality(planes: DataFrame, reference: str, codec: str = "codec") -> DataFrame:
    """Per (site, codec): PSNR over all channels, mean SSIM, sharpness and its change."""
    agg = plane_metrics(planes, reference, codec).groupBy("site", codec).agg(
        (F.sum("sse") / F.sum("n")).alias("mse"), F.avg("ssim").alias("ssim"),
        *[F.avg(c).alias(c) for c in ("lap_orig", "lap_comp", "ten_orig", "ten_comp")])
    ratio = lambda a, b: F.when(b > 0, a / b)
    return agg.select(
        "site", codec, F.when(F.col("mse") > 0, -10 * F.log10("mse")).alias("psnr"), "ssim",
        F.col("lap_orig").alias("laplacian_orig"), F.col("lap_comp").alias("laplacian_comp"),
        ratio(F.col("lap_comp"), F.col("lap_orig")).alias("laplacian_ratio"),
        (F.col("lap_orig") - F.col("lap_comp")).alias("laplacian_diff"),
        F.col("ten_orig").alias("tenengrad_orig"), F.col("ten_comp").alias("tenengrad_comp"),
        ratio(F.col("ten_comp"), F.col("ten_orig")).alias("tenengrad_ratio"),
        (F.col("ten_orig") - F.col("ten_comp")).alias("tenengrad_diff"))


def pixel_error(pixels: DataFrame, keys: list[str], original: str, variant: str) -> DataFrame:
    """PSNR from pixel rows, without leaving the JVM."""
    gap = (F.col(original) - F.col(variant)) / MAX_VALUE
    mse = F.avg(gap * gap)
    return pixels.groupBy(*keys).agg(mse.alias("mse")).withColumn(
        "psnr", F.when(F.col("mse") > 0, -10 * F.log10("mse")))


def codec_summary(metrics: DataFrame, values: list[str], codec: str = "codec") -> DataFrame:
    """Mean, deviation, extremes and median per codec and metric."""
    long = metrics.unpivot([codec], values, "metric", "value")
    return long.groupBy(codec, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.median("value").alias("median"), F.count("value").alias("n"))


def percentile_markers(metrics: DataFrame, values: list[str], codec: str = "codec") -> DataFrame:
    """5th and 95th percentile per codec."""
    return metrics.groupBy(codec).agg(*[
        F.percentile(v, F.lit(p)).alias(f"{v}_p{int(p * 100)}") for v in values for p in (0.05, 0.95)])
