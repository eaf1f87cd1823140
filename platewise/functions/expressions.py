"""Small column expressions that stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal quantile.
PPF_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687,
         138.3577518672690, -30.66479806614716, 2.506628277459239]
PPF_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866,
         66.80131188771972, -13.28068155288572, 1.0]
PPF_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838,
         -2.549732539343734, 4.374664141464968, 2.938163982698783]
PPF_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996,
         3.754408661907416, 1.0]
PPF_LOW = 0.02425


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def horner(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column | str) -> Column:
    """Inverse of the standard normal distribution function, error about 1e-9."""
    p = as_col(p)
    q = p - F.lit(0.5)
    r = q * q
    centre = horner(PPF_A, r) * q / horner(PPF_B, r)
    low = F.sqrt(F.lit(-2.0) * F.log(p))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < PPF_LOW, horner(PPF_C, low) / horner(PPF_D, low))
        .when(p <= 1 - PPF_LOW, centre)
        .otherwise(-horner(PPF_C, high) / horner(PPF_D, high))
    )


def is_valid(value: Column | str) -> Column:
    """False for NULL, NaN and infinities; never NULL itself."""
    value = as_col(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def clean_number(value: Column | str) -> Column:
    """NULL where the number is NaN or infinite."""
    value = as_col(value)
    return F.when(is_valid(value), value)


def vector_sum(values: Column | str) -> Column:
    return F.aggregate(as_col(values), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def row_norm(values: Column | str, norm: str = "l2") -> Column:
    values = as_col(values)
    if norm == "l2":
        return F.sqrt(vector_sum(F.transform(values, lambda x: x * x)))
    if norm == "l1":
        return vector_sum(F.transform(values, F.abs))
    if norm == "max":
        return F.array_max(F.transform(values, F.abs))
    raise ValueError(f"unknown norm {norm!r}")


def seeded_order(seed: int, *parts: Column | str) -> Column:
    """A reproducible pseudo-random sort key that does not depend on row placement."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_col(p).cast("string") for p in parts]))


def seeded_number(seed: int, *parts: Column | str) -> Column:
    """The leading 60 bits of ``seeded_order`` as a number."""
    return F.conv(F.substring(seeded_order(seed, *parts), 1, 15), 16, 10).cast("bigint")


def seeded_bucket(seed: int, buckets: Column | int, *parts: Column | str) -> Column:
    """Reproducible bucket number between 1 and ``buckets``."""
    head = F.conv(F.substring(seeded_order(seed, *parts), 1, 8), 16, 10).cast("bigint")
    count = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.pmod(head, count) + 1


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of complete pairs; NULL when a side does not vary.

    Partial deviations of a constant need not merge to zero, so its extremes are compared.
    """
    a, b = as_col(x), as_col(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies & (spread > 0), F.covar_pop(a, b) / spread)


def exact_std(x: Column) -> Column:
    """Population deviation that is zero for a constant, however its rows are spread over tasks."""
    return F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.stddev_pop(x))


def unique_sorted(values: Column | str) -> Column:
    return F.array_sort(F.array_distinct(as_col(values)))


def null_safe_all(left: str, right: str, keys: list[str]) -> Column:
    """Join condition on keys where NULL equals NULL."""
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, pairs)


def average_rank(order: Column, partition: list[str]) -> Column:
    """Rank with ties sharing their mean rank, within ``partition``."""
    from pyspark.sql import Window

    by_value = Window.partitionBy(*partition).orderBy(order)
    ties = Window.partitionBy(*partition, order)
    return F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
