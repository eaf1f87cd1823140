"""Bounded row blocks, so that no task ever holds a whole hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 20_000_000
RANGE_ROWS = 1_000_000


def with_block(df: DataFrame, keys: list[str], row_id: str, size: int, name: str = "block") -> DataFrame:
    """Spread each group over blocks of about ``size`` rows by hashing the row id.

    Groups are counted with partial aggregation; a group of any size only changes how
    many blocks it gets. ``row_id`` must identify rows for the blocks to be even.
    """
    blocks = F.ceil(F.col("__rows") / F.lit(float(size))).cast("bigint")
    pick = F.pmod(F.xxhash64(row_id, F.lit(17)), blocks)
    if not keys:
        return with_block(df.withColumn("__all", F.lit(0)), ["__all"], row_id, size, name).drop("__all")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    renamed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    on = match[0]
    for part in match[1:]:
        on = on & part
    joined = df.join(sizes.select(*renamed, "__rows"), on)
    return joined.withColumn(name, pick).drop("__rows", *[f"__k{i}" for i in range(len(keys))])


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups, from a partial aggregation."""
    counts = df.groupBy(*keys).count() if keys else df.select(F.count(F.lit(1)).alias("count"))
    found = counts.agg(F.max("count"), F.sum("count")).first()
    return found[0] or 0, found[1] or 0


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return group_sizes(df, keys)[0]


def salted_self_pairs(df: DataFrame, keys: list[str], row_id: str, columns: list[str],
                      size: int = 4096) -> DataFrame:
    """Equi self-join where a hot key is split over block pairs.

    Both sides carry ``columns`` suffixed ``_a`` and ``_b``. The left side keeps its
    block, the right side is repeated once per block of the key, so that every
    (key, block) task is bounded while the result stays complete.
    """
    blocked = with_block(df, keys, row_id, size)
    spread = blocked.groupBy(*keys).agg(F.max("block").alias("__last"))
    left = blocked.select(*keys, "block", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = (
        blocked.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns])
        .join(spread, keys)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last"))))
        .drop("__last")
    )
    return left.join(right, [*keys, "block"]).drop("block")


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL keys match; the columns of ``left`` keep their names."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"__k_{k}"])
    return left.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def range_cuts(value: str, ranges: int) -> Column:
    """Approximate bounds of ``ranges`` equally filled value ranges; NaN is beyond every bound."""
    if ranges < 2:
        return F.array().cast("array<double>")
    number = F.col(value).cast("double")
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return F.percentile_approx(F.when(~F.isnan(number), number), steps, F.lit(10 * ranges))


def range_of(value: str, cuts: str = "__cuts") -> Column:
    """How many bounds lie below a value; NULL values come first."""
    number = F.col(value).cast("double")
    return F.coalesce(F.size(F.filter(F.coalesce(cuts, F.array().cast("array<double>")), lambda c: c < number)), F.lit(0))


def ranges_for(rows: int, hot_rows: int, per_range: int = RANGE_ROWS) -> int:
    """One range up to ``hot_rows`` rows in the largest group, beyond it as many as the rows need."""
    return 1 if rows <= hot_rows else max(16, -(-rows // per_range))


def exact_median(long: DataFrame, keys: list[str], value: str = "value", alias: str = "median",
                 hot_rows: int = HOT_ROWS, probe: int | None = None) -> DataFrame:
    """Exact median per key: NULL values are ignored, NaN is the largest value, NULL keys are a key.

    ``median`` keeps one counted map per group. When the largest group (``probe`` if the
    caller knows it, otherwise counted here) is beyond ``hot_rows``, the ranks are found
    from per-range counts instead, and only the range holding the middle is sorted. Both
    ways give the same rows.
    """
    rows = largest_group(long, keys) if probe is None else probe
    if rows <= hot_rows:
        return long.groupBy(*keys).agg(F.median(value).alias(alias))
    return ranged_median(long, keys, value, alias, ranges_for(rows, hot_rows))


def ranged_median(long: DataFrame, keys: list[str], value: str = "value", alias: str = "median",
                  ranges: int = 256) -> DataFrame:
    """Exact median through value ranges; repeated values are counted first."""
    counted = (
        long.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    )
    cuts = counted.groupBy(*keys).agg(range_cuts("__v", ranges).alias("__cuts"), F.sum("__n").alias("__total"))
    placed = beside(counted, cuts, keys).select(*keys, "__v", "__n", "__total", range_of("__v").alias("__range"))
    by_range = Window.partitionBy(*keys).orderBy("__range")
    before = F.sum("__rows").over(by_range) - F.col("__rows")
    lower, upper = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    middle = (
        placed.groupBy(*keys, "__range", "__total").agg(F.sum("__n").alias("__rows"))
        .withColumn("__before", before)
        .filter((F.col("__before") <= upper) & (F.col("__before") + F.col("__rows") > lower))
        .select(*keys, "__range", "__before")
    )
    inside = Window.partitionBy(*keys, "__range").orderBy("__v")
    end = F.col("__before") + F.sum("__n").over(inside)
    ranked = beside(placed, middle, [*keys, "__range"]).withColumn("__end", end)
    start = F.col("__end") - F.col("__n")

    def at(rank):
        return F.max(F.when((start <= rank) & (F.col("__end") > rank), F.col("__v")))

    found = ranked.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias(alias))
    # a key with NULL values only has a NULL median
    return beside(long.select(*keys).distinct(), found, keys, "left")


def id_part(df: DataFrame, row_id: str, parts: int) -> Column:
    """How many of about ``parts`` ids, taken at random by hash, lie below an id; NULL ids come first.

    The ids reach the driver; they are at most ``parts``, whatever the number of rows.
    """
    hashed = F.xxhash64(F.col(row_id), F.lit(31))
    found = (df.filter(F.col(row_id).isNotNull()).groupBy(F.pmod(hashed, F.lit(parts)).alias("__slot"))
             .agg(F.min_by(row_id, hashed).alias("cut")).collect())
    kind = df.schema[row_id].dataType
    cuts = F.array(*[F.lit(r["cut"]).cast(kind) for r in found])
    return F.size(F.filter(cuts, lambda c: c < F.col(row_id))) if found else F.lit(0)


def ordinal_rank(df: DataFrame, keys: list[str], value: str, row_id: str, alias: str = "rank",
                 hot_rows: int = HOT_ROWS, probe: int | None = None) -> DataFrame:
    """1-based rank by (value, row id) per key, without sorting a hot key in one task.

    Ids of any type will do. Up to ``hot_rows`` rows a key is one range; beyond, a value
    range holds about as many rows as a task sorts well, and the ties of a value are
    divided by the order of their ids. The rank is the same either way.
    """
    rows = largest_group(df, keys) if probe is None else probe
    ranges = ranges_for(rows, hot_rows)
    order = [F.asc_nulls_first(value), F.asc_nulls_first(row_id)]
    if ranges == 1:
        return df.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    cuts = df.groupBy(*keys).agg(range_cuts(value, ranges).alias("__cuts"))
    divided = id_part(df, row_id, ranges)
    number = F.col(value).cast("double")
    placed = beside(df, cuts, keys).withColumn("__range", F.when(F.col(value).isNull(), F.lit(-1)).otherwise(range_of(value)))
    # a value that is itself a bound, NULL or NaN may repeat without bound: its ties are divided by id
    at_cut = F.array_contains("__cuts", number) | F.col(value).isNull() | F.isnan(number)
    place = F.when(F.isnan(number), F.lit(2)).when(at_cut, F.lit(1)).otherwise(F.lit(0))
    placed = (placed.withColumn("__kind", place)
              .withColumn("__part", F.when(F.col("__kind") > 0, divided).otherwise(F.lit(0)))
              .drop("__cuts"))
    cells = [*keys, "__range", "__kind", "__part"]
    sizes = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("__rows"))
    running = F.sum("__rows").over(Window.partitionBy(*keys).orderBy("__range", "__kind", "__part"))
    offsets = sizes.withColumn("__before", running - F.col("__rows")).drop("__rows")
    local = F.row_number().over(Window.partitionBy(*cells).orderBy(*order))
    return (
        beside(placed, offsets, cells)
        .withColumn(alias, (F.col("__before") + local).cast("int"))
        .drop("__range", "__kind", "__part", "__before")
    )


def running_totals(df: DataFrame, keys: list[str], order: str, sums: list[str], following: str,
                   hot_rows: int = HOT_ROWS, probe: int | None = None) -> DataFrame:
    """Running sums of ``sums`` by ``order`` per key, and the next order value.

    Order values are distinct per key. Beyond ``hot_rows`` rows in one key, sums run
    within value ranges and each range starts from the total of those before it.
    """
    rows = largest_group(df, keys) if probe is None else probe
    ranges = ranges_for(rows, hot_rows)
    if ranges == 1:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumns({
            **{f"run_{s}": F.sum(s).over(w) for s in sums}, following: F.lead(order).over(w)})
    cuts = df.groupBy(*keys).agg(range_cuts(order, ranges).alias("__cuts"))
    placed = beside(df, cuts, keys).withColumn("__range", range_of(order)).drop("__cuts")
    across = Window.partitionBy(*keys).orderBy("__range")
    totals = placed.groupBy(*keys, "__range").agg(
        *[F.sum(s).alias(f"__t_{s}") for s in sums], F.min(order).alias("__first"))
    offsets = totals.select(*keys, "__range", F.lead("__first").over(across).alias("__next"), *[
        (F.sum(f"__t_{s}").over(across) - F.col(f"__t_{s}")).alias(f"__o_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "__range").orderBy(order)
    out = beside(placed, offsets, [*keys, "__range"]).withColumns({
        **{f"run_{s}": F.sum(s).over(inside) + F.col(f"__o_{s}") for s in sums},
        following: F.coalesce(F.lead(order).over(inside), F.col("__next"))})
    return out.drop("__range", "__next", *[f"__o_{s}" for s in sums])
