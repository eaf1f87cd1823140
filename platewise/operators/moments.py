"""One-pass moments ``(n, sum, Gram)`` per group of a packed table.

Rows are dealt to tasks by group and a salt, and sorted so that a task folds one group at a time. A group has one
salt per ``ROWS_PER_FEATURE`` times as many rows as there are features, so all partial Gram matrices together
are at most one per group, which is the size of the groups' models, and a quarter of the input, however the groups are
mixed in it. Partials leave the task as matrix rows keyed by (group, row number) and Spark sums them. A Gram
matrix larger than ``BAND_BYTES`` is folded in bands of its rows, one pass over the rows for each, so the number of
features is not limited by a task. Rows are shifted by a pilot vector to keep the sums accurate.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.arrow import list_column, matrix_of

BAND_BYTES = 256 << 20
ROWS_PER_FEATURE, LEAST_ROWS = 4, 8192
SUMS, CUBIC = -1, -2


def pilot_of(df: DataFrame) -> np.ndarray:
    """One row, used only as a numerical shift; constant features become exact zeros."""
    row = df.select(C.FEATURES).first()
    if row is None:
        raise ValueError("no rows to fit on")
    return np.nan_to_num(np.asarray(row[0], dtype=float))


def dealt_rows(df: DataFrame, group: str | Column, width: int) -> DataFrame:
    """``grp, salt, features``: sorted by group and salt within tasks; a large group has many salts.

    The group sizes are one aggregation over the group column; the join that brings the number of salts to the rows is
    as small as the number of groups.
    """
    source = df.select((F.col(group) if isinstance(group, str) else group).cast("string").alias("grp"), C.FEATURES)
    rows = max(ROWS_PER_FEATURE * width, LEAST_ROWS)
    sizes = source.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("salts"))
    sizes = sizes.withColumnRenamed("grp", "of_grp")
    salted = source.join(sizes, F.col("grp").eqNullSafe(F.col("of_grp"))).withColumn(
        "salt", F.pmod(F.xxhash64(C.FEATURES, F.spark_partition_id()), F.col("salts")).cast("int"))
    return salted.select("grp", "salt", C.FEATURES).repartition("grp", "salt").sortWithinPartitions("grp", "salt")


def one_group(df: DataFrame, width: int) -> DataFrame:
    """All rows as one group, left in their tasks; the tasks are joined where they have fewer rows than features."""
    source = df.select(F.lit("all").alias("grp"), F.lit(0).alias("salt"), C.FEATURES)
    return source.coalesce(max(1, df.count() // max(ROWS_PER_FEATURE * width, LEAST_ROWS)))


def stretches(batches, pilot: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
    """((group, salt), shifted rows) of consecutive rows of one group; a group may come in several stretches."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = matrix_of(batch.column(2)) - pilot
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            yield keys[a], x[a:b]


def partial_rows(batches, pilot, with_cubic, band: range) -> Iterator[pa.RecordBatch]:
    """Fold rows sorted by group into partial sums: the rows of ``band`` of each Gram matrix, vectors with the first band."""
    d = pilot.size

    def fresh():
        return [0, np.zeros(d), np.zeros((len(band), d)), np.zeros(d), 0.0]

    def emit(key, held):
        n, first, gram, cubic, fourth = held
        ids, rows, counts = list(band), [np.append(r, 0.0) for r in gram], [0] * len(band)
        if band.start == 0:
            ids, rows, counts = [SUMS, *ids], [np.append(first, 0.0), *rows], [n, *counts]
            if with_cubic:
                ids, rows, counts = [*ids, CUBIC], [*rows, np.append(cubic, fourth)], [*counts, 0]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(counts, pa.int64()),
             list_column(np.vstack(rows))], ["grp", "i", "n", "vec"])

    key, held = None, None
    for own, part in stretches(batches, pilot):
        if held is None or own != key:
            if held is not None:
                yield emit(key, held)
            key, held = own, fresh()
        held[0] += len(part)
        held[1] += part.sum(axis=0)
        with np.errstate(invalid="ignore"):  # a feature with missing values spoils its own row and column only
            held[2] += part[:, band.start:band.stop].T @ part
        if with_cubic:
            square = (part ** 2).sum(axis=1)
            held[3] += square @ part
            held[4] += float((square ** 2).sum())
    if held is not None:
        yield emit(key, held)


def bands(width: int) -> list[range]:
    """Consecutive rows of a Gram matrix that fit in ``BAND_BYTES`` together."""
    step = max(1, BAND_BYTES // (8 * max(width, 1)))
    return [range(a, min(a + step, width)) for a in range(0, width, step)]


@dataclass
class Moments:
    """Moments of one group, with the pilot already undone."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    fourth: float

    def cov(self, ddof: int = 1) -> np.ndarray:
        return self.scatter / max(self.n - ddof, 1)

    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.scatter), 0.0) / max(self.n, 1))


def partial_moments(dealt: DataFrame, pilot: np.ndarray, with_cubic: bool = False) -> DataFrame:
    """``grp, i, n, vec``: the partial matrix rows of every task, group and salt."""
    def part(band: range) -> DataFrame:
        return dealt.mapInArrow(lambda batches: partial_rows(batches, pilot, with_cubic, band),
                                "grp string, i int, n bigint, vec array<double>")

    first, *rest = [part(band) for band in bands(pilot.size)]
    for other in rest:
        first = first.unionByName(other)
    return first


def summed(partial: DataFrame) -> DataFrame:
    total = Summarizer.metrics("sum").summary(array_to_vector("vec"))["sum"]
    return partial.groupBy("grp", "i").agg(F.sum("n").alias("n"), vector_to_array(total).alias("vec"))


def moment_table(df: DataFrame, group, pilot: np.ndarray, with_cubic: bool = False) -> DataFrame:
    """One row per group: ``grp, n, rows`` with ``rows`` the packed matrix rows.

    ``rows`` is bounded by the feature count squared.
    """
    found = summed(partial_moments(dealt_rows(df, group, pilot.size), pilot, with_cubic))
    return found.groupBy("grp").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "vec"))).alias("rows"))


def read_moments(n: int, ids: np.ndarray, vec: np.ndarray, pilot: np.ndarray) -> Moments:
    """Rebuild centred moments from the summed matrix rows ``vec`` with the row numbers ``ids``."""
    d = pilot.size
    order = np.argsort(ids)
    ids, vec = ids[order], vec[order]
    at = {int(i): vec[k] for k, i in enumerate(ids[:2])}
    first, gram = at[SUMS][:d], vec[ids >= 0, :d]
    shift = first / n
    with np.errstate(invalid="ignore"):
        scatter = gram - n * np.outer(shift, shift)
    fourth = float("nan")
    if CUBIC in at:
        cubic, quartic = at[CUBIC][:d], at[CUBIC][d]
        m2 = float(shift @ shift)
        fourth = (quartic + 4 * float(shift @ gram @ shift) + n * m2 * m2
                  - 4 * float(cubic @ shift) + 2 * float(np.trace(gram)) * m2
                  - 4 * float(first @ shift) * m2)
    return Moments(int(n), pilot + shift, (scatter + scatter.T) / 2, fourth)


def moments_of(batch: pa.RecordBatch, pilot: np.ndarray) -> Iterator[tuple[str, Moments]]:
    """(group, moments) of the rows of a ``moment_table`` batch, read from the Arrow buffers."""
    names, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for i in range(batch.num_rows):
        rows = batch.column(2).slice(i, 1).flatten()
        yield names[i], read_moments(counts[i], rows.field("i").to_numpy(), matrix_of(rows.field("vec")), pilot)


def global_moments(df: DataFrame, with_cubic: bool = False) -> Moments:
    """Moments of the whole table; only d-by-d numbers reach the driver, as Arrow columns."""
    pilot = pilot_of(df)
    table = summed(partial_moments(one_group(df, pilot.size), pilot, with_cubic)).toArrow()
    return read_moments(sum(table.column("n").to_pylist()), table.column("i").to_numpy(), matrix_of(table.column("vec")), pilot)


def gram_edges(df: DataFrame, threshold: float) -> list[tuple[int, int, float]]:
    """Feature pairs with absolute correlation above ``threshold``, undefined ones as 0."""
    moments = global_moments(df)
    spread = np.sqrt(np.maximum(np.diag(moments.scatter), 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.nan_to_num(moments.scatter / np.outer(spread, spread), posinf=0.0, neginf=0.0)
    left, right = np.nonzero(np.triu(np.abs(corr) > threshold, k=1))
    return [(int(i), int(j), float(corr[i, j])) for i, j in zip(left, right)]
