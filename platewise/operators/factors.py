"""Tall-skinny QR: the triangular factor of each group's rows, by a tree over tasks.

The rows of a group, with a leading column of ones, are the product of an orthogonal matrix and a triangular
factor. A task folds its rows into one factor per group and salt; factors of ``FAN`` salts at a time are stacked and
factored again until one is left. As the ones come first, the factor's first row holds the mean and the rest is
the factor of the centred rows: singular values come out at full precision, without ever squaring the numbers. A
factor has no more rows than it was made of, so partials never exceed the input.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.arrow import list_column, matrix_of
from platewise.operators.moments import dealt_rows, pilot_of, stretches
from platewise.session import cut_lineage

FAN = 16
SCHEMA = "grp string, branch int, n bigint, root array<array<double>>"


@dataclass
class Factor:
    """Rows n, mean, and the triangular factor of the centred rows."""

    n: int
    mean: np.ndarray
    root: np.ndarray

    def std(self) -> np.ndarray:
        return np.sqrt((self.root ** 2).sum(axis=0) / max(self.n, 1))

    def cov(self, ddof: int = 1) -> np.ndarray:
        return self.root.T @ self.root / max(self.n - ddof, 1)

    def raw_root(self) -> np.ndarray:
        """The factor of the rows as they are."""
        return np.linalg.qr(np.vstack([np.sqrt(self.n) * self.mean, self.root]), mode="r")


def triangle(*parts: np.ndarray) -> np.ndarray:
    """The factor of stacked rows; as many rows as columns at most."""
    stacked = np.vstack([p for p in parts if p is not None])
    return np.linalg.qr(stacked, mode="r") if len(stacked) > 1 else stacked


def factor_row(group: str, branch: int, n: int, root: np.ndarray) -> pa.RecordBatch:
    packed = list_column(root)
    return pa.RecordBatch.from_arrays(
        [pa.array([group], pa.string()), pa.array([branch], pa.int32()), pa.array([n], pa.int64()),
         pa.ListArray.from_arrays(pa.array([0, len(root)], pa.int32()), packed)], ["grp", "branch", "n", "root"])


def partial_factors(batches, pilot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One factor per group and salt of rows sorted by them."""
    key, n, root = None, 0, None
    for own, part in stretches(batches, pilot):
        if own != key and root is not None:
            yield factor_row(*key, n, root)
            n, root = 0, None
        key, n = own, n + len(part)
        root = triangle(root, np.column_stack([np.ones(len(part)), part]))
    if root is not None:
        yield factor_row(*key, n, root)


def stacked(table: pa.Table) -> pa.Table:
    """The factor of the factors of one branch."""
    roots = [matrix_of(table.column("root").combine_chunks().slice(i, 1).flatten()) for i in range(table.num_rows)]
    n = sum(table.column("n").to_pylist())
    return pa.Table.from_batches([factor_row(table.column("grp")[0].as_py(), table.column("branch")[0].as_py(), n, triangle(*roots))])


def factor_table(df: DataFrame, group, pilot: np.ndarray) -> DataFrame:
    """``grp, branch, n, root``: one row per group with the factor of its rows less ``pilot``."""
    found = cut_lineage(dealt_rows(df, group, pilot.size).mapInArrow(lambda b: partial_factors(b, pilot), SCHEMA))
    width = (found.agg(F.max("branch")).first()[0] or 0) + 1
    while width > 1:
        width = -(-width // FAN)
        found = found.withColumn("branch", F.floor(F.col("branch") / FAN).cast("int")).groupBy("grp", "branch").applyInArrow(
            stacked, SCHEMA)
    return found


def read_factor(n: int, root: np.ndarray, pilot: np.ndarray) -> Factor:
    """The factor of the centred rows below its first row, which holds the mean times the root of n."""
    return Factor(n, pilot + root[0, 1:] / root[0, 0], root[1:, 1:])


def factors_of(batch: pa.RecordBatch, pilot: np.ndarray) -> Iterator[tuple[str, Factor]]:
    """(group, factor) of the rows of a ``factor_table`` batch."""
    names, counts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
    for i in range(batch.num_rows):
        yield names[i], read_factor(counts[i], matrix_of(batch.column(3).slice(i, 1).flatten()), pilot)


def global_factor(df: DataFrame) -> Factor:
    """The factor of the whole table; a triangle of d-by-d numbers reaches the driver."""
    pilot = pilot_of(df)
    table = factor_table(df.select(C.FEATURES), F.lit("all"), pilot).toArrow()
    return next(factors_of(table.combine_chunks().to_batches()[0], pilot))[1]
