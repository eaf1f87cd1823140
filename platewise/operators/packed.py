"""Packed profile tables: metadata columns plus one ``features`` array.

Thousands of feature columns overwhelm code generation, so a wide table is held as
one array column and an ordered list of feature names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise import columns as C


def split_columns(df: DataFrame, prefix: str = C.META) -> tuple[list[str], list[str]]:
    """(features, metadata) by name prefix."""
    features = [c for c in df.columns if not c.startswith(prefix)]
    return features, [c for c in df.columns if c.startswith(prefix)]


def numeric_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The numeric ones among ``names``; decimals, dates and text are not features."""
    wanted = set(names)
    return [
        f.name for f in df.schema.fields
        if f.name in wanted
        and isinstance(f.dataType, T.NumericType)
        and not isinstance(f.dataType, T.DecimalType)
    ]


@dataclass(frozen=True)
class Profiles:
    """A packed table with the names of its feature positions."""

    df: DataFrame
    names: list[str]

    def with_df(self, df: DataFrame) -> Profiles:
        return Profiles(df, self.names)

    def keep(self, names: list[str]) -> Profiles:
        """Project to ``names``, in their given order.

        A subset in table order is a filter by position, which reads the array once; only
        a reordering picks single elements.
        """
        if names == self.names:
            return self
        wanted = set(names)
        if names == [n for n in self.names if n in wanted]:
            mask = F.array(*[F.lit(n in wanted) for n in self.names])
            picked = F.filter(C.FEATURES, lambda x, i: F.get(mask, i))
        else:
            position = {n: i for i, n in enumerate(self.names)}
            picked = F.array(*[F.get(F.col(C.FEATURES), F.lit(position[n])) for n in names])
        return Profiles(self.df.withColumn(C.FEATURES, picked), names)


def pack(df: DataFrame, prefix: str = C.META) -> Profiles:
    """Wide table to packed table; other non-numeric columns become metadata."""
    features, _ = split_columns(df, prefix)
    names = numeric_columns(df, features)
    rest = [c for c in df.columns if c not in set(names)]
    values = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    return Profiles(df.select(*[F.col(f"`{c}`") for c in rest], values.alias(C.FEATURES)), names)


def unpack(profiles: Profiles) -> DataFrame:
    rest = [c for c in profiles.df.columns if c != C.FEATURES]
    cells = [F.get(F.col(C.FEATURES), F.lit(i)).alias(n) for i, n in enumerate(profiles.names)]
    return profiles.df.select(*rest, *cells)


def to_long(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per (profile, feature position)."""
    keep = [c for c in df.columns if c != C.FEATURES] if keep is None else keep
    return df.select(*keep, F.posexplode(C.FEATURES).alias("pos", "value"))


def from_long(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Back to one row per key, ordered by position.

    A group holds one row per feature, so its size is bounded by the feature count.
    """
    cells = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("cell"))))
    return long.groupBy(*keys).agg(F.transform(cells, lambda c: c["cell"]).alias(C.FEATURES))


def wide_to_tidy(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Turn columns into rows, one per (row, column)."""
    return df.unpivot(ids, columns, name, value).filter(F.col(value).isNotNull())
