"""Site and well keys: ``source__batch__plate__well__site``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.expressions import as_col


def key_parts(key: Column | str) -> Column:
    """Split a site key; a key without exactly five parts is an error."""
    parts = F.split(as_col(key), "__")
    return F.when(F.size(parts) == 5, parts).otherwise(
        F.raise_error(F.concat(F.lit("malformed site key: "), as_col(key))).cast("array<string>")
    )


def with_site_columns(df: DataFrame, key: str = C.SITE_KEY) -> DataFrame:
    """Add the five identity columns of a site key, the site as a number."""
    parts = key_parts(key)
    named = {name: parts[i] for i, name in enumerate(C.SITE_PARTS[:-1])}
    return df.withColumns({**named, C.SITE: parts[4].cast("bigint")})


def site_key(*parts: Column | str) -> Column:
    return F.concat_ws("__", *[as_col(p).cast("string") for p in parts])


def file_stem(path: Column | str) -> Column:
    """File name without folder and without its last suffix."""
    name = F.substring_index(as_col(path), "/", -1)
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    return F.when(dot > 0, F.substring(name, F.lit(1), dot)).otherwise(name)


def well_key_of_file(path: Column | str) -> Column:
    """First four name parts of a site file."""
    return F.concat_ws("__", F.slice(F.split(file_stem(path), "__"), 1, 4))


def object_uri(template: str, *parts: Column | str) -> Column:
    """Fill a ``%s`` template from columns."""
    return F.format_string(template, *[as_col(p) for p in parts])
