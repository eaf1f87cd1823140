"""Release integrity: key sets, digests, constraint checks and value gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.expressions import as_col
from platewise.functions.keys import site_key

CHANNELS = ["AGP", "DNA", "ER", "Mito", "RNA"]


# ---- key sets ----------------------------------------------------------------------


def key_differences(canonical: DataFrame, variants: DataFrame, names: list[str], key: str = "key",
                    variant: str = "variant") -> DataFrame:
    """Keys missing from or surplus in each variant, all variants in one join."""
    expected = canonical.select(key).distinct().withColumn(
        variant, F.explode(F.array(*[F.lit(n) for n in names]))).withColumn("__want", F.lit(True))
    found = variants.select(variant, key).distinct().withColumn("__have", F.lit(True))
    both = expected.join(found, [variant, key], "full")
    side = F.when(F.col("__have").isNull(), "missing").when(F.col("__want").isNull(), "extra")
    return both.withColumn("difference", side).filter("difference is not null").select(variant, key, "difference")


def difference_counts(differences: DataFrame, by: list[str]) -> DataFrame:
    return differences.groupBy(*by, "difference").agg(F.count(F.lit(1)).alias("n"))


def surplus_by_source(differences: DataFrame, key: str = "key") -> DataFrame:
    """Surplus site keys by their source, for an audit."""
    return differences.filter("difference = 'extra'").groupBy(
        "variant", F.split(key, "__")[0].alias("source")).agg(F.count(F.lit(1)).alias("n"))


def key_hash(key: Column | str) -> Column:
    """60 bits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(as_col(key).cast("string")), 1, 15), 16, 10).cast("bigint")


def key_digest(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Order-independent digest of a key set: count, sum and exclusive-or of hashes.

    Folds on the map side; row order and partitioning do not matter.
    """
    h = key_hash(key)
    aggs = [F.count(F.lit(1)).alias("n_keys"),
            F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor")]
    distinct = df.select(*(by or []), key).distinct()
    return distinct.groupBy(*by).agg(*aggs) if by else distinct.agg(*aggs)


def sorted_digest(df: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """SHA-256 over the sorted key set, in two levels so that no task sees all keys.

    Keys fall into buckets by their own hash, each bucket is digested in key order, and
    the digest of the ordered bucket digests identifies the set.
    """
    keys = df.select(F.col(key).cast("string").alias("k")).distinct()
    spread = keys.withColumn("b", F.pmod(key_hash("k"), F.lit(buckets)))
    inner = spread.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("d"))
    cells = F.array_sort(F.collect_list(F.struct("b", "d")))
    return inner.agg(F.sha2(F.array_join(F.transform(cells, lambda c: c["d"]), "\n"), 256).alias("digest"))


# ---- checks ------------------------------------------------------------------------


def check(df: DataFrame, name: str, observed: Column, expected: Column | int) -> DataFrame:
    """One row ``(check, ok, observed, expected)`` from an aggregate."""
    want = expected if isinstance(expected, Column) else F.lit(expected)
    return df.agg(observed.cast("bigint").alias("observed"), want.cast("bigint").alias("expected")).select(
        F.lit(name).alias("check"), F.col("observed").eqNullSafe(F.col("expected")).alias("ok"),
        "observed", "expected")


def distinct_check(df: DataFrame, name: str, key: str) -> DataFrame:
    return check(df, name, F.count_distinct(key), F.count(F.lit(1)))


def count_check(df: DataFrame, name: str, expected: int) -> DataFrame:
    return check(df, name, F.count(F.lit(1)), expected)


def none_check(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
    """No row may satisfy the condition."""
    bad = F.count(F.lit(1)) if condition is None else F.count_if(F.coalesce(condition, F.lit(False)))
    return check(df, name, bad, 0)


def contained_check(child: DataFrame, parent: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Every child key exists in the parent."""
    return none_check(child.join(parent.select(*keys).distinct(), keys, "left_anti"), name)


def equal_sets_check(left: DataFrame, right: DataFrame, name: str, key: str) -> DataFrame:
    a = left.select(key).distinct().withColumn("a", F.lit(1))
    b = right.select(key).distinct().withColumn("b", F.lit(1))
    return none_check(a.join(b, key, "full").filter("a is null or b is null"), name)


def report(checks: list[DataFrame]) -> DataFrame:
    """All checks in one table; nothing stops at the first failure."""
    return reduce(DataFrame.unionByName, checks)


def require(results: DataFrame) -> DataFrame:
    """Fail with the names of all failed checks."""
    failed = [r["check"] for r in results.filter("not ok").collect()]
    if failed:
        raise ValueError(f"failed checks: {failed}")
    return results


# ---- gates -------------------------------------------------------------------------


def invalid_values(df: DataFrame, features: str = C.FEATURES) -> DataFrame:
    """Missing, NaN and infinite cells of a packed table."""
    cells = F.col(features)
    count = lambda test: F.coalesce(F.sum(F.size(F.filter(cells, test))), F.lit(0))
    return df.agg(
        count(lambda x: x.isNull()).alias("n_null"), count(lambda x: F.isnan(x)).alias("n_nan"),
        count(lambda x: F.abs(x) == float("inf")).alias("n_inf"))


def observe_invalid(df: DataFrame, step: str, features: str = C.FEATURES) -> tuple[DataFrame, Observation]:
    """Count invalid cells while the next action runs, without a pass of its own."""
    seen = Observation(f"invalid_{step}")
    count = lambda test: F.coalesce(F.sum(F.size(F.filter(features, test))), F.lit(0))
    return df.observe(
        seen, count(lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("n_invalid"),
        count(lambda x: x.isNull()).alias("n_null"), count(lambda x: F.isnan(x)).alias("n_nan"),
        count(lambda x: F.abs(x) == float("inf")).alias("n_inf")), seen


# ---- release tables ------------------------------------------------------------------


def exact_join(left: DataFrame, right: DataFrame, keys: list[str], surplus: bool = False) -> DataFrame:
    """Each row of ``left`` with its one counterpart in ``right``; the action fails where that is not so.

    A key found twice on a side, or on one side only, raises an error while rows are written, so no wrong table is
    ever complete. ``surplus`` allows keys of ``right`` that ``left`` does not have. Both sides are summed by key before
    the shuffle, so a key repeated very often is found without gathering its rows.
    """
    def by_key(df: DataFrame, name: str) -> DataFrame:
        rest = F.struct(*[c for c in df.columns if c not in keys], F.lit(1).alias("__there"))
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__n_{name}"), F.first(rest).alias(f"__{name}"))

    both = by_key(left, "left").join(by_key(right, "right"), keys, "left" if surplus else "full")
    n_left, n_right = [F.coalesce(f"__n_{name}", F.lit(0)) for name in ("left", "right")]
    told = F.concat(F.lit("rows of key ("), F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys]),
                    F.lit("): "), n_left, F.lit(" left, "), n_right, F.lit(" right"))
    one = F.when((n_left == 1) & (n_right == 1), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))
    own = [F.col(f"__{name}")[c].alias(c) for name, df in (("left", left), ("right", right)) for c in df.columns if c not in keys]
    return both.filter(one).select(*keys, *own)


def freeze_index(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Site index of a release: the full index reduced to the canonical sites, each of which it must hold once."""
    return exact_join(keys, index, C.SITE_PARTS, surplus=True)


def of_listed_plates(index: DataFrame, plates: DataFrame, position: int = 1, plate: str = C.PLATE) -> DataFrame:
    """The rows of an index whose plate is named in the given column, by position, of a list without header."""
    listed = plates.select(F.col(plates.columns[position]).alias(plate)).distinct()
    return index.join(listed, plate, "left_semi")


def expand_channels(index: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """One row per (site, channel)."""
    ids = [C.SITE_KEY, *C.SITE_PARTS]
    urls = [f"URL_Orig{c}" for c in (channels or CHANNELS)]
    long = index.unpivot(ids, urls, C.CHANNEL, "uri")
    return long.withColumn(C.CHANNEL, F.regexp_replace(C.CHANNEL, "^URL_Orig", ""))


def release_perturbations(metadata: DataFrame, keys: DataFrame) -> DataFrame:
    wells = keys.select(*C.WELL_PARTS).distinct()
    return metadata.join(wells, C.WELL_PARTS, "left_semi").withColumn(
        "Metadata_Well_Key", site_key(*C.WELL_PARTS))


def release_annotations(annotations: DataFrame, perturbations: DataFrame) -> DataFrame:
    return annotations.join(perturbations.select(C.PERT).distinct(), C.PERT, "left_semi")


def release_checks(keys: DataFrame, sites: DataFrame, images: DataFrame, plates: DataFrame,
                   perturbations: DataFrame, annotations: DataFrame, n_channels: int = 5) -> DataFrame:
    """Every invariant of a frozen release."""
    n_sites = sites.count()
    urls = [c for c in sites.columns if c.startswith("URL_Orig")]
    missing = reduce(lambda a, b: a | b, [F.col(u).isNull() for u in urls])
    per_site = images.groupBy(C.SITE_KEY).agg(F.count_distinct(C.CHANNEL).alias("n"))
    return report([
        equal_sets_check(sites, keys, "site keys equal canonical keys", C.SITE_KEY),
        distinct_check(sites, "site keys distinct", C.SITE_KEY),
        none_check(sites, "urls present", missing),
        none_check(sites, "site key equals its parts", F.col(C.SITE_KEY) != site_key(*C.SITE_PARTS)),
        count_check(images, "images per site", n_channels * n_sites),
        none_check(per_site, "channels complete", F.col("n") != n_channels),
        none_check(images, "image uris present", F.col("uri").isNull()),
        distinct_check(perturbations, "wells distinct", "Metadata_Well_Key"),
        check(plates, "plate manifest total", F.sum("site_count"), n_sites),
        contained_check(annotations, perturbations, "annotations within release", [C.PERT]),
    ])
