import numpy as np
from pyspark.sql import functions as F

from platewise.operators import blocks as B


def skewed(spark):
    """One key holds most rows, with heavily repeated values."""
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 10 else f"k{i % 7}", float(rng.integers(0, 40)) if i % 3 else float(rng.normal()))
            for i in range(3000)]
    return spark.createDataFrame(rows, "id long, key string, value double")


def test_ranged_median_equals_builtin(spark):
    df = skewed(spark)
    want = {r[0]: r[1] for r in df.groupBy("key").agg(F.median("value")).collect()}
    got = {r[0]: r[1] for r in B.exact_median(df, ["key"], hot_rows=10).collect()}
    assert got == want


def test_split_rank_equals_row_number(spark):
    df = skewed(spark)
    near = {r["id"]: r["rank"] for r in B.ordinal_rank(df, ["key"], "value", "id").collect()}
    far = {r["id"]: r["rank"] for r in B.ordinal_rank(df, ["key"], "value", "id", hot_rows=10).collect()}
    assert near == far and len(near) == 3000


def test_split_running_totals(spark):
    df = skewed(spark).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    as_set = lambda d: {(r["key"], r["value"], r["run_n"], r["next"]) for r in d.collect()}
    near = as_set(B.running_totals(df, ["key"], "value", ["n"], "next"))
    far = as_set(B.running_totals(df, ["key"], "value", ["n"], "next", hot_rows=10))
    assert near == far


def test_blocks_are_bounded_and_complete(spark):
    out = B.with_block(skewed(spark), ["key"], "id", 200)
    sizes = out.groupBy("key", "block").count()
    assert out.count() == 3000
    assert sizes.agg(F.max("count")).first()[0] < 300


def test_salted_self_pairs_complete(spark):
    df = spark.createDataFrame([("h", i) for i in range(60)] + [("s", 1), ("s", 2)], "key string, id long")
    got = B.salted_self_pairs(df, ["key"], "id", ["id"], size=7)
    assert got.count() == 60 * 60 + 4
    assert got.distinct().count() == 60 * 60 + 4


def test_group_medians_paths_agree(profiles):
    from platewise.operators.aggregate import group_medians

    read = lambda d: {r[0]: [round(v, 9) for v in r[1]] for r in d.collect()}
    near = read(group_medians(profiles, ["Metadata_Plate"], True))
    far = read(group_medians(profiles, ["Metadata_Plate"], False))
    assert near == far and len(near) == 4


def odd(spark):
    """NULL and text keys, NULL and NaN values, ties, text ids and a NULL id."""
    nan = float("nan")
    rows = []
    for i in range(1200):
        value = None if i % 11 == 0 else nan if i % 13 == 0 else float(i % 7) if i % 2 else i / 3
        rows.append((None if i == 77 else f"row{i}", None if i % 3 == 0 else f"k{i % 2}", value))
    rows += [("lone", "all null", None)]
    return spark.createDataFrame(rows, "id string, key string, value double")


def same(value):
    return "nan" if value is not None and value != value else value


def test_median_is_the_same_at_every_size(spark):
    read = lambda d: {r[0]: same(r[1]) for r in d.collect()}
    near = read(B.exact_median(odd(spark), ["key"]))
    assert near == read(B.exact_median(odd(spark), ["key"], hot_rows=10))
    assert set(near) == {None, "k0", "k1", "all null"} and near["all null"] is None


def test_rank_is_the_same_at_every_size(spark):
    read = lambda d: sorted((str(r["key"]), r["rank"], str(r["id"]), str(r["value"])) for r in d.collect())
    near = read(B.ordinal_rank(odd(spark), ["key"], "value", "id"))
    assert near == read(B.ordinal_rank(odd(spark), ["key"], "value", "id", hot_rows=10))
    assert len(near) == 1201


def test_running_totals_keep_null_keys(spark):
    df = odd(spark).filter("value = value").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    read = lambda d: {(r["key"], same(r["value"]), r["run_n"], same(r["next"])) for r in d.collect()}
    near = read(B.running_totals(df, ["key"], "value", ["n"], "next"))
    assert near == read(B.running_totals(df, ["key"], "value", ["n"], "next", hot_rows=5))
    assert any(k is None for k, *_ in near)


def test_group_medians_with_gaps_agree(spark):
    from platewise.operators.aggregate import group_medians

    nan = float("nan")
    rows = [(None, [1.0, None, 5.0]), (None, [3.0, 4.0, nan]), (None, [2.0, nan, 7.0]), ("p", [1.0, None, nan]), ("p", [2.0, None, 1.0])]
    df = spark.createDataFrame(rows, "plate string, features array<double>")
    read = lambda d: {r[0]: [same(v) for v in r[1]] for r in d.collect()}
    near = read(group_medians(df, ["plate"], True))
    assert near == read(group_medians(df, ["plate"], False)) == {None: [2.0, "nan", 7.0], "p": [1.5, None, "nan"]}
    whole = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "plate string, x double").select(
        "plate", F.array(F.coalesce("x", F.lit(0.0))).alias("features"))
    assert read(group_medians(whole, ["plate"], True)) == {"a": [2.0]}  # arrays that hold no NULL by schema
