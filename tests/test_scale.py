"""Findings of the runs on larger tables."""

from pyspark.sql import functions as F

from platewise.operators import agreement as G
from platewise.operators import annotations as A
from platewise.operators import normalize as N
from platewise.sources import readers


def test_constant_sides_do_not_vary_over_many_tasks(spark):
    """partial deviations of a constant in tasks of 49 rows merge to a tiny number, which is no deviation."""
    rows = spark.range(0, 147, 1, 3).select(
        F.lit("f").alias("feature"), F.lit(1.0).alias("a"), (F.col("id") * 1.5).alias("b"), F.lit(2.0).alias("c"))
    got = G.pair_correlation(rows, ["feature"], "a", "b", medians=False).first()
    assert got["std_ref"] == 0 and got["r"] is None and got["n_valid"] == 147
    assert G.pair_correlation(rows, ["feature"], "b", "b", medians=False).first()["r"] > 0.999999
    sides = rows.select("feature", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("value")),
                                                     F.struct(F.lit("b").alias("side"), F.col("c").alias("value"))))
                        .alias("x")).select("feature", "x.*")
    assert G.distribution_distance(sides, ["feature"]).first()["cohens_d"] == 0


def test_bands_of_features_give_the_models_of_whole_rows(spark, profiles, monkeypatch):
    """no call holds more features of a group than a band, and NaN stays in its feature."""
    odd = profiles.withColumn("features", F.when(F.col("row_id") == 5, F.transform(
        "features", lambda x, i: F.when(i == 2, float("nan")).otherwise(x))).otherwise(F.col("features")))
    read = lambda: {r["grp"]: str([r["center"], r["scale"]]) for r in N.mad_model(odd, "Metadata_Plate", None).collect()}
    whole = read()
    monkeypatch.setattr(N, "BAND_BYTES", 60 * 8 * 4)  # four features of the 60 rows of a plate
    assert read() == whole and any("nan" in v for v in whole.values())
    cut = N.feature_bands(N.fit_rows(odd, "Metadata_Plate", None), 6, 60)
    sizes = {r[0]: (r[1], r[2]) for r in cut.groupBy("band").agg(F.min(F.size("features")), F.max(F.size("features"))).collect()}
    assert sizes == {0: (4, 4), 1: (2, 2)}


def test_gene_pairs_are_resolved_once_and_distinct_after_they_met(spark, monkeypatch):
    """both directions come from one distinct edge; ids with two symbols give no edge twice."""
    pairs = spark.createDataFrame([("A", "B", "ppi"), ("B", "A", "ppi"), ("A", "C", "x"), ("C", None, "x"), ("C", "B", "x"), ("A", "A", "x")],
                                  "target_a string, target_b string, rel_type string")
    meta = spark.createDataFrame([("j1", "orf", "A"), ("j2", "orf", "B"), ("j2", "orf", "C"), ("j0", "orf", "C"), ("k", "crispr", "A")],
                                 "Metadata_JCP2022 string, Metadata_Perturbation_Type string, Metadata_Symbol string")
    monkeypatch.setattr(A, "PAIRS_PER_TASK", 1)
    edges = A.gg_edges(pairs, meta)
    got = sorted((r["Metadata_JCP2022"], r["partner_jcp"], r["target_modality"]) for r in edges.collect())
    assert got == sorted((a, b, "orf") for x, y in (("j1", "j2"), ("j0", "j1"), ("j0", "j2")) for a, b in ((x, y), (y, x)))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("RepartitionByExpression") == 2


def test_mappings_written_in_parts_keep_the_name_of_their_folder(spark, tmp_path):
    """a method need not be one file, which one task would have to write."""
    rows = spark.range(0, 40, 1, 4)
    rows.write.parquet(f"{tmp_path}/my method+1.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/x")
    next((tmp_path / "x").glob("part-*")).rename(tmp_path / "part-single.parquet")
    got = readers.read_instance_mappings(spark, f"{tmp_path}/*.parquet").groupBy("method").count().collect()
    assert sorted(map(tuple, got)) == [("my method+1", 40), ("part-single", 40)]
    rows.write.option("header", True).csv(f"{tmp_path}/cell_q.csv")
    got = readers.read_detailed(spark, f"{tmp_path}/*.csv").groupBy("object_type", "codec").count().collect()
    assert list(map(tuple, got)) == [("cell", "q", 40)]
