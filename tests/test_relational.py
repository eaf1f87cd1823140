import json

import pytest
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions import keys as K
from platewise.operators import agreement, annotations, metadata, select, validate
from platewise.operators import results as R
from platewise.operators.packed import pack, unpack
from platewise.plans.steps import config_name, run_steps
from platewise.sources import readers, writers
from platewise.streaming.ingest import append_new, held_keys, ingest_available, key_ranges, site_stream


def test_malformed_site_key_is_an_error(spark):
    good = spark.createDataFrame([("s__b__p__w__3",)], "Metadata_Site_Key string")
    assert K.with_site_columns(good).first()["Metadata_Site"] == 3
    bad = spark.createDataFrame([("s__b__p__w",)], "Metadata_Site_Key string")
    with pytest.raises(Exception, match="malformed site key"):
        K.with_site_columns(bad).collect()


def test_pack_round_trip_and_subset(spark):
    df = spark.createDataFrame([("a", 1.0, "t", 2, None)], "Metadata_x string, f1 double, note string, f2 int, f3 double")
    p = pack(df)
    assert p.names == ["f1", "f2", "f3"] and "note" in p.df.columns
    assert unpack(p).first()["f2"] == 2.0
    assert p.keep(["f1", "f3"]).df.first()["features"] == [1.0, None]
    assert p.keep(["f3", "f1"]).df.first()["features"] == [None, 1.0]


def test_filter_chain_restores_all_when_empty(spark):
    p = pack(spark.createDataFrame([(float(i), float(i * i)) for i in range(30)], "Location_Center_X double, Location_Max_Y double"))
    out, report = select.filter_features(p, [{"name": "blocklist"}])
    assert out.names == p.names and report[0]["restored"]


def test_independent_set_prefers_low_degree():
    # a star: the centre goes, the leaves stay
    assert select.independent_set(4, [(0, 1), (0, 2), (0, 3)]) == [1, 2, 3]


def test_hub_target_edges_are_complete(spark):
    rows = [(f"c{i}", "hub") for i in range(50)] + [("c0", "x"), ("c1", "x")]
    out = annotations.bridged_edges(spark.createDataFrame(rows, "Metadata_JCP2022 string, target string"), block=8)
    assert out.count() == 50 * 49 == out.distinct().count()


def test_unmapped_action_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(annotations, "CG_ULTRA", ["odd"])
    cg = spark.createDataFrame([("g", "odd", "K-1")], "target string, rel_type string, inchikey string")
    st = spark.createDataFrame([("K", "c")], "InChIKey_Connectivity string, Metadata_JCP2022 string")
    with pytest.raises(Exception, match="no action class"):
        annotations.curated_targets(cg, st, "ultra").collect()


def test_tiers_fall_through_without_strong_evidence(spark):
    rows = [("c1", "t1", "gene", "Positive", 2), ("c2", "t2", "gene", "Positive", 7), ("c2", "t3", "protein", "Positive", 9)]
    df = spark.createDataFrame(rows, "Metadata_JCP2022 string, target string, target_type string, mode string, support int")
    got = {r["target"]: r["CrossModalityTier"] for r in annotations.tier_annotate(df).collect()}
    assert got == {"t1": "Tier3", "t2": "Tier0"}


def test_replicate_filter_keeps_controls(spark):
    rows = [("source_2", "a", "trt")] * 3 + [("source_2", "ctl", "negcon"), ("source_4", "g", "trt")]
    df = spark.createDataFrame(rows, "Metadata_Source string, Metadata_JCP2022 string, Metadata_control_type string")
    got = {r["Metadata_JCP2022"] for r in metadata.replicate_filter(df, 4).collect()}
    assert got == {"ctl", "g"}


def test_merge_metadata_is_deterministic(spark):
    prof = spark.createDataFrame([("s", "p", "w", "old", 1.0)], "Metadata_Source string, Metadata_Plate string, Metadata_Well string, Metadata_x string, f double")
    meta = spark.createDataFrame([("s", "p", "w", "b", None), ("s", "p", "w", "a", None)],
                                 "Metadata_Source string, Metadata_Plate string, Metadata_Well string, Metadata_x string, Metadata_control_type string")
    row = metadata.merge_metadata(prof, meta, order=["Metadata_x"]).first()
    assert row["Metadata_x"] == "a" and row["Metadata_control_type"] == "trt" and row["Metadata_negcon"] is False


def test_selection_ignores_missing_scores_and_falls_back(spark):
    rows = [("f", "zstd", "a", 5.0), ("f", "zstd", "b", float("nan")), ("f", "hq", "b", 2.0), ("f", "hq", "c", None)]
    df = spark.createDataFrame(rows, "family string, codec string, config string, score double")
    got = {r["codec"]: r["config"] for r in R.select_best(df, mode="zstd_reference").collect()}
    assert got == {"zstd": "a", "hq": "b"}


def test_vanishing_baseline_gives_no_percent(spark):
    rows = [("f", "raw", "c", "T", None, None, 0.0), ("f", "hq", "c", "T", None, None, 0.5)]
    df = spark.createDataFrame(rows, "family string, codec string, config string, task string, modality string, `group` string, v double")
    out = R.percent_deltas(R.build_deltas(df, "v", ["raw"]), ["codec"]).first()
    assert out["n"] == 0 and out["mean"] is None


def test_config_name_round_trip(spark):
    steps = [
        {"name": "normalize_standardize", "params": {"fit_on_controls": True}},
        {"name": "filter_features", "params": {"operations": [{"name": "drop_outliers", "outlier_cutoff": 100}]}},
        {"name": "inverse_normal_transform"}, {"name": "prune_correlated", "params": {"threshold": 0.9}},
        {"name": "normalize_pca", "params": {"n_components": 64}},
        {"name": "normalize_spherize", "params": {"method": "ZCA-cor", "batch_col": "", "epsilon": 1e-4, "fit_on_controls": True}},
    ]
    name = config_name(steps)
    assert name == "std_ctrl__outlier100__INT__prune0.9__pca64__ZCA-cor_global_ctrl_e4"
    got = spark.createDataFrame([(name,)], "config string").select(
        *[v.alias(k) for k, v in R.config_settings("config").items()]).first()
    assert got["norm_method"] == "standardize" and got["outlier_cutoff"] == 100 and got["use_int"]
    assert got["pca_components"] == 64 and got["batch_method"] == "spherize_global" and got["spherize_epsilon"] == pytest.approx(1e-4)


def test_steps_run_in_order_and_stop_on_invalid(spark, profiles):
    from platewise.operators.packed import Profiles

    start = Profiles(profiles, [f"f{i}" for i in range(6)])
    out, report = run_steps(start, [
        {"name": "normalize_standardize"}, {"name": "prune_correlated", "params": {"threshold": 0.99}},
        {"name": "normalize_tvn_efaar", "params": {"n_components": 3}}])
    assert [r["step"] for r in report] == ["normalize_standardize", "prune_correlated", "normalize_tvn_efaar"]
    assert out.names == ["PC_0", "PC_1", "PC_2"] and out.df.count() == 240
    broken = Profiles(profiles.withColumn("features", F.transform("features", lambda x: F.lit(float("nan")))), start.names)
    with pytest.raises(ValueError, match="invalid"):
        run_steps(broken, [{"name": "sample_norm"}])


def test_profile_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "Metadata_x string, f double")
    for fmt in ("parquet", "csv", "csv.gz"):
        path = str(tmp_path / f"t.{fmt}")
        writers.write_profiles(df, path, fmt)
        assert readers.read_table(spark, path, None if fmt != "parquet" else "parquet").first()["f"] == 1.5
        with pytest.raises(Exception):
            writers.write_profiles(df, path, fmt)
        writers.write_profiles(df, path, fmt, force=True)


def test_feature_tree_and_layout(spark, tmp_path):
    schema = "tile int, label long, branch string, metric string, value double, object string, tp int"
    for codec in ("hq", "mq"):
        for site in ("s__b__p__w__1", "s__b__p__w__2"):
            path = str(tmp_path / "m1" / "d1" / codec / "profiles" / f"{site}.parquet")
            spark.createDataFrame([(0, 1, "x", "Area", 1.0, "cell", 0)], schema).coalesce(1).write.parquet(path)
    one = readers.read_table(spark, str(tmp_path / "m1" / "d1" / "hq" / "profiles" / "s__b__p__w__1.parquet"))
    assert readers.sniff_layout(one)["layout"] == "cp_long"
    assert readers.sniff_layout(one.withColumn("object", F.lit("image")))["layout"] == "dl_long"
    assert readers.sniff_layout(one.drop("metric"))["layout"] == "wide"


def test_metric_records(spark, tmp_path):
    folder = tmp_path / "sweep" / "m_data_updated_hq_raw_features" / "cfg" / "results"
    folder.mkdir(parents=True)
    record = {"PA": 12.5, "ok": True, "PA_group_summary": {"group_orf": {"pct_active": 3.0}},
              "G_CC": {"summary": [{"compound_group": "group_high", "recall@1%": 0.1, "recall@5%": 0.2, "recall@10%": 0.3}]},
              "G_GG": {"summary": [{"setting": "filtered", "target_modality": "orf", "recall@5%": 0.9},
                                   {"setting": "full", "target_modality": "orf", "recall@5%": 0.4}]}}
    (folder / "metrics.json").write_text(json.dumps(record))
    files = readers.json_files(spark, str(tmp_path / "sweep"))
    wide = readers.metrics_table(readers.flatten_metrics(files)).first()
    assert wide["PA"] == 12.5 and wide["PA_group_orf_pct_active"] == 3.0 and wide["config"] == "cfg"
    rows = {r["task"]: r for r in readers.recall_rows(files, "data").collect()}
    assert rows["CC"]["group"] == "group_high" and rows["CC"]["codec"] == "hq" and rows["CC"]["recall_10"] == 0.3
    assert rows["GG"]["recall_5"] == 0.4 and rows["GG"]["group"] is None


def test_splits_and_tiers_need_their_columns(spark, tmp_path):
    path = str(tmp_path / "splits.csv")
    spark.createDataFrame([("c", "test")], "JCP2022 string, fold string").write.option("header", True).csv(path)
    _, key, split = readers.read_splits(spark, path)
    assert (key, split) == ("JCP2022", "fold")
    with pytest.raises(ValueError, match="lack"):
        readers.read_tiers(spark, path)


def test_ingest_is_idempotent_and_incremental(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    schema = "key string, plate string, v int"
    spark.createDataFrame([("a", "p", 1), ("b", "p", 2), ("a", "p", 9)], schema).coalesce(1).write.parquet(str(source / "one"))
    run = lambda log: ingest_available(
        site_stream(spark, str(source), spark.createDataFrame([], schema).schema), sink, str(tmp_path / log), ["key"], ["plate"])
    run("log")
    spark.createDataFrame([("b", "p", 5), ("c", "q", 3)], schema).coalesce(1).write.parquet(str(source / "two"))
    run("log")
    run("other")  # a lost log replays everything
    got = spark.read.parquet(sink)
    assert {r["key"] for r in got.collect()} == {"a", "b", "c"} and got.count() == 3


def test_digests_ignore_order_and_find_changes(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    again = df.orderBy(F.desc("key")).repartition(7).unionByName(df.limit(3))
    assert validate.key_digest(df, "key").first() == validate.key_digest(again, "key").first()
    assert validate.sorted_digest(df, "key", 16).first() == validate.sorted_digest(again, "key", 16).first()
    fewer = df.filter("key <> 'k7'")
    assert validate.sorted_digest(df, "key", 16).first() != validate.sorted_digest(fewer, "key", 16).first()


def test_checks_report_every_failure(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "k int, v string")
    out = validate.report([validate.distinct_check(df, "distinct", "k"), validate.none_check(df, "present", F.col("v").isNull()),
                           validate.count_check(df, "count", 2)])
    assert {r["check"]: r["ok"] for r in out.collect()} == {"distinct": False, "present": False, "count": True}
    with pytest.raises(ValueError, match="distinct.*present"):
        validate.require(out)


def test_observed_gate_rides_along(spark, profiles):
    watched, seen = validate.observe_invalid(profiles, "x")
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get["n_invalid"] == 0


def test_distribution_distance_properties(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", float(i + 5)) for i in range(10)] + [("a", float("nan"))]
    df = spark.createDataFrame(rows, "side string, value double").withColumn("k", F.lit(1))
    row = agreement.distribution_distance(df, ["k"]).first()
    assert row["ks_stat"] == pytest.approx(0.5) and row["variance_ratio"] == pytest.approx(1.0)
    assert row["wasserstein_norm"] == pytest.approx(row["cohens_d"])  # a pure shift
    few = agreement.distribution_distance(df.filter("value < 4 or side = 'b'"), ["k"]).first()
    assert few["ks_stat"] is None


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 3.0)], "k int, value_ref double, value_codec double")
    got = {r["k"]: r["r"] for r in agreement.pair_correlation(df, ["k"]).collect()}
    assert got[1] is None and got[2] == pytest.approx(1.0)


def test_sorted_and_partitioned_sinks(spark, tmp_path):
    rows = [("m", "hq", "s", "b", f"p{i % 2}", f"w{i}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "Metadata_model string, Metadata_compression string, Metadata_Source string, "
                                     "Metadata_Batch string, Metadata_Plate string, Metadata_Well string, Metadata_Site long")
    writers.publish_sorted(df, str(tmp_path / "sorted"), ["Metadata_Site"])
    assert spark.read.parquet(str(tmp_path / "sorted")).count() == 20
    writers.write_site_tree(df, str(tmp_path / "tree"))
    back = spark.read.parquet(str(tmp_path / "tree"))
    assert back.filter("model_codec = 'm-hq' and Metadata_Plate = 'p1'").count() == 10
    new = writers.without_existing(df, back.filter("Metadata_Site < 15"), ["Metadata_Site"])
    assert new.count() == 5


def test_membership_rerun_replaces_its_steps_only(spark, tmp_path):
    path = str(tmp_path / "steps")
    ids = spark.createDataFrame([("a",), ("b",)], "Metadata_JCP2022 string")
    writers.write_membership(metadata.membership({"one": ids, "two": ids}), path)
    writers.write_membership(metadata.membership({"two": ids.limit(1)}), path)
    got = metadata.membership_profile(spark.read.parquet(path)).collect()
    assert sum(r["n"] for r in got) == 2 and spark.read.parquet(path).count() == 3


def test_exact_join_refuses_what_is_not_one_to_one(spark):
    import pytest

    from platewise.operators import validate as V

    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (2, None)], "k int, y int")
    assert sorted(map(tuple, V.exact_join(left, right, ["k"]).collect())) == [(1, "a", 10), (2, "b", None)]
    more = right.unionByName(spark.createDataFrame([(3, 30)], "k int, y int"))
    assert V.exact_join(left, more, ["k"], surplus=True).count() == 2
    for bad_left, bad_right, surplus in (
            (left, more, False), (left.unionByName(left), right, True), (left, right.unionByName(right), True), (left, right.filter("k = 1"), True)):
        with pytest.raises(Exception, match="rows of key"):
            V.exact_join(bad_left, bad_right, ["k"], surplus).select("k").collect()


def test_row_wise_steps_are_written_once(spark, profiles, monkeypatch):
    """Writes are counted: one before the fit, one at the end; the gates are read from them."""
    import pytest

    from platewise.operators.packed import Profiles
    from platewise.plans import steps

    written = []
    real = steps.cut_lineage
    monkeypatch.setattr(steps, "cut_lineage", lambda df: written.append(1) or real(df))
    chain = [{"name": "sample_norm"}, {"name": "well_position_correct"}, {"name": "normalize_standardize"}, {"name": "sample_norm"}]
    names = [f"f{i}" for i in range(6)]
    out, report = steps.run_steps(Profiles(profiles, names), chain)
    assert len(written) == 2 and out.df.count() == 240
    assert [(r["step"], r["n_nan"], r["n_null"], r["n_inf"]) for r in report] == [(s["name"], 0, 0, 0) for s in chain]
    spoiled = profiles.withColumn("features", F.transform("features", lambda x: F.when(F.col("row_id") == 5, float("nan")).otherwise(x)))
    with pytest.raises(ValueError, match="sample_norm left invalid values"):
        steps.run_steps(Profiles(spoiled, names), chain)


def rows_scanned(df):
    """Rows that the scan of a collected frame without shuffles gave out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_ingest_reads_only_key_ranges_of_the_batch(spark, tmp_path):
    sink = str(tmp_path / "sink")
    write = append_new(sink, ["site", "part"], ["plate"])
    frame = lambda rows: spark.createDataFrame(rows, "site string, part int, plate string, value int")
    for plate in "ABC":
        write(frame([(f"{plate}{i:03d}", i % 2, plate, i) for i in range(100)]), 0)
    batch = frame([("B007", 1, "Z", 0), ("B007", 0, "B", 1), ("B200", 0, "B", 2), ("B200", 0, "B", 2)])
    held = held_keys(spark.read.parquet(sink), batch, ["site", "part"])
    assert rows_scanned(held) <= 100
    assert {tuple(r) for r in held.collect()} >= {("B007", 1)}
    write(batch, 1)
    back = spark.read.parquet(sink)
    # the key that comes again under another plate stays out
    assert back.count() == 302 and back.filter("plate = 'Z'").count() == 0
    write(batch, 1)
    assert spark.read.parquet(sink).count() == 302
    write(frame([]), 2)
    assert spark.read.parquet(sink).count() == 302


def test_key_ranges_cover_all_values(spark):
    values = [None, 5, 1, 1, 9, 200, 300]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    ranges = key_ranges(df, "key", 4)
    assert 1 <= len(ranges) <= 4
    assert all(any(a <= v <= b for a, b in ranges) for v in values if v is not None)
    assert all(x[1] < y[0] for x, y in zip(ranges[:-1], ranges[1:]))
    assert key_ranges(df.filter("key IS NULL"), "key") == []


def test_curated_wells_starts_from_written_steps(spark):
    """the annotation tables are not read anew for every step that starts from the structures."""
    from platewise.catalog import QUERIES

    for name, reads in (("curated_wells", 1), ("curation_steps", 0)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation [" in line and "l_partkey" in line for line in plan.split("\n")) == reads, name
