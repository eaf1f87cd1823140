"""Readers and writers: every table goes out through a writer into the shared folder and comes back through a reader."""

import uuid

from pyspark.sql import functions as F

from platewise import columns as C
from platewise.catalog.inputs import PROFILES, profiles
from platewise.catalog.normalization import cells
from platewise.catalog.registry import derive, register, table, with_clause
from platewise.catalog.release import SITES, sites
from platewise.functions.keys import object_uri
from platewise.operators import aggregate, agreement, metadata, results, validate
from platewise.sources import readers, writers
from platewise.session import shared_folder


def folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/trip-{uuid.uuid4().hex}"


@register("profiles_round_trip", f"WITH {PROFILES} SELECT row_id, pos, round(value, 6) AS value FROM cells")
def profiles_round_trip(spark, sf_dir):
    path = folder(spark)
    writers.write_profiles(profiles(spark, sf_dir), path)
    return cells(readers.read_table(spark, path))


@register("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    path = folder(spark) + ".csv.gz"
    wanted = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    writers.write_profiles(wanted, path, "csv.gz")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return readers.read_table(spark, path, schema=types)


@register("refused_overwrite", "SELECT count(*) AS n, true AS refused FROM orders")
def refused_overwrite(spark, sf_dir):
    """A second write is refused, and the first table is still whole."""
    path, refused = folder(spark), False
    writers.write_profiles(table(spark, sf_dir, "orders"), path)
    try:
        writers.write_profiles(table(spark, sf_dir, "orders"), path)
    except Exception as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return readers.read_table(spark, path).agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


TREE = """
  SELECT 'm' || l_returnflag AS model, 'q' || l_linestatus AS codec, l_orderkey AS tile, l_linenumber AS label,
         'all' AS branch, 'm' || (l_partkey % 5) AS metric, l_quantity AS value FROM {lineitem}"""


def feature_tree(spark, sf_dir, codec=None):
    base = folder(spark)
    long = derive(spark, sf_dir, TREE)
    for model in ("mA", "mN", "mR"):  # one folder per model and codec, as extraction leaves them
        for kind in ("qF", "qO"):
            part = long.filter((F.col("model") == model) & (F.col("codec") == kind)).drop("model", "codec")
            part.write.parquet(f"{base}/{model}/set/{kind}/profiles")
    return readers.read_feature_tree(spark, base, codec=codec)


@register("feature_tree", with_clause(t=TREE) + """ SELECT model AS "Metadata_model", codec AS "Metadata_compression", metric,
  count(*) AS n, sum(value) AS total, 'dl_long' AS layout, true AS named FROM t GROUP BY ALL""")
def feature_tree_scan(spark, sf_dir):
    tree = feature_tree(spark, sf_dir)
    layout = readers.sniff_layout(tree)["layout"]
    return tree.groupBy("Metadata_model", "Metadata_compression", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.lit(layout).alias("layout"),
        F.min(F.col("filename").startswith("part-")).alias("named"))


@register("feature_tree_of_codec", with_clause(t=TREE) + """ SELECT model AS "Metadata_model", codec AS "Metadata_compression",
  count(*) AS n FROM t WHERE codec = 'qO' GROUP BY ALL""")
def feature_tree_of_codec(spark, sf_dir):
    return feature_tree(spark, sf_dir, "qO").groupBy("Metadata_model", "Metadata_compression").agg(F.count(F.lit(1)).alias("n"))


@register("site_tree", with_clause(s=SITES) + """ SELECT 'm-' || status AS model_codec,
  split_part("Metadata_Site_Key", '__', 1) AS "Metadata_Source", split_part("Metadata_Site_Key", '__', 3) AS "Metadata_Plate",
  count(*) AS n FROM s GROUP BY ALL""")
def site_tree(spark, sf_dir):
    path = folder(spark)
    status = derive(spark, sf_dir, SITES).select(C.SITE_KEY, F.col("status").alias("codec"))
    index = sites(spark, sf_dir).join(status, C.SITE_KEY).withColumn("model", F.lit("m"))
    writers.write_site_tree(index, path, "model", "codec", files_per_plate=2)
    return spark.read.parquet(path).groupBy("model_codec", C.SOURCE, C.PLATE).agg(F.count(F.lit(1)).alias("n"))


@register("published_order", "SELECT o_orderkey, o_custkey, true AS in_order FROM orders")
def published_order(spark, sf_dir):
    path = folder(spark)
    writers.publish_sorted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, ["o_custkey", "o_orderkey"])
    back = readers.read_table(spark, path).withColumn("file", F.col("_metadata.file_name"))
    spans = back.groupBy("file").agg(F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high")).collect()
    spans = sorted((r["file"], r["low"], r["high"]) for r in spans)
    ordered = all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    return back.select("o_orderkey", "o_custkey", F.lit(ordered).alias("in_order"))


@register("membership_rerun", """SELECT step, count(*) AS n FROM (SELECT 'raw' AS step, o_orderkey FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'kept', o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY step""")
def membership_rerun(spark, sf_dir):
    """A rerun of one step replaces that step only."""
    path, orders = folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    both = orders.withColumn("step", F.when(F.col("o_orderstatus") == "O", F.lit("kept")).otherwise(F.lit("raw")))
    writers.write_membership(both, path)
    writers.write_membership(orders.filter("o_orderstatus = 'F'").withColumn("step", F.lit("raw")), path)
    return spark.read.parquet(path).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@register("without_existing", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def without_existing(spark, sf_dir):
    there = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return writers.without_existing(table(spark, sf_dir, "orders"), there, ["o_custkey"]).select("o_orderkey")


@register("splits_file", "SELECT 'C' || doc_id AS key, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS split FROM labels")
def splits_file(spark, sf_dir):
    path = folder(spark) + ".csv"
    rows = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("C"), "doc_id").alias("inchikey"), F.when(F.col("quality") == 1, "train").otherwise("test").alias("fold"))
    writers.write_profiles(rows, path, "csv")
    df, key, split = readers.read_splits(spark, path)
    return df.select(F.col(key).alias("key"), F.col(split).alias("split"))


TIERS = """SELECT DISTINCT 'C' || l_partkey AS Metadata_JCP2022, 'G' || l_suppkey AS target, 'm' || (l_linenumber % 2) AS modality_clean,
  'Tier' || l_linenumber AS WithinModalityTier, 1 AS unused FROM {lineitem}"""


@register("tiers_file", with_clause(t=TIERS) + ' SELECT DISTINCT "Metadata_JCP2022", target, modality_clean, "WithinModalityTier" FROM t')
def tiers_file(spark, sf_dir):
    path = folder(spark)
    writers.write_profiles(derive(spark, sf_dir, TIERS), path)
    return readers.read_tiers(spark, path)


@register("index_files", """SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS "Orig_a", NULL AS "Orig_b" FROM supplier
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, p_name FROM part""")
def index_files(spark, sf_dir):
    path = folder(spark)
    writers.write_profiles(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS Orig_a", "s_acctbal AS other"), path + "/a", "csv")
    writers.write_profiles(table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_name AS Orig_b"), path + "/b", "csv")
    return readers.read_index(spark, [path + "/a", path + "/b"], "(key|Orig_.*)").select("key", "Orig_a", "Orig_b")


METRICS = """SELECT 'm' || l_returnflag AS model, 'c' || l_linenumber AS config, avg(l_discount) AS pa, CAST(max(l_quantity) AS BIGINT) AS n,
  min(l_tax) AS low FROM {lineitem} GROUP BY ALL"""


@register("metric_records", with_clause(t=METRICS) + """ SELECT model, config, 'PA' AS metric, round(pa, 9) AS value FROM t
  UNION ALL SELECT model, config, 'n', n FROM t UNION ALL SELECT model, config, 'PC_g1_mean', round(low, 9) FROM t""")
def metric_records(spark, sf_dir):
    rows = derive(spark, sf_dir, METRICS)
    text = F.to_json(F.struct(
        F.col("pa").alias("PA"), F.col("n"), F.lit("text").alias("note"),
        F.struct(F.struct(F.col("low").alias("mean")).alias("g1")).alias("PC_group_summary")))
    files = rows.select(F.concat(F.lit("file:/base/"), "model", F.lit("/"), "config", F.lit("/out/metrics.json")).alias("path"), text.alias("text"))
    return readers.flatten_metrics(files).select("model", "config", "metric", F.round("value", 9).alias("value"))


@register("metrics_table", with_clause(t=METRICS) + " SELECT model, config, round(pa, 9) AS PA, CAST(n AS DOUBLE) AS n FROM t")
def metrics_table(spark, sf_dir):
    rows = derive(spark, sf_dir, METRICS)
    files = rows.select(F.concat(F.lit("file:/base/"), "model", F.lit("/"), "config", F.lit("/out/metrics.json")).alias("path"),
                        F.to_json(F.struct(F.col("pa").alias("PA"), F.col("n"))).alias("text"))
    return readers.metrics_table(readers.flatten_metrics(files)).select("model", "config", F.round("PA", 9).alias("PA"), "n")


@register("recall_records", """WITH t AS (SELECT s_suppkey AS k, round(s_acctbal, 2) AS r FROM supplier)
SELECT 'fam' AS family, 'q' || (k % 3) AS codec, 'c' || k AS config, 'CC' AS task, NULL AS modality, 'g' AS "group", r AS recall_1, r + 1 AS recall_5, NULL::DOUBLE AS recall_10 FROM t
UNION ALL SELECT 'fam', 'q' || (k % 3), 'c' || k, 'GG', 'orf', NULL, r, r + 1, NULL FROM t""")
def recall_records(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "round(s_acctbal, 2) AS r")
    entry = lambda setting: F.struct(
        F.lit(setting).alias("setting"), F.lit("orf").alias("target_modality"), F.lit("g").alias("compound_group"),
        F.col("r").cast("string").alias("recall@1%"), (F.col("r") + 1).cast("string").alias("recall@5%"))
    task = lambda *settings: F.struct(F.array(*[entry(s) for s in settings]).alias("summary"))
    text = F.to_json(F.struct(task("any").alias("graph_CC"), task("full", "reduced").alias("graph_GG"), F.lit(3).alias("other")))
    path = F.concat(F.lit("file:/base/fam_lite_updated_q"), F.col("k") % 3, F.lit("_raw_features/c"), "k", F.lit("/out/recall.json"))
    return readers.recall_rows(rows.select(path.alias("path"), text.alias("text")), "lite")


# ---- joins and small operators without a query of their own -------------------------------


@register("merge_left", f"""WITH {PROFILES} SELECT p.row_id, coalesce(n.n_name, 'none') AS name, coalesce(CASE WHEN n.n_nationkey < 3 THEN 'negcon' ELSE 'trt' END, 'trt') AS kind,
  coalesce(n.n_nationkey < 3, false) AS negcon FROM profiles p LEFT JOIN nation n ON p.plate = 'plate' || n.n_nationkey AND p.well = 'W' || n.n_nationkey""")
def merge_left(spark, sf_dir):
    meta = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("plate"), "n_nationkey").alias(C.PLATE), F.concat(F.lit("W"), "n_nationkey").alias(C.WELL), F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") < 3, "negcon").otherwise("trt").alias(C.CONTROL_TYPE))
    out = metadata.merge_metadata(profiles(spark, sf_dir).drop(C.NEGCON), meta, how="left")
    return out.select(C.ROW_ID, F.coalesce("name", F.lit("none")).alias("name"), F.col(C.CONTROL_TYPE).alias("kind"), F.col(C.NEGCON).alias("negcon"))


@register("new_annotations", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def new_annotations(spark, sf_dir):
    notes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.lit("other").alias("c_name"))
    return metadata.add_annotations(table(spark, sf_dir, "customer"), notes, "c_nationkey").select("c_custkey", "c_name", "n_name")


RELEASE = """SELECT 's' || (o_custkey % 5) AS Metadata_Source, 'B' || (o_custkey % 3) AS Metadata_Batch, 'P' || (o_custkey % 7) AS Metadata_Plate,
  'W' || (o_custkey % 96) AS Metadata_Well, o_custkey AS Metadata_JCP2022, o_orderstatus AS status FROM {orders}"""
FROZEN = with_clause(r=RELEASE) + """, k AS (SELECT DISTINCT "Metadata_Source" AS a, "Metadata_Batch" AS b, "Metadata_Plate" AS c, "Metadata_Well" AS d FROM r WHERE status = 'F'),
p AS (SELECT DISTINCT r."Metadata_JCP2022" AS pert, a || '__' || b || '__' || c || '__' || d AS well FROM r JOIN k
  ON a = "Metadata_Source" AND b = "Metadata_Batch" AND c = "Metadata_Plate" AND d = "Metadata_Well")"""


def release_parts(spark, sf_dir):
    rows = derive(spark, sf_dir, RELEASE)
    return validate.release_perturbations(rows.drop("status").distinct(), rows.filter("status = 'F'"))


@register("release_perturbations", FROZEN + " SELECT pert, well FROM p")
def release_perturbations(spark, sf_dir):
    return release_parts(spark, sf_dir).select(F.col(C.PERT).alias("pert"), F.col("Metadata_Well_Key").alias("well"))


@register("release_annotations", FROZEN + " SELECT p_partkey FROM part WHERE p_partkey IN (SELECT pert FROM p)")
def release_annotations(spark, sf_dir):
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(C.PERT))
    return validate.release_annotations(notes, release_parts(spark, sf_dir)).select(F.col(C.PERT).alias("p_partkey"))


@register("counts_manifest", with_clause(r=RELEASE) + """ SELECT "Metadata_Source", "Metadata_Batch", "Metadata_Plate",
  count(DISTINCT "Metadata_Well") AS well_count, count(*) AS site_count FROM r GROUP BY ALL""")
def counts_manifest(spark, sf_dir):
    return aggregate.plate_manifest(derive(spark, sf_dir, RELEASE))


@register("object_uris", """SELECT s_suppkey, 's3://bucket/' || s_name || '/' || s_nationkey || '.tif' AS uri FROM supplier""")
def object_uris(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", object_uri("s3://bucket/%s/%s.tif", "s_name", F.col("s_nationkey").cast("string")).alias("uri"))


@register("short_models", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'm' || s_suppkey || '_q30' WHEN s_suppkey % 3 = 1 THEN 'm' || s_suppkey || '_raw' ELSE 'odd' || s_suppkey END AS model FROM supplier""")
def short_models(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("m"), k, F.lit("_lite_updated_q30_features"))).when(
        k % 3 == 1, F.concat(F.lit("m"), k, F.lit("_lite_raw_features"))).otherwise(F.concat(F.lit("odd"), k))
    return table(spark, sf_dir, "supplier").select("s_suppkey", results.short_model(name, "lite").alias("model"))


OBJECTS = "SELECT l_linestatus AS codec, 's' || (l_orderkey % 7) AS source_id, 'f' || (l_orderkey % 5) AS file, l_partkey % 200 AS label FROM {lineitem}"


@register("match_rate", with_clause(o=OBJECTS) + """, r AS (SELECT DISTINCT * FROM o)
SELECT codec, count(*) AS n_objects, count(*) FILTER (label % 3 > 0) AS matched, count(*) FILTER (label % 3 > 0) / count(*) AS match_rate FROM r GROUP BY codec""")
def match_rate(spark, sf_dir):
    objects = derive(spark, sf_dir, OBJECTS)
    mapping = objects.filter("label % 3 > 0").withColumnRenamed("label", "gt_id")
    return agreement.match_rate(objects, mapping, ["codec"])


@register("exploded_values", "SELECT l_orderkey, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_tax FROM lineitem")
def exploded_values(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_quantity", "l_tax").alias("values"))
    return aggregate.explode_values(listed)


@register("well_keys", "SELECT s_suppkey, 'a__b__' || s_nationkey || '__w' AS \"Metadata_id\" FROM supplier")
def well_keys(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("x/a__b__"), "s_nationkey", F.lit("__w__7.parquet")).alias("filename"))
    return aggregate.with_well_key(files).select("s_suppkey", "Metadata_id")


@register("first_profiles", with_clause(t=TREE) + """ SELECT model AS top, count(*) AS n, round(sum(value), 2) AS total FROM t WHERE codec = 'qF' GROUP BY model""")
def first_profiles(spark, sf_dir):
    """Of the folders below each model only the first codec's profiles count."""
    base = folder(spark)
    long = derive(spark, sf_dir, TREE)
    for model in ("mA", "mN", "mR"):
        for kind in ("qF", "qO"):
            long.filter((F.col("model") == model) & (F.col("codec") == kind)).drop("model", "codec").write.parquet(
                f"{base}/{model}/set/{kind}/profiles")
    return readers.first_profiles(spark, base).groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


MAPPINGS = """SELECT 's' || (l_suppkey % 20) AS source_id, 'method' || (l_linenumber % 3) AS method, l_partkey AS gt_id, l_tax AS iou_score FROM {lineitem}"""


@register("instance_mapping_files", with_clause(m=MAPPINGS) + """ SELECT method, source_id, count(*) AS n, round(sum(iou_score), 2) AS total FROM m GROUP BY ALL""")
def instance_mapping_files(spark, sf_dir):
    """Mappings of several methods, a name each, read as one table."""
    base = folder(spark)
    rows = derive(spark, sf_dir, MAPPINGS)
    for method in ("method0", "method1", "method2"):
        rows.filter(F.col("method") == method).drop("method").write.parquet(f"{base}/{method}.parquet")
    return readers.read_instance_mappings(spark, f"{base}/*.parquet").groupBy("method", "source_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("iou_score"), 2).alias("total"))


DETAILED = """SELECT 'file' || (l_suppkey % 50) AS file, CASE WHEN l_returnflag = 'A' THEN 'cell' ELSE 'nuclei' END AS object_type,
  'q' || l_linestatus AS codec, l_quantity AS dice FROM {lineitem}"""


@register("detailed_files", with_clause(d=DETAILED) + """ SELECT object_type, codec, file, count(*) AS n, round(avg(dice), 6) AS dice FROM d GROUP BY ALL""")
def detailed_files(spark, sf_dir):
    """Per-site csv results whose file names hold the object type and the codec."""
    base = folder(spark)
    rows = derive(spark, sf_dir, DETAILED)
    for kind in ("cell", "nuclei"):
        for codec in ("qF", "qO"):
            rows.filter((F.col("object_type") == kind) & (F.col("codec") == codec)).select("file", "dice").write.option(
                "header", True).csv(f"{base}/{kind}_{codec}.csv")
    return readers.read_detailed(spark, f"{base}/*.csv").groupBy("object_type", "codec", "file").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("dice"), 6).alias("dice"))
