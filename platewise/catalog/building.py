"""Profile building, aggregation and feature selection."""

import uuid

from pyspark.sql import functions as F

from platewise import columns as C
from platewise.catalog.inputs import LONG, PROFILES, WELL, WIDE, profiles
from platewise.catalog.registry import derive, register, table, with_clause
from platewise.functions.expressions import is_valid
from platewise.functions.keys import well_key_of_file, with_site_columns
from platewise.operators import aggregate as A
from platewise.operators import select as S
from platewise.operators.moments import gram_edges
from platewise.operators.packed import Profiles, numeric_columns, pack, to_long, unpack, wide_to_tidy
from platewise.session import shared_folder

NAMES = ["0/max/Area", "0/max/Intensity", "0/max/Perimeter", "0/max/Texture",
         "1/max/Area", "1/max/Intensity", "1/max/Perimeter", "1/max/Texture"]
KEY = "array_to_string(string_split(site, '__')[1:4], '__')"
LONG_CTE = with_clause(base=LONG) + f", long AS (SELECT *, {KEY} AS well FROM base)"


def long(spark, sf_dir):
    return derive(spark, sf_dir, LONG).withColumn("well", well_key_of_file(F.col("site")))


def pivot_sql(value: str, names: list[str], name: str, keys: str) -> str:
    cells = ", ".join(f"round({value} FILTER (WHERE {name} = '{n}'), 6) AS \"{n}\"" for n in names)
    return f"SELECT {keys}, {cells} FROM long GROUP BY {keys}"


def rounded(df, names):
    return df.select(*[c for c in df.columns if c not in names], *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in names])


@register("long_to_wide_embedding", f"{LONG_CTE} {pivot_sql('median(value)', NAMES, 'branch || metric', 'well')}")
def long_to_wide_embedding(spark, sf_dir):
    return rounded(A.embedding_profiles(long(spark, sf_dir), NAMES, "well"), NAMES)


OBJECT_NAMES = [f"{o}_{n}" for o in ("cell", "nuclei") for n in NAMES]


@register("long_to_wide_objects",
          f"{LONG_CTE} {pivot_sql('median(value)', OBJECT_NAMES, chr(39).join(['object || ', '_', ' || branch || metric']), 'well')}")
def long_to_wide_objects(spark, sf_dir):
    return rounded(A.object_profiles(long(spark, sf_dir), OBJECT_NAMES, "well"), OBJECT_NAMES)


@register("long_to_packed", f"""{LONG_CTE}, m AS (
  SELECT well, branch || metric AS name, median(value) AS v FROM long GROUP BY 1, 2)
SELECT well, name, round(v, 6) AS value FROM m""")
def long_to_packed(spark, sf_dir):
    df = long(spark, sf_dir).withColumn("name", F.concat("branch", "metric"))
    packed = A.packed_profiles(df, ["well"], "name", NAMES)
    names = F.array(*[F.lit(n) for n in NAMES])
    return to_long(packed).filter("value is not null").select(
        "well", names[F.col("pos")].alias("name"), F.round("value", 6).alias("value"))


@register("object_counts", f"""{LONG_CTE}
SELECT well, count(DISTINCT CASE WHEN object = 'cell' THEN label END) AS n_cells,
       count(DISTINCT CASE WHEN object = 'nuclei' THEN label END) AS n_nuclei,
       count(DISTINCT CASE WHEN object = 'cell' THEN (site, label) END) AS n_cells_by_site
FROM long GROUP BY well""")
def object_counts(spark, sf_dir):
    df = long(spark, sf_dir)
    plain = A.object_counts(df, ["well"], {"cell": "n_cells", "nuclei": "n_nuclei"})
    by_site = A.object_counts(df, ["well"], {"cell": "n_cells_by_site"}, within=["site"])
    return plain.join(by_site, "well")


@register("site_means", f"{LONG_CTE} {pivot_sql('avg(value)', NAMES, 'branch || metric', 'site, object')}")
def site_means(spark, sf_dir):
    df = A.site_means(long(spark, sf_dir), NAMES, ["site", "object"], F.concat("branch", "metric"))
    return rounded(df, NAMES)


@register("tile_means", """SELECT l_suppkey AS well, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax
FROM lineitem GROUP BY l_suppkey""")
def tile_means(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "well")
    return rounded(A.tile_means(df, ["well"], ["l_quantity", "l_tax"]), ["l_quantity", "l_tax"])


@register("diagonal_union", """SELECT o_orderkey AS id, o_totalprice AS a, NULL::DOUBLE AS b FROM orders
UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer""")
def diagonal_union(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b"))
    return A.diagonal_union([left, right])


CONSENSUS = f"""WITH {PROFILES} SELECT pert, grp, pos, round(median(value), 6) AS value
FROM cells GROUP BY pert, grp, pos"""


@register("consensus_median", CONSENSUS)
def consensus_median(spark, sf_dir):
    return to_long(A.consensus(profiles(spark, sf_dir))).select(
        F.col(C.PERT).alias("pert"), F.col(C.GROUP).alias("grp"), F.col("pos").cast("bigint").alias("pos"),
        F.round("value", 6).alias("value"))


@register("consensus_median_ranged", CONSENSUS)
def consensus_median_ranged(spark, sf_dir):
    """The same medians by value ranges, the way groups too large for a task are treated."""
    from platewise.operators.blocks import ranged_median

    flat = to_long(profiles(spark, sf_dir), [C.PERT, C.GROUP])
    return ranged_median(flat, [C.PERT, C.GROUP, "pos"]).select(
        F.col(C.PERT).alias("pert"), F.col(C.GROUP).alias("grp"), F.col("pos").cast("bigint").alias("pos"),
        F.round("median", 6).alias("value"))


@register("aggregate_strata", f"""WITH {PROFILES}, first AS (
  SELECT plate, well, min(pert) AS pert FROM profiles GROUP BY plate, well)
SELECT plate, well, pert, pos, round(avg(value), 6) AS value
FROM (SELECT c.plate, c.well, f.pert, pos, value FROM cells c JOIN first f ON c.plate = f.plate AND c.well = f.well)
GROUP BY ALL""")
def aggregate_strata(spark, sf_dir):
    df = A.aggregate_strata(profiles(spark, sf_dir), [C.PLATE, C.WELL], "mean", [C.PERT])
    return to_long(df).select(
        F.col(C.PLATE).alias("plate"), F.col(C.WELL).alias("well"), F.col(C.PERT).alias("pert"),
        F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@register("plate_manifest", f"""{LONG_CTE}, k AS (
  SELECT DISTINCT string_split(site, '__') AS p FROM long)
SELECT p[1] AS "Metadata_Source", p[2] AS "Metadata_Batch", p[3] AS "Metadata_Plate",
       count(DISTINCT p[4]) AS well_count, count(*) AS site_count FROM k GROUP BY 1, 2, 3""")
def plate_manifest(spark, sf_dir):
    return A.plate_manifest(with_site_columns(long(spark, sf_dir).select("site").distinct(), "site"))


@register("count_features", f"""{LONG_CTE} SELECT well AS "Metadata_id",
  CAST(count(DISTINCT CASE WHEN object = 'cell' THEN label END) AS DOUBLE) AS "Cells_Count" FROM long GROUP BY well""")
def count_features(spark, sf_dir):
    counts = A.object_counts(long(spark, sf_dir), ["well"], {"cell": "Metadata_n_cells"})
    return A.count_features(counts.withColumnRenamed("well", "Metadata_id"), nuclei=None)


@register("wide_to_tidy", """SELECT l_orderkey, name, value FROM (
  SELECT l_orderkey, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_tax))""")
def wide_to_tidy_query(spark, sf_dir):
    return wide_to_tidy(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_quantity", "l_tax"], "name", "value")


BOXES = """
  SELECT 'W' || (l_suppkey % 10) AS well, 'file' || (l_suppkey % 30) AS filename, l_partkey AS label, 'cell' AS object,
         CASE WHEN l_linenumber % 4 = 0 THEN 'BoundingBoxMinimum_X' WHEN l_linenumber % 4 = 1 THEN 'BoundingBoxMinimum_Y'
              WHEN l_linenumber % 4 = 2 THEN 'BoundingBoxMaximum_X' ELSE 'BoundingBoxMaximum_Y' END AS metric,
         CASE WHEN l_linenumber % 4 < 2 THEN l_quantity - 3 ELSE l_quantity + 40 END AS value, l_orderkey AS obs
  FROM {lineitem}"""


@register("interior_objects", with_clause(long=BOXES) + """, b AS (
  SELECT well, filename, label, object,
         max(CASE WHEN metric = 'BoundingBoxMinimum_X' THEN value END) AS min_x,
         max(CASE WHEN metric = 'BoundingBoxMinimum_Y' THEN value END) AS min_y,
         max(CASE WHEN metric = 'BoundingBoxMaximum_X' THEN value END) AS max_x,
         max(CASE WHEN metric = 'BoundingBoxMaximum_Y' THEN value END) AS max_y
  FROM long GROUP BY ALL), d AS (SELECT filename, max(max_x) AS w, max(max_y) AS h FROM b GROUP BY filename)
SELECT l.filename, l.label, l.metric, l.value, l.obs FROM long l SEMI JOIN (
  SELECT b.* FROM b JOIN d USING (filename) WHERE min_x > 0 AND min_y > 0 AND max_x < w AND max_y < h) i
ON l.well = i.well AND l.filename = i.filename AND l.label = i.label AND l.object = i.object""")
def interior_objects(spark, sf_dir):
    df = S.interior_objects(derive(spark, sf_dir, BOXES), ident=["well", "filename", "label", "object"])
    return df.select("filename", "label", "metric", "value", "obs")


@register("large_objects", with_clause(long=LONG) + """
SELECT l.* FROM long l SEMI JOIN (SELECT site, label, object FROM long WHERE metric = 'Area'
  GROUP BY ALL HAVING max(value) >= 20) b ON l.site = b.site AND l.label = b.label AND l.object = b.object""")
def large_objects(spark, sf_dir):
    return S.large_objects(derive(spark, sf_dir, LONG), 20, ["site", "label", "object"], size="Area")


# ---- selection ---------------------------------------------------------------------


def wide(spark, sf_dir) -> Profiles:
    df = derive(spark, sf_dir, WIDE)
    return pack(df.withColumnsRenamed({"row_id": "Metadata_row", "plate": C.PLATE}))


COLUMNS = ["f_quantity", "f_price", "f_discount", "f_sparse", "f_nan", "f_inf", "f_constant", "f_rare", "f_copy",
           "Location_Center_X"]
LONG_WIDE = with_clause(wide=WIDE) + ", long AS (" + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS feature, {i} AS pos, {c} AS value FROM wide" for i, c in enumerate(COLUMNS)) + ")"
VALID = "(value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))"


def named(profiles: Profiles, stats):
    names = F.array(*[F.lit(n) for n in profiles.names])
    return stats.withColumn("feature", names[F.col("pos")]).drop("pos")


def kept_rows(spark, names):
    return spark.createDataFrame([(n,) for n in names], "feature string")


@register("numeric_features", "SELECT feature, round(sum(value), 2) AS total FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax")) + ") GROUP BY feature")
def numeric_features(spark, sf_dir):
    p = pack(table(spark, sf_dir, "lineitem"))
    return named(p, to_long(p.df, []).groupBy("pos").agg(F.round(F.sum("value"), 2).alias("total")))


@register("invalid_share", f"""{LONG_WIDE} SELECT feature, round(count(*) FILTER (WHERE NOT {VALID}) / count(*), 6)
AS invalid_share FROM long GROUP BY feature""")
def invalid_share(spark, sf_dir):
    p = wide(spark, sf_dir)
    stats = S.invalid_share(to_long(p.df, []))
    return named(p, stats.withColumn("invalid_share", F.round("invalid_share", 6)))


@register("drop_invalid", f"""{LONG_WIDE} SELECT feature FROM long GROUP BY feature
HAVING count(*) FILTER (WHERE NOT {VALID}) / count(*) <= 0.05""")
def drop_invalid(spark, sf_dir):
    return kept_rows(spark, S.drop_invalid(wide(spark, sf_dir)))


@register("clean_rows", f"""{LONG_WIDE}, k AS (SELECT feature FROM long GROUP BY feature
  HAVING count(*) FILTER (WHERE NOT {VALID}) / count(*) <= 0.30),
bad AS (SELECT DISTINCT row_id FROM long SEMI JOIN k USING (feature) WHERE NOT {VALID})
SELECT plate, count(*) AS n, round(sum(f_price), 2) AS total FROM wide ANTI JOIN bad USING (row_id) GROUP BY plate""")
def clean_rows(spark, sf_dir):
    # the row id repeats, so rows sharing an id with a bad row are dropped on both sides
    p = wide(spark, sf_dir)
    clean = S.clean_rows(p)
    good = Profiles(p.df, p.names).keep(clean.names)
    bad = good.df.filter(~F.forall(C.FEATURES, is_valid)).select("Metadata_row").distinct()
    out = unpack(clean).join(bad, "Metadata_row", "left_anti")
    return out.groupBy(F.col(C.PLATE).alias("plate")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("f_price"), 2).alias("total"))


VARIANCE = f"""{LONG_WIDE}, c AS (SELECT feature, value, count(*) AS n FROM long WHERE {VALID} GROUP BY ALL),
top AS (SELECT feature, max(n) AS first_count, CASE WHEN count(*) > 1 THEN
          list_sort(list(n), 'DESC')[2] END AS second_count, count(*) AS n_unique FROM c GROUP BY feature),
tot AS (SELECT feature, count(*) AS n_rows, CASE WHEN bool_or(isinf(value)) THEN NULL ELSE round(
          var_pop(CASE WHEN NOT isnan(value) AND NOT isinf(value) THEN value END), 4) END AS variance
        FROM long GROUP BY feature)"""


@register("variance_statistics", f"""{VARIANCE} SELECT feature, n_rows, n_unique, first_count, second_count, variance
FROM tot JOIN top USING (feature)""")
def variance_statistics(spark, sf_dir):
    p = wide(spark, sf_dir)
    stats = S.variance_statistics(to_long(p.df, []))
    finite = F.when(is_valid("variance"), F.round("variance", 4))
    return named(p, stats.withColumn("variance", finite))


@register("variance_threshold", f"""{VARIANCE} SELECT feature FROM tot JOIN top USING (feature)
WHERE n_unique / n_rows >= 0.0001 AND (second_count IS NULL OR second_count / first_count >= 0.05)""")
def variance_threshold(spark, sf_dir):
    return kept_rows(spark, S.variance_threshold(wide(spark, sf_dir), unique_cut=0.0001))


@register("outlier_scores", f"""{LONG_WIDE}, ok AS (SELECT feature, value FROM long WHERE {VALID}),
endless AS (SELECT DISTINCT feature FROM long WHERE isinf(value)),
s AS (SELECT feature, avg(value) AS m, stddev_pop(value) + 1e-8 AS s, min(value) AS lo, max(value) AS hi FROM ok GROUP BY feature)
SELECT feature, CASE WHEN feature IN (SELECT feature FROM endless) THEN NULL
  ELSE round(greatest(abs((lo - m) / s), abs((hi - m) / s)), 4) END AS max_z FROM s""")
def outlier_scores(spark, sf_dir):
    """All features; one with infinite values has no finite score."""
    p = wide(spark, sf_dir)
    score = F.when(is_valid("max_z"), F.round("max_z", 4)).alias("max_z")
    return named(p, S.extreme_scores(to_long(p.df, [])).select("pos", score))


@register("drop_outliers", f"""{LONG_WIDE}, bad AS (SELECT DISTINCT feature FROM long WHERE isinf(value)),
ok AS (SELECT feature, value FROM long ANTI JOIN bad USING (feature) WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT feature, avg(value) AS m, stddev_pop(value) + 1e-8 AS s, min(value) AS lo, max(value) AS hi FROM ok GROUP BY feature)
SELECT feature FROM s WHERE greatest(abs((lo - m) / s), abs((hi - m) / s)) <= 20""")
def drop_outliers(spark, sf_dir):
    return kept_rows(spark, S.drop_outliers(wide(spark, sf_dir), 20))


def valid_counts(profiles: Profiles):
    stats = to_long(profiles.df, []).groupBy("pos").agg(F.count_if(is_valid("value")).alias("n_valid"))
    return named(profiles, stats)


COUNTS = f"{LONG_WIDE} SELECT feature, count(*) FILTER (WHERE {VALID}) AS n_valid FROM long WHERE {{}} GROUP BY feature"


@register("blocklist", COUNTS.format("feature NOT LIKE '%Location_Center%'"))
def blocklist(spark, sf_dir):
    p = wide(spark, sf_dir)
    return valid_counts(p.keep(S.blocklist(p)))


@register("include_exclude", COUNTS.format("feature LIKE '%f_%' AND feature NOT LIKE '%quant%'"))
def include_exclude(spark, sf_dir):
    p = wide(spark, sf_dir)
    some = p.keep(S.include_parts(p, ["f_"]))
    return valid_counts(some.keep(S.exclude_parts(some, ["quant"])))


# features with NULL, NaN or infinite values have no correlation, as the constant one has none
SOUND = ["f_quantity", "f_price", "f_discount", "f_rare", "f_copy", "Location_Center_X"]


@register("correlation_edges", with_clause(wide=WIDE) + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM wide"
    for i, a in enumerate(SOUND) for b in SOUND[i + 1:]) + ") WHERE abs(r) > 0.02")
def correlation_edges(spark, sf_dir):
    p = wide(spark, sf_dir)
    rows = [(p.names[i], p.names[j], round(r, 4)) for i, j, r in gram_edges(p.df, 0.02) if abs(round(r, 4)) > 0.02]
    return spark.createDataFrame(rows, "a string, b string, r double")


GREEDY = """, r AS (""" + " UNION ALL ".join(
    f"SELECT {COLUMNS.index(a)} AS i, {COLUMNS.index(b)} AS j, corr({a}, {b}) AS r FROM wide"
    for a in SOUND for b in SOUND if a != b) + """), e AS (SELECT i, j FROM r WHERE abs(r) > 0.95),
start AS (SELECT list(i ORDER BY i) AS pool FROM range(""" + str(len(COLUMNS)) + """) AS t(i)),
walk AS (SELECT 0 AS step, pool AS free, CAST([] AS BIGINT[]) AS chosen FROM start UNION ALL
  SELECT step + 1, list_filter(free, lambda x: x <> pick AND NOT list_contains(around, x)), list_append(chosen, pick) FROM (
    SELECT *, (SELECT coalesce(list(e.j), CAST([] AS BIGINT[])) FROM e WHERE e.i = pick) AS around FROM (
      SELECT *, (SELECT arg_min(f.i, (SELECT count(*) FROM e WHERE e.i = f.i AND list_contains(free, e.j)) * 100 + f.i)
                 FROM (SELECT unnest(free) AS i) f) AS pick FROM walk WHERE len(free) > 0)))"""


@register("prune_correlated", with_clause(wide=WIDE).replace("WITH ", "WITH RECURSIVE ", 1) + GREEDY + f""" SELECT feature FROM (
  SELECT unnest({COLUMNS}) AS feature, unnest(range({len(COLUMNS)})) AS i) n, (SELECT chosen FROM walk ORDER BY step DESC LIMIT 1) c
WHERE list_contains(chosen, n.i)""")
def prune_correlated(spark, sf_dir):
    return kept_rows(spark, S.prune_correlated(wide(spark, sf_dir), 0.95))


@register("listed_features", f"""{COUNTS.format("feature NOT IN ('f_nan', 'f_copy') AND feature IN ('f_quantity', 'f_price', 'f_nan', 'f_copy', 'f_inf')")}""")
def listed_features(spark, sf_dir):
    """Features named in one csv file, without those named in another; names the table does not have are passed over."""
    base, p = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}", wide(spark, sf_dir)
    for name, listed in (("in", ["f_quantity", "f_price", "f_nan", "f_copy", "f_inf", "f_unknown"]), ("out", ["f_copy", "f_nan", "other"])):
        spark.createDataFrame([(n, 1) for n in listed], "feature string, rank int").write.option("header", True).csv(f"{base}/{name}")
    some = p.keep(S.include_listed(p, f"{base}/in"))
    return valid_counts(some.keep(S.exclude_listed(some, f"{base}/out")))


@register("filter_chain", f"""{VARIANCE}, bad AS (SELECT DISTINCT feature FROM long WHERE isinf(value)),
ok AS (SELECT feature, value FROM long ANTI JOIN bad USING (feature) WHERE value IS NOT NULL AND NOT isnan(value)),
z AS (SELECT feature, greatest(abs((min(value) - avg(value)) / (stddev_pop(value) + 1e-8)),
                               abs((max(value) - avg(value)) / (stddev_pop(value) + 1e-8))) AS z FROM ok GROUP BY feature)
SELECT feature FROM tot JOIN top USING (feature) JOIN z USING (feature)
WHERE n_unique / n_rows >= 0.0001 AND (second_count IS NULL OR second_count / first_count >= 0.05) AND z <= 500
  AND feature NOT LIKE '%Location_Center%'""")
def filter_chain(spark, sf_dir):
    out, _ = S.filter_features(wide(spark, sf_dir), [
        {"name": "variance_threshold", "unique_cut": 0.0001}, {"name": "drop_outliers", "outlier_cutoff": 500},
        {"name": "blocklist"}])
    return kept_rows(spark, out.names)


@register("typical_sites", """WITH n AS (SELECT l_suppkey AS site, count(*) AS n_cells FROM lineitem GROUP BY 1),
q AS (SELECT quantile_cont(n_cells, 0.1) AS lo, quantile_cont(n_cells, 0.9) AS hi FROM n)
SELECT site, n_cells FROM n, q WHERE n_cells BETWEEN lo AND hi""")
def typical_sites(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(
        F.count(F.lit(1)).alias("n_cells"))
    return S.typical_sites(counts, 10)


@register("well_registry", with_clause(w=WELL) + """ SELECT "Metadata_Source", count(*) AS n FROM w GROUP BY 1""")
def well_registry(spark, sf_dir):
    return derive(spark, sf_dir, WELL).groupBy(C.SOURCE).agg(F.count(F.lit(1)).alias("n"))
