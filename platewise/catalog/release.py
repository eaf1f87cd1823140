"""Release integrity and incremental ingest."""

import os
import uuid

from pyspark.sql import functions as F

from platewise import columns as C
from platewise.catalog.inputs import profiles
from platewise.catalog.registry import derive, register, table, with_clause
from platewise.functions.keys import site_key, with_site_columns
from platewise.operators import validate as V
from platewise.operators.aggregate import plate_manifest
from platewise.session import shared_folder
from platewise.streaming.ingest import ingest_available, site_stream

SITES = """
  SELECT 'source_' || (o_custkey % 5) || '__B' || (o_custkey % 3) || '__P' || (o_custkey % 7) || '__W' || (o_custkey % 96) || '__' || o_orderkey
           AS Metadata_Site_Key, CASE WHEN o_orderkey % 997 = 5 THEN NULL ELSE 'u' || o_orderkey END AS u, o_orderstatus AS status
  FROM {orders}"""


def sites(spark, sf_dir):
    df = with_site_columns(derive(spark, sf_dir, SITES))
    return df.select(C.SITE_KEY, *C.SITE_PARTS, *[F.concat("u", F.lit(c)).alias(f"URL_Orig{c}") for c in V.CHANNELS])


VARIANTS = """SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'hq' ELSE 'mq' END AS variant FROM {orders}
  UNION ALL SELECT c_custkey + 14000, 'hq' FROM {customer}"""


@register("key_sets", with_clause(v=VARIANTS) + """, e AS (SELECT o_orderkey AS key, variant FROM orders, (VALUES ('hq'), ('mq')) AS t(variant)),
d AS (SELECT DISTINCT key, variant FROM v)
SELECT coalesce(e.variant, d.variant) AS variant, coalesce(e.key, d.key) AS key, CASE WHEN d.key IS NULL THEN 'missing' ELSE 'extra' END AS difference
FROM e FULL JOIN d ON e.key = d.key AND e.variant = d.variant WHERE e.key IS NULL OR d.key IS NULL""")
def key_sets(spark, sf_dir):
    canonical = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return V.key_differences(canonical, derive(spark, sf_dir, VARIANTS), ["hq", "mq"])


@register("key_set_counts", with_clause(v=VARIANTS) + """, e AS (SELECT o_orderkey AS key, variant FROM orders, (VALUES ('hq'), ('mq')) AS t(variant)),
d AS (SELECT DISTINCT key, variant FROM v)
SELECT coalesce(e.variant, d.variant) AS variant, CASE WHEN d.key IS NULL THEN 'missing' ELSE 'extra' END AS difference, count(*) AS n
FROM e FULL JOIN d ON e.key = d.key AND e.variant = d.variant WHERE e.key IS NULL OR d.key IS NULL GROUP BY 1, 2""")
def key_set_counts(spark, sf_dir):
    canonical = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return V.difference_counts(V.key_differences(canonical, derive(spark, sf_dir, VARIANTS), ["hq", "mq"]), ["variant"])


HASH = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 15) AS BIGINT)"


@register("key_digest", f"""WITH h AS (SELECT o_orderstatus, {HASH.format('o_custkey')} AS h FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders))
SELECT o_orderstatus, count(*) AS n_keys, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h GROUP BY 1""")
def key_digest(spark, sf_dir):
    return V.key_digest(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus"])


@register("sorted_digest", f"""WITH k AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS k FROM lineitem),
b AS (SELECT {HASH.format('k')} % 64 AS b, sha256(array_to_string(list(k ORDER BY k), chr(10))) AS d FROM k GROUP BY 1)
SELECT sha256(array_to_string(list(d ORDER BY b), chr(10))) AS digest FROM b""")
def sorted_digest(spark, sf_dir):
    return V.sorted_digest(table(spark, sf_dir, "lineitem"), "l_partkey", 64)


@register("image_index", with_clause(s=SITES) + """ SELECT "Metadata_Site_Key", c AS "Metadata_Channel", u || c AS uri
FROM s, (VALUES ('AGP'), ('DNA'), ('ER'), ('Mito'), ('RNA')) AS t(c)""")
def image_index(spark, sf_dir):
    return V.expand_channels(sites(spark, sf_dir)).select(C.SITE_KEY, C.CHANNEL, "uri")


@register("site_parts", with_clause(s=SITES) + """ SELECT "Metadata_Site_Key", split_part("Metadata_Site_Key", '__', 3) AS "Metadata_Plate",
  CAST(split_part("Metadata_Site_Key", '__', 5) AS BIGINT) AS "Metadata_Site" FROM s""")
def site_parts(spark, sf_dir):
    return with_site_columns(derive(spark, sf_dir, SITES)).select(C.SITE_KEY, C.PLATE, C.SITE)


@register("freeze_index", with_clause(s=SITES) + """ SELECT "Metadata_Site_Key", u || 'DNA' AS uri FROM s WHERE status = 'F'""")
def freeze_index(spark, sf_dir):
    keys = with_site_columns(derive(spark, sf_dir, SITES).filter("status = 'F'")).select(C.SITE_KEY, *C.SITE_PARTS)
    out = V.freeze_index(keys, sites(spark, sf_dir).drop(C.SITE_KEY))
    return out.select(C.SITE_KEY, F.col("URL_OrigDNA").alias("uri"))


@register("listed_plates", """SELECT o_orderkey, 'P' || (o_custkey % 40) AS "Metadata_Plate" FROM orders WHERE o_custkey % 40 IN (
  SELECT c_custkey % 40 FROM customer WHERE c_acctbal < -900)""")
def listed_plates(spark, sf_dir):
    plate = lambda c: F.concat(F.lit("P"), F.col(c) % 40)
    plates = table(spark, sf_dir, "customer").filter("c_acctbal < -900").select(F.lit("x").alias("_c0"), plate("c_custkey").alias("_c1"))
    return V.of_listed_plates(table(spark, sf_dir, "orders").select("o_orderkey", plate("o_custkey").alias(C.PLATE)), plates)


@register("exact_join", """SELECT c_custkey, n_orders, round(total, 2) AS total, c_mktsegment FROM customer JOIN (
  SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def exact_join(spark, sf_dir):
    """Customers who have ordered, each with the one row of their orders."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    out = V.exact_join(orders, customers, ["c_custkey"], surplus=True)
    return out.select("c_custkey", "n_orders", F.round("total", 2).alias("total"), "c_mktsegment")


@register("refused_join", """SELECT count(*) > count(DISTINCT o_custkey) AS repeated_key, EXISTS (SELECT 1 FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders)) AS missing_key FROM orders""")
def refused_join(spark, sf_dir):
    """Whole tables whose keys repeat, or are missing on one side, are refused while they are written."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")

    def refused(df):
        try:
            df.write.format("noop").mode("overwrite").save()
        except Exception as error:
            if "rows of key (" not in str(error):
                raise
            return True
        return False

    found = refused(V.exact_join(orders, customers, ["c_custkey"], surplus=True)), refused(
        V.exact_join(orders.select("c_custkey").distinct(), customers, ["c_custkey"]))
    return spark.createDataFrame([found], "repeated_key boolean, missing_key boolean")


@register("surplus_by_source", with_clause(s=SITES) + """ SELECT 'hq' AS variant, split_part("Metadata_Site_Key", '__', 1) AS source, count(*) AS n FROM s WHERE status <> 'F' GROUP BY 2""")
def surplus_by_source(spark, sf_dir):
    df = derive(spark, sf_dir, SITES).withColumnRenamed(C.SITE_KEY, "key").withColumn("variant", F.lit("hq"))
    return V.surplus_by_source(V.key_differences(df.filter("status = 'F'"), df, ["hq"]))


@register("validation_report", with_clause(s=SITES) + """, n AS (SELECT count(*) AS n, count(u) AS m, count(DISTINCT "Metadata_Site_Key") AS d FROM s)
SELECT 'site keys equal canonical keys' AS "check", true AS ok, 0::BIGINT AS observed, 0::BIGINT AS expected FROM n
UNION ALL SELECT 'site keys distinct', d = n, d, n FROM n
UNION ALL SELECT 'urls present', n = m, n - m, 0 FROM n
UNION ALL SELECT 'site key equals its parts', true, 0, 0 FROM n
UNION ALL SELECT 'images per site', true, 5 * n, 5 * n FROM n
UNION ALL SELECT 'channels complete', true, 0, 0 FROM n
UNION ALL SELECT 'image uris present', n = m, 5 * (n - m), 0 FROM n
UNION ALL SELECT 'wells distinct', count(DISTINCT w) = count(*), count(DISTINCT w), count(*) FROM (
  SELECT DISTINCT regexp_replace("Metadata_Site_Key", '__[0-9]+$', '') AS w FROM s)
UNION ALL SELECT 'plate manifest total', true, n, n FROM n
UNION ALL SELECT 'annotations within release', false, (SELECT count(DISTINCT p_partkey) FROM part
  WHERE p_partkey NOT IN (SELECT min(o_custkey) FROM orders GROUP BY o_custkey % 5, o_custkey % 3, o_custkey % 7, o_custkey % 96)), 0""")
def validation_report(spark, sf_dir):
    index = sites(spark, sf_dir)
    well = site_key(*[F.concat(F.lit(name), F.col("o_custkey") % n) for name, n in (
        ("source_", 5), ("B", 3), ("P", 7), ("W", 96))])
    wells = table(spark, sf_dir, "orders").groupBy(well.alias("Metadata_Well_Key")).agg(F.min("o_custkey").alias(C.PERT))
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(C.PERT))
    return V.release_checks(index.select(C.SITE_KEY), index, V.expand_channels(index), plate_manifest(index), wells, notes)


@register("invalid_values", """SELECT CAST(sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
  CAST(sum(CASE WHEN isnan(e) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan, CAST(sum(CASE WHEN isinf(e) THEN 1 ELSE 0 END) AS BIGINT) AS n_inf
FROM (SELECT UNNEST(embedding) AS e FROM embeddings)""")
def invalid_values(spark, sf_dir):
    return V.invalid_values(profiles(spark, sf_dir))


@register("incremental_ingest", """SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_keys FROM events GROUP BY event_type""")
def incremental_ingest(spark, sf_dir):
    """Two runs over the same arrivals: the second adds nothing."""
    folder = f"{shared_folder(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    for run in ("a", "b"):
        stream = site_stream(spark, sf_dir, schema, glob="events.parquet")
        ingest_available(stream, os.path.join(folder, "sink"), os.path.join(folder, f"log_{run}"), ["event_id"], ["event_type"])
    out = spark.read.parquet(os.path.join(folder, "sink"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_keys"))
