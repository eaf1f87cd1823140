"""Metadata curation and the annotation graph."""

from pyspark.sql import functions as F

from platewise import columns as C
from platewise.catalog.inputs import (
    COMPOUND, CRISPR, CURATED, EVIDENCE, GENE_PAIRS, ORF, PAIRS, PERTURBATIONS, PLATE, STRUCTURES, WELL,
)
from platewise.catalog.registry import derive, register, table, with_clause
from platewise.operators import annotations as A
from platewise.operators import metadata as M
from platewise.plans.curation import build_graph, curate

REGISTRY = with_clause(well=WELL, plate=PLATE, compound=COMPOUND, crispr=CRISPR, orf=ORF)
RAW = REGISTRY + """, raw AS (
  SELECT w."Metadata_Source" AS src, p."Metadata_Batch" AS batch, w."Metadata_Plate" AS plate,
         w."Metadata_Well" AS well, w."Metadata_JCP2022" AS pert
  FROM well w JOIN plate p ON w."Metadata_Source" = p."Metadata_Source" AND w."Metadata_Plate" = p."Metadata_Plate")"""
SHORT = {C.SOURCE: "src", C.BATCH: "batch", C.PLATE: "plate", C.WELL: "well", C.PERT: "pert"}


def registry(spark, sf_dir):
    return {n: derive(spark, sf_dir, t) for n, t in (
        ("well", WELL), ("plate", PLATE), ("compound", COMPOUND), ("crispr", CRISPR), ("orf", ORF))}


def raw_wells(spark, sf_dir):
    r = registry(spark, sf_dir)
    return M.wells_with_plates(r["well"], r["plate"]), r


def short(df):
    return df.withColumnsRenamed(SHORT)


@register("wells_with_plates", RAW + " SELECT * FROM raw")
def wells_with_plates(spark, sf_dir):
    return short(raw_wells(spark, sf_dir)[0])


@register("classify", RAW + """ SELECT raw.*, CASE
  WHEN pert IN (SELECT "Metadata_JCP2022" FROM crispr) THEN 'CRISPR'
  WHEN pert IN (SELECT "Metadata_JCP2022" FROM orf) THEN 'ORF'
  WHEN pert IN (SELECT "Metadata_JCP2022" FROM compound) THEN 'COMPOUND' ELSE 'UNKNOWN' END AS kind FROM raw""")
def classify(spark, sf_dir):
    raw, r = raw_wells(spark, sf_dir)
    return short(M.classify(raw, r["crispr"], r["orf"], r["compound"], "kind"))


FILTERED = RAW + """, kept AS (SELECT * FROM raw WHERE src <> 'source_9' AND plate NOT IN (
    SELECT "Metadata_Plate" FROM plate WHERE "Metadata_PlateType" ILIKE '%TARGET2%')),
fill AS (SELECT src, plate, count(DISTINCT well) AS wells_present,
         round(count(DISTINCT well) * 100.0 / 384, 2) AS fill_rate FROM kept GROUP BY src, plate)"""


@register("fill_rate", FILTERED + " SELECT src, plate, wells_present, CAST(fill_rate AS DOUBLE) AS fill_rate FROM fill")
def fill_rate(spark, sf_dir):
    raw, r = raw_wells(spark, sf_dir)
    return short(M.fill_rates(M.filter_plates(raw, r["plate"], min_fill=0.0)))


@register("filter_plates", FILTERED + " SELECT kept.* FROM kept SEMI JOIN (SELECT * FROM fill WHERE fill_rate >= 9) f "
          "ON kept.src = f.src AND kept.plate = f.plate")
def filter_plates(spark, sf_dir):
    raw, r = raw_wells(spark, sf_dir)
    return short(M.filter_plates(raw, r["plate"], min_fill=9.0))


@register("deny_plates", RAW + """ SELECT * FROM raw WHERE plate NOT IN (
  SELECT 'P' || (s_suppkey % 40) FROM supplier WHERE s_acctbal < 0)""")
def deny_plates(spark, sf_dir):
    denied = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(
        F.concat(F.lit("P"), F.col("s_suppkey") % 40).alias(C.PLATE), F.lit("balance").alias("reason"))
    return short(M.deny_plates(raw_wells(spark, sf_dir)[0], denied))


INDEX = """
  SELECT CASE WHEN c_custkey % 3 = 0 THEN 'source_4' WHEN c_custkey % 3 = 1 THEN 'source_3' ELSE 'source_15' END
           AS Metadata_Source,
         CASE WHEN c_nationkey < 5 THEN '2021_Batch12' WHEN c_nationkey < 9 THEN 'CP_34_all_Phenix1'
              WHEN c_nationkey < 12 THEN 'CP59' ELSE 'B' || c_nationkey END AS Metadata_Batch,
         CASE WHEN c_custkey % 20 = 1 THEN 'PEP00004458' WHEN c_custkey % 20 = 2 THEN 'CP-CC9-R3-28'
              ELSE 'P' || c_custkey END AS Metadata_Plate
  FROM {customer}"""


@register("usable_plates", with_clause(p=INDEX) + """ SELECT * FROM p WHERE NOT (
  ("Metadata_Source" = 'source_4' AND suffix("Metadata_Batch", 'Batch12'))
  OR ("Metadata_Source" = 'source_3' AND (regexp_matches("Metadata_Batch", '^CP_3[23456]_all_Phenix1$')
      OR "Metadata_Batch" IN ('CP59', 'CP60')))
  OR ("Metadata_Source" = 'source_15' AND "Metadata_Plate" IN ('PEP00004458', 'PEP00004421'))
  OR regexp_matches("Metadata_Plate", 'CP-CC9-R[123456]-28'))""")
def usable_plates(spark, sf_dir):
    return M.usable_plates(derive(spark, sf_dir, INDEX))


@register("site_sample", """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 4""")
def site_sample(spark, sf_dir):
    return M.site_sample(table(spark, sf_dir, "orders"), 4, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


SEEDED = "CAST('0x' || substr(md5(42 || '|' || {}), 1, 15) AS BIGINT)"


@register("negcon_sample", RAW + """, typed AS (SELECT *, CASE
    WHEN pert IN (SELECT "Metadata_JCP2022" FROM crispr) THEN 'CRISPR'
    WHEN pert IN (SELECT "Metadata_JCP2022" FROM orf) THEN 'ORF'
    WHEN pert IN (SELECT "Metadata_JCP2022" FROM compound) THEN 'COMPOUND' ELSE 'UNKNOWN' END AS kind FROM raw),
modality AS (SELECT * FROM (VALUES ('COMPOUND', 'JCP2022_033924'), ('CRISPR', 'JCP2022_800001')) AS t(kind, pert)),
ctrl AS (SELECT raw.*, m.kind FROM raw JOIN modality m USING (pert)
         SEMI JOIN (SELECT DISTINCT kind, plate FROM typed) t ON t.kind = m.kind AND t.plate = raw.plate),
placed AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY """ + SEEDED.format(
    "src || '|' || plate || '|' || well || '|' || pert") + """) AS place,
  greatest(1, floor(count(*) OVER (PARTITION BY plate) * 0.3)) AS n_keep FROM ctrl)
SELECT src, batch, plate, well, pert, kind FROM placed WHERE place <= n_keep""")
def negcon_sample(spark, sf_dir):
    raw, r = raw_wells(spark, sf_dir)
    typed = M.classify(raw, r["crispr"], r["orf"], r["compound"])
    wells = M.control_wells(typed, raw)
    return short(M.sample_controls(wells, 0.3)).withColumnRenamed("Modality", "kind")


GROUPED = """SELECT 'source_' || (o_custkey % 14) AS src, 'C' || (o_orderkey % 700) AS pert,
  CASE WHEN o_orderkey % 23 = 0 THEN 'negcon' ELSE 'trt' END AS control, o_orderkey AS id FROM {orders}"""


@register("replicate_filter", with_clause(w=GROUPED) + """, g AS (SELECT *, CASE
  WHEN src IN ('source_2', 'source_6', 'source_8') THEN 'group_high' WHEN src = 'source_7' THEN 'group_low'
  WHEN src = 'source_4' THEN 'group_orf' WHEN src = 'source_13' THEN 'group_crispr' ELSE 'group_other' END AS grp FROM w),
n AS (SELECT grp, pert FROM g GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT id, grp FROM g WHERE grp NOT IN ('group_high', 'group_low') OR control = 'negcon'
  OR EXISTS (SELECT 1 FROM n WHERE n.grp = g.grp AND n.pert = g.pert)""")
def replicate_filter(spark, sf_dir):
    df = derive(spark, sf_dir, GROUPED).withColumnsRenamed({"src": C.SOURCE, "pert": C.PERT, "control": C.CONTROL_TYPE})
    return M.replicate_filter(df, 4).select("id", F.col(C.GROUP).alias("grp"))


@register("target_list", """SELECT 'S' || l_suppkey AS id, array_to_string(list_sort(list(DISTINCT 'G' || (l_partkey % 37))), '|')
  AS targets FROM lineitem GROUP BY 1""")
def target_list(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("id"), F.concat(F.lit("G"), F.col("l_partkey") % 37).alias("target"))
    return M.target_lists(edges, "id", "target", "targets")


P_CTE = with_clause(p=PERTURBATIONS, cur=CURATED, st=STRUCTURES, gp=GENE_PAIRS, pr=PAIRS)
GENES = """genes AS (SELECT DISTINCT "Metadata_Symbol" AS target, "Metadata_JCP2022" AS partner_jcp,
  "Metadata_Perturbation_Type" AS target_modality FROM p
  WHERE "Metadata_Perturbation_Type" IN ('orf', 'crispr') AND "Metadata_Symbol" IS NOT NULL)"""


def perturbations(spark, sf_dir):
    return derive(spark, sf_dir, PERTURBATIONS)


@register("target_columns", P_CTE + """, t AS (SELECT "Metadata_JCP2022" AS id, array_to_string(list_sort(list(DISTINCT target)), '|') AS l
  FROM cur JOIN st ON split_part(inchikey, '-', 1) = "InChIKey_Connectivity" GROUP BY 1)
SELECT p."Metadata_JCP2022" AS pert, CASE WHEN hash_ctrl THEN 'unknown'
  WHEN "Metadata_Perturbation_Type" IN ('orf', 'crispr') THEN "Metadata_Symbol" ELSE coalesce(l, 'unknown') END AS target
FROM (SELECT *, "Metadata_JCP2022" LIKE '%7' AS hash_ctrl FROM p) p LEFT JOIN t ON t.id = p."Metadata_JCP2022" """)
def target_columns(spark, sf_dir):
    p = perturbations(spark, sf_dir).withColumn(
        "Metadata_pert_type", F.when(F.col(C.PERT).endswith("7"), "negcon").otherwise("trt"))
    edges = derive(spark, sf_dir, CURATED).withColumn("InChIKey_Connectivity", M.connectivity("inchikey")).join(
        derive(spark, sf_dir, STRUCTURES), "InChIKey_Connectivity")
    return M.target_column(p, M.target_lists(edges), "out").select(F.col(C.PERT).alias("pert"), F.col("out").alias("target"))


@register("structure_match", REGISTRY + """, k AS (SELECT DISTINCT split_part(inchikey, '-', 1) AS block, inchikey FROM ("""
          + CURATED.replace("{lineitem}", "lineitem") + """)), w AS (SELECT block, min(inchikey) AS inchikey FROM k GROUP BY block),
known AS (SELECT DISTINCT split_part("Metadata_InChIKey", '-', 1) AS block, "Metadata_JCP2022" AS pert FROM compound
          WHERE "Metadata_InChIKey" IS NOT NULL)
SELECT w.inchikey, w.block, known.pert FROM w LEFT JOIN known USING (block)""")
def structure_match(spark, sf_dir):
    keys = derive(spark, sf_dir, CURATED).select(F.col("inchikey").alias("Metadata_InChIKey"))
    out = M.match_structures(keys, derive(spark, sf_dir, COMPOUND))
    return out.toDF("inchikey", "block", "pert")


@register("merge_metadata", RAW + """, m AS (SELECT 'P' || (o_custkey % 40) AS plate, 'W' || (o_orderkey % 120) AS well,
    min(o_orderstatus) AS status FROM orders GROUP BY 1, 2)
SELECT raw.plate, raw.well, raw.pert, CASE WHEN status = 'O' THEN 'negcon' ELSE coalesce(nullif(status, 'P'), 'trt') END AS control,
  status = 'O' AS negcon FROM raw JOIN m USING (plate, well)""")
def merge_metadata(spark, sf_dir):
    raw, _ = raw_wells(spark, sf_dir)
    notes = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("P"), F.col("o_custkey") % 40).alias(C.PLATE),
        F.concat(F.lit("W"), F.col("o_orderkey") % 120).alias(C.WELL), F.col("o_orderstatus").alias("Metadata_status"))
    first = M.first_per_key(notes, [C.PLATE, C.WELL], ["Metadata_status"])
    status = F.col("Metadata_status")
    first = first.withColumn(C.CONTROL_TYPE, F.when(status == "O", "negcon").when(status != "P", status))
    out = M.merge_metadata(raw, first, [C.PLATE, C.WELL])
    return out.select(F.col(C.PLATE).alias("plate"), F.col(C.WELL).alias("well"), F.col(C.PERT).alias("pert"),
                      F.col(C.CONTROL_TYPE).alias("control"), F.col(C.NEGCON).alias("negcon"))


@register("merge_tables", """SELECT CAST(c_custkey AS VARCHAR) AS "Metadata_custkey", c_acctbal AS "Metadata_balance",
  o.n AS "Metadata_orders" FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o
  ON o_custkey = c_custkey""")
def merge_tables(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"))
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).alias("orders"))
    return M.merge_tables([left, right])


@register("control_flag", """SELECT o_orderkey AS id, coalesce(nullif(o_orderstatus, 'P') = 'F', false) AS negcon FROM orders""")
def control_flag(spark, sf_dir):
    status = F.col("o_orderstatus")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(
        status == "F", "negcon").when(status != "P", status).alias(C.CONTROL_TYPE))
    return M.control_flag(df).select("id", F.col(C.NEGCON).alias("negcon"))


@register("match_to_profiles", RAW + """, prof AS (SELECT DISTINCT 'source_' || (l_partkey % 10) AS src, 'P' || (l_partkey % 40) AS plate,
    'W' || (l_orderkey % 120) AS well, CASE WHEN l_suppkey % 3 = 0 THEN 'orf' ELSE 'compound' END AS kind
  FROM lineitem)
SELECT raw.src, raw.batch, raw.plate, raw.well, kind FROM (SELECT DISTINCT src, batch, plate, well FROM raw) raw
JOIN prof USING (src, plate, well)""")
def match_to_profiles(spark, sf_dir):
    raw, _ = raw_wells(spark, sf_dir)
    prof = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("source_"), F.col("l_partkey") % 10).alias(C.SOURCE),
        F.concat(F.lit("P"), F.col("l_partkey") % 40).alias(C.PLATE),
        F.concat(F.lit("W"), F.col("l_orderkey") % 120).alias(C.WELL),
        F.when(F.col("l_suppkey") % 3 == 0, "orf").alias(C.PERT_TYPE))
    control = F.coalesce(F.col(C.PERT).startswith("JCP2022_"), F.lit(False))
    out = M.match_to_profiles(raw.filter(~control), raw.filter(control), prof)
    return short(out).withColumnRenamed(C.PERT_TYPE, "kind")


@register("tag_profiles", RAW + """ SELECT src || '__' || batch || '__' || plate || '__' || well AS id, x, 'm' AS model
FROM raw JOIN (SELECT 'P' || (l_suppkey % 40) AS plate, 'W' || (l_orderkey % 120) AS well, sum(l_quantity) AS x
  FROM lineitem GROUP BY 1, 2) USING (plate, well)""")
def tag_profiles(spark, sf_dir):
    raw, _ = raw_wells(spark, sf_dir)
    features = table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("P"), F.col("l_suppkey") % 40).alias(C.PLATE),
        F.concat(F.lit("W"), F.col("l_orderkey") % 120).alias(C.WELL)).agg(F.sum("l_quantity").alias("x"))
    out = M.tag_profiles(features, raw, "m", "d", "none", [C.PLATE, C.WELL])
    return out.select(F.col("Metadata_id").alias("id"), "x", F.col("Metadata_model").alias("model"))


@register("membership_profile", """WITH s AS (
  SELECT DISTINCT o_custkey AS id, 'all' AS step FROM orders UNION
  SELECT DISTINCT o_custkey, 'open' FROM orders WHERE o_orderstatus = 'O' UNION
  SELECT DISTINCT o_custkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT id, array_to_string(list_sort(list(step)), '&') AS combination FROM s GROUP BY id)
SELECT combination, count(*) AS n FROM c GROUP BY combination""")
def membership_profile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    members = M.membership({"all": orders, "open": orders.filter("o_orderstatus = 'O'"),
                            "urgent": orders.filter("o_orderpriority = '1-URGENT'")}, "o_custkey")
    return M.membership_profile(members, "o_custkey")


@register("overlap_report", """WITH d AS (SELECT DISTINCT l_returnflag AS grp, l_partkey AS id FROM lineitem),
r AS (SELECT DISTINCT p_partkey AS id, 'G' || p_size AS target FROM part WHERE p_size < 20)
SELECT grp, count(DISTINCT id) AS n_ids, count(DISTINCT CASE WHEN target IS NOT NULL THEN id END) AS n_in_reference,
  count(DISTINCT target) AS n_targets FROM d LEFT JOIN r USING (id) GROUP BY grp""")
def overlap_report(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_partkey").alias("id"))
    ref = table(spark, sf_dir, "part").filter("p_size < 20").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("G"), "p_size").alias("target"))
    return M.overlap_report(df, ref, "grp", "id")


@register("nested_subsample", """WITH ids AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey % 10 > 0),
s AS (SELECT id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || id), id) AS place
      FROM ids, (VALUES (0), (1)) AS t(seed)),
c AS (SELECT id, seed, n FROM s, (VALUES (20), (50)) AS t(n) WHERE place <= n),
trt AS (SELECT seed, n, l_suppkey % 7 AS plate, l_orderkey FROM lineitem JOIN c ON l_partkey = id WHERE l_suppkey % 10 > 0),
ctl AS (SELECT seed, n, plate, l_orderkey FROM lineitem JOIN (SELECT DISTINCT seed, n, plate FROM trt) p
        ON l_suppkey % 7 = plate WHERE l_suppkey % 10 = 0)
SELECT seed, n, plate, count(*) AS n_rows FROM (SELECT * FROM trt UNION ALL SELECT * FROM ctl) GROUP BY ALL""")
def nested_subsample(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 10 == 0).alias("ctl"), (F.col("l_suppkey") % 7).alias("plate"))
    out = M.nested_subsample(df, [20, 50], [0, 1], "id", "ctl", "plate")
    return out.groupBy("seed", "n", "plate").agg(F.count(F.lit(1)).alias("n_rows"))


@register("registry_union", REGISTRY + """ SELECT "Metadata_JCP2022" AS pert, NULL::VARCHAR AS standard_key, 'compound' AS modality FROM compound
UNION ALL SELECT "Metadata_JCP2022", "Metadata_Symbol", 'crispr' FROM crispr
UNION ALL SELECT "Metadata_JCP2022", "Metadata_Symbol", 'orf' FROM orf""")
def registry_union(spark, sf_dir):
    r = registry(spark, sf_dir)
    return M.registry_union(r["compound"], r["crispr"], r["orf"]).withColumnRenamed(C.PERT, "pert")


@register("sample_keys", """SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)
ORDER BY md5('3|' || o_custkey), o_custkey LIMIT 25""")
def sample_keys(spark, sf_dir):
    return M.sample_keys(table(spark, sf_dir, "orders"), "o_custkey", 25, 3)


@register("rows_of_sites", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem SEMI JOIN (
  SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') o USING (l_orderkey)""")
def rows_of_sites(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.rows_of_sites(table(spark, sf_dir, "lineitem"), done, ["l_orderkey"]).select(
        "l_orderkey", "l_linenumber", "l_quantity")


# ---- annotation graph --------------------------------------------------------------


TIERS = with_clause(e=EVIDENCE, reg="""
  SELECT 'C' || p_partkey AS pert, CASE WHEN p_partkey % 2 = 0 THEN 'orf' ELSE 'crispr' END AS modality,
         'G' || p_partkey AS standard_key FROM {part}""") + """, f AS (
  SELECT * FROM e WHERE target_type = 'gene' AND support > 1),
c AS (SELECT "Metadata_JCP2022", nullif(count(*) FILTER (WHERE support >= 5), 0) AS c5, count(*) AS c1 FROM f GROUP BY 1),
t AS (SELECT target, nullif(count(*) FILTER (WHERE support >= 5), 0) AS t5, count(*) AS t1, count(DISTINCT mode) AS modes FROM f GROUP BY 1),
g AS (SELECT f.*, c5, c1, t5, t1, modes, mode <> 'unspecified' AS stated FROM f JOIN c USING ("Metadata_JCP2022") JOIN t USING (target)),
h AS (SELECT *, CASE WHEN c1 = 1 AND c5 = 1 AND t1 = 1 AND t5 = 1 AND stated THEN 'Tier0'
    WHEN c5 = 1 AND c1 = 1 AND stated THEN 'Tier1' WHEN c5 < 3 AND stated THEN 'Tier2' ELSE 'Tier3' END AS cross_tier,
  coalesce(stated AND modes = 1 AND c5 = 1 AND c1 = 1, false) AS e0, coalesce(stated AND modes = 1 AND c5 = 1, false) AS e1,
  stated AND modes = 1 AS e2, t1 > 1 AS e3 FROM g),
n AS (SELECT *, sum(e0::INT) OVER w AS n0, sum(e1::INT) OVER w AS n1, sum(e2::INT) OVER w AS n2, sum(e3::INT) OVER w AS n3
      FROM h WINDOW w AS (PARTITION BY target)),
tiered AS (SELECT "Metadata_JCP2022" AS pert, target, mode, support, cross_tier, CASE WHEN e0 AND n0 >= 2 THEN 'Tier0'
  WHEN e1 AND n1 >= 2 THEN 'Tier1' WHEN e2 AND n2 >= 2 THEN 'Tier2' WHEN e3 AND n3 >= 2 THEN 'Tier3' ELSE 'Excluded' END AS within_tier
  FROM n)"""


@register("tiers", TIERS + " SELECT * FROM tiered")
def tiers(spark, sf_dir):
    return A.tier_annotate(derive(spark, sf_dir, EVIDENCE)).select(
        F.col(C.PERT).alias("pert"), "target", "mode", "support", F.col("CrossModalityTier").alias("cross_tier"),
        F.col("WithinModalityTier").alias("within_tier"))


@register("match_genes", TIERS + """, genes AS (SELECT pert AS gene, modality, standard_key AS target,
  CASE WHEN modality = 'orf' THEN 'Positive' ELSE 'Negative' END AS direction FROM reg)
SELECT t.pert, t.target, t.mode, t.support, gene, true AS matched FROM tiered t JOIN genes g ON g.target = t.target AND g.direction = t.mode
WHERE t.mode <> 'unspecified'
UNION ALL SELECT t.pert, t.target, t.mode, t.support, gene, false FROM tiered t JOIN genes g ON g.target = t.target WHERE t.mode = 'unspecified'""")
def match_genes(spark, sf_dir):
    tiered = A.tier_annotate(derive(spark, sf_dir, EVIDENCE))
    reg = table(spark, sf_dir, "part").select(
        F.concat(F.lit("C"), "p_partkey").alias(C.PERT),
        F.when(F.col("p_partkey") % 2 == 0, "orf").otherwise("crispr").alias("modality"),
        F.concat(F.lit("G"), "p_partkey").alias("standard_key"))
    return A.match_genes(tiered, reg).select(
        F.col(C.PERT).alias("pert"), "target", "mode", "support", F.col("Metadata_JCP2022_target").alias("gene"),
        F.col("cmpd_pert_dir_matched").alias("matched"))


@register("evidence_overlap", REGISTRY + """, e AS (SELECT DISTINCT 'I' || l_partkey AS "Metadata_InChI", 'G' || l_suppkey AS target FROM lineitem)
SELECT "Metadata_JCP2022" AS pert, target FROM compound JOIN e USING ("Metadata_InChI")""")
def evidence_overlap(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("I"), "l_partkey").alias("InChI_standardized"), F.concat(F.lit("G"), "l_suppkey").alias("target"))
    return A.evidence_overlap(derive(spark, sf_dir, COMPOUND), raw).select(F.col(C.PERT).alias("pert"), "target")


def edge_columns(df):
    return df.select(F.col("Metadata_JCP2022").alias("a"), F.col("partner_jcp").alias("b"), "target",
                     F.col("target_modality").alias("modality"), "source")


CG_FULL = """cg AS (SELECT DISTINCT "Metadata_JCP2022" AS a, UNNEST(string_split("Metadata_graph_target", '|')) AS target FROM p
  WHERE "Metadata_Perturbation_Type" = 'compound' AND "Metadata_graph_target" <> 'unknown')"""


@register("cg_edges", f"""{P_CTE}, {GENES}, {CG_FULL}
SELECT a, partner_jcp AS b, cg.target, target_modality AS modality, 'cg' AS source FROM cg JOIN genes USING (target)""")
def cg_edges(spark, sf_dir):
    return edge_columns(A.cg_edges(perturbations(spark, sf_dir), "Metadata_graph_target"))


STRICT = """st_targets AS (SELECT DISTINCT "Metadata_JCP2022" AS a, target FROM cur
  JOIN st ON split_part(inchikey, '-', 1) = "InChIKey_Connectivity" WHERE rel_type IN ('inhibitor', 'agonist', 'binds', 'enzyme'))"""
ULTRA = """ul_targets AS (SELECT DISTINCT "Metadata_JCP2022" AS a, target, rel_type, CASE rel_type WHEN 'inhibitor' THEN 'inhibitory'
    WHEN 'agonist' THEN 'activating' ELSE 'binding' END AS action FROM cur
  JOIN st ON split_part(inchikey, '-', 1) = "InChIKey_Connectivity" WHERE rel_type IN ('inhibitor', 'agonist', 'binds'))"""


@register("cg_edges_strict", f"""{P_CTE}, {GENES}, {STRICT}
SELECT a, partner_jcp AS b, target, target_modality AS modality, 'cg' AS source FROM st_targets JOIN genes USING (target)""")
def cg_edges_strict(spark, sf_dir):
    targets = A.curated_targets(derive(spark, sf_dir, CURATED), derive(spark, sf_dir, STRUCTURES))
    return edge_columns(A.cg_edges_curated(targets, perturbations(spark, sf_dir)))


@register("cg_edges_ultra", f"""{P_CTE}, {GENES}, {ULTRA}
SELECT a, partner_jcp AS b, target, rel_type, action FROM ul_targets JOIN genes USING (target)""")
def cg_edges_ultra(spark, sf_dir):
    targets = A.curated_targets(derive(spark, sf_dir, CURATED), derive(spark, sf_dir, STRUCTURES), "ultra")
    return A.cg_edges_curated(targets, perturbations(spark, sf_dir)).select(
        F.col("Metadata_JCP2022").alias("a"), F.col("partner_jcp").alias("b"), "target", "rel_type",
        F.col("action_class").alias("action"))


@register("cc_edges", f"""{P_CTE}, k AS (SELECT DISTINCT split_part(inchikey_a, '-', 1) AS ka, split_part(inchikey_b, '-', 1) AS kb FROM pr),
m AS (SELECT x."Metadata_JCP2022" AS a, y."Metadata_JCP2022" AS b FROM k JOIN st x ON x."InChIKey_Connectivity" = ka
      JOIN st y ON y."InChIKey_Connectivity" = kb WHERE x."Metadata_JCP2022" <> y."Metadata_JCP2022")
SELECT a, b FROM m UNION SELECT b, a FROM m""")
def cc_edges(spark, sf_dir):
    return edge_columns(A.cc_edges(derive(spark, sf_dir, PAIRS), derive(spark, sf_dir, STRUCTURES))).select("a", "b")


@register("bridged_edges", f"""{P_CTE}, {STRICT}
SELECT DISTINCT x.a, y.a AS b FROM st_targets x JOIN st_targets y ON x.target = y.target AND x.a <> y.a""")
def bridged_edges(spark, sf_dir):
    targets = A.curated_targets(derive(spark, sf_dir, CURATED), derive(spark, sf_dir, STRUCTURES))
    return edge_columns(A.bridged_edges(targets, block=64)).select("a", "b")


@register("bridged_edges_by_action", f"""{P_CTE}, {ULTRA}
SELECT DISTINCT x.a, y.a AS b FROM ul_targets x JOIN ul_targets y ON x.target = y.target AND x.action = y.action AND x.a <> y.a""")
def bridged_edges_by_action(spark, sf_dir):
    targets = A.curated_targets(derive(spark, sf_dir, CURATED), derive(spark, sf_dir, STRUCTURES), "ultra")
    return edge_columns(A.bridged_edges(targets, ["target", "action_class"])).select("a", "b")


GG = """canon AS (SELECT DISTINCT least(target_a, target_b) AS lo, greatest(target_a, target_b) AS hi FROM gp
  WHERE target_a IS NOT NULL AND target_b IS NOT NULL AND target_a <> target_b {}),
m AS (SELECT x.partner_jcp AS a, y.partner_jcp AS b, x.target_modality AS modality FROM canon JOIN genes x ON x.target = lo
      JOIN genes y ON y.target = hi AND y.target_modality = x.target_modality WHERE x.partner_jcp <> y.partner_jcp)
SELECT a, b, modality FROM m UNION SELECT b, a, modality FROM m"""


@register("gg_edges", f"{P_CTE}, {GENES}, " + GG.format(""))
def gg_edges(spark, sf_dir):
    out = A.gg_edges(derive(spark, sf_dir, GENE_PAIRS), perturbations(spark, sf_dir))
    return edge_columns(out).select("a", "b", "modality")


@register("gg_edges_strict", f"{P_CTE}, {GENES}, " + GG.format("AND rel_type = 'ppi'"))
def gg_edges_strict(spark, sf_dir):
    out = A.gg_edges(derive(spark, sf_dir, GENE_PAIRS), perturbations(spark, sf_dir), A.GG_STRICT)
    return edge_columns(out).select("a", "b", "modality")


PROFILED = """SELECT DISTINCT Metadata_Source AS src, Metadata_Plate AS plate, Metadata_Well AS well, Metadata_JCP2022 AS pert,
    CASE WHEN Metadata_JCP2022 LIKE 'JCP2022%' THEN 'negcon' ELSE 'trt' END AS pert_type,
    CASE WHEN p_partkey % 6 = 1 THEN 'crispr' WHEN p_partkey % 6 = 3 THEN 'orf' ELSE 'compound' END AS kind,
    CASE WHEN p_partkey % 6 IN (1, 3) THEN 'G' || (p_partkey % 90) END AS symbol
  FROM {well} well LEFT JOIN {part} part ON Metadata_JCP2022 = 'C' || p_partkey"""
CURATION = (REGISTRY + ", cc AS (" + PAIRS + "), cg AS (" + CURATED + """),
blocks AS (SELECT split_part(inchikey_a, '-', 1) AS block FROM cc UNION SELECT split_part(inchikey_b, '-', 1) FROM cc
  UNION SELECT split_part(inchikey, '-', 1) FROM cg),
structures AS (SELECT DISTINCT "Metadata_JCP2022" AS pert, split_part("Metadata_InChIKey", '-', 1) AS block FROM compound
  WHERE split_part("Metadata_InChIKey", '-', 1) IN (SELECT block FROM blocks)),
wanted AS (SELECT pert FROM structures UNION SELECT "Metadata_JCP2022" FROM crispr UNION SELECT "Metadata_JCP2022" FROM orf),
every AS (SELECT w."Metadata_Source" AS src, p."Metadata_Batch" AS batch, w."Metadata_Plate" AS plate,
         w."Metadata_Well" AS well, w."Metadata_JCP2022" AS pert
  FROM well w JOIN plate p ON w."Metadata_Source" = p."Metadata_Source" AND w."Metadata_Plate" = p."Metadata_Plate"),
raw AS (SELECT *, CASE WHEN pert IN (SELECT "Metadata_JCP2022" FROM crispr) THEN 'CRISPR'
    WHEN pert IN (SELECT "Metadata_JCP2022" FROM orf) THEN 'ORF' ELSE 'COMPOUND' END AS modality
  FROM every WHERE pert IN (SELECT pert FROM wanted)),
typed AS (SELECT * FROM raw WHERE src <> 'source_9' AND plate NOT IN (
    SELECT "Metadata_Plate" FROM plate WHERE "Metadata_PlateType" ILIKE '%TARGET2%')),
filtered AS (SELECT * FROM typed SEMI JOIN (SELECT src, plate FROM typed GROUP BY ALL
    HAVING round(count(DISTINCT well) * 100.0 / 384, 2) >= 3) f ON f.src = typed.src AND f.plate = typed.plate),
ctrl AS (SELECT every.* FROM every JOIN (VALUES ('COMPOUND', 'JCP2022_033924'), ('CRISPR', 'JCP2022_800001')) AS t(modality, pert)
    USING (pert) SEMI JOIN (SELECT DISTINCT modality, plate FROM filtered) f
    ON f.modality = t.modality AND f.plate = every.plate),
prof AS (""" + PROFILED.format(well="well", part="part") + """),
matched AS (SELECT batch, prof.* FROM (SELECT src, batch, plate, well FROM filtered
    UNION SELECT src, batch, plate, well FROM ctrl) JOIN prof USING (src, plate, well)),
grouped AS (SELECT *, CASE WHEN src IN ('source_2', 'source_6', 'source_8') THEN 'group_high'
    WHEN src = 'source_7' THEN 'group_low' WHEN src = 'source_4' THEN 'group_orf'
    WHEN src = 'source_13' THEN 'group_crispr' ELSE 'group_other' END AS grp FROM matched),
enough AS (SELECT grp, pert FROM grouped GROUP BY ALL HAVING count(*) >= 30),
replicated AS (SELECT * FROM grouped g WHERE grp NOT IN ('group_high', 'group_low') OR pert_type = 'negcon'
    OR EXISTS (SELECT 1 FROM enough e WHERE e.grp = g.grp AND e.pert = g.pert)),
lists AS (SELECT pert, array_to_string(list_sort(list(DISTINCT target)), '|') AS l
  FROM cg JOIN structures ON split_part(inchikey, '-', 1) = block WHERE target IS NOT NULL GROUP BY pert)""").replace(
    "{lineitem}", "lineitem")


def curated(spark, sf_dir):
    profiles = derive(spark, sf_dir, PROFILED.format(well=f"({WELL})", part="{part}")).withColumnsRenamed(
        {"src": C.SOURCE, "plate": C.PLATE, "well": C.WELL, "pert": C.PERT, "pert_type": "Metadata_pert_type",
         "kind": C.PERT_TYPE, "symbol": C.SYMBOL})
    return curate(registry(spark, sf_dir), profiles, derive(spark, sf_dir, PAIRS), derive(spark, sf_dir, CURATED), min_fill=3.0,
                  min_replicates=30)


@register("curated_wells", CURATION + """ SELECT src, batch, plate, well, r.pert, kind, grp, CASE WHEN pert_type = 'negcon' THEN 'unknown'
  WHEN kind IN ('orf', 'crispr') THEN symbol ELSE coalesce(l, 'unknown') END AS target FROM replicated r LEFT JOIN lists ON lists.pert = r.pert""")
def curated_wells(spark, sf_dir):
    out = short(curated(spark, sf_dir)[0])
    return out.select("src", "batch", "plate", "well", "pert", F.col(C.PERT_TYPE).alias("kind"), F.col(C.GROUP).alias("grp"),
                      F.col("Metadata_graph_target").alias("target"))


@register("curation_steps", CURATION + """ SELECT DISTINCT pert, 'structures' AS step FROM structures WHERE pert IS NOT NULL
UNION SELECT pert, 'raw' FROM raw UNION SELECT pert, 'filtered' FROM filtered
UNION SELECT pert, 'matched' FROM matched UNION SELECT pert, 'replicated' FROM replicated""")
def curation_steps(spark, sf_dir):
    return curated(spark, sf_dir)[1].select(F.col(C.PERT).alias("pert"), "step")


@register("graph_edge_counts", f"""{P_CTE}, {GENES}, {STRICT}, cgs AS (
  SELECT 'cg' AS source, target_modality AS modality, count(*) AS n FROM st_targets JOIN genes USING (target) GROUP BY 2),
ccs AS (SELECT 'cc' AS source, NULL::VARCHAR AS modality, count(*) AS n FROM (
  SELECT DISTINCT x.a, y.a AS b FROM st_targets x JOIN st_targets y ON x.target = y.target AND x.a <> y.a)),
ggs AS (SELECT 'gg' AS source, modality, count(*) AS n FROM (WITH {GG.format("AND rel_type = 'ppi'")}) GROUP BY 2)
SELECT * FROM cgs UNION ALL SELECT * FROM ccs UNION ALL SELECT * FROM ggs""")
def graph_edge_counts(spark, sf_dir):
    graph = build_graph(
        perturbations(spark, sf_dir), derive(spark, sf_dir, CURATED), derive(spark, sf_dir, PAIRS),
        derive(spark, sf_dir, GENE_PAIRS), derive(spark, sf_dir, STRUCTURES), "strict")
    return graph.groupBy("source", F.col("target_modality").alias("modality")).agg(F.count(F.lit(1)).alias("n"))


SPLIT = """SELECT 'K' || l_suppkey || '-S' AS "InChIKey", CASE WHEN l_suppkey % 2 = 0 THEN 'train' ELSE 'test' END AS split
  FROM lineitem"""


@register("build_splits", f"""{P_CTE}, s AS ({SPLIT})
SELECT DISTINCT "Metadata_JCP2022" AS pert, split FROM s JOIN st ON split_part("InChIKey", '-', 1) = "InChIKey_Connectivity" """)
def build_splits(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("K"), F.col("l_suppkey"), F.lit("-S")).alias("InChIKey"),
        F.when(F.col("l_suppkey") % 2 == 0, "train").otherwise("test").alias("split"))
    return A.build_splits(raw, derive(spark, sf_dir, STRUCTURES), "InChIKey", "split").toDF("pert", "split")


@register("split_restrict", """WITH s AS (SELECT 'C' || doc_id AS pert, CASE WHEN quality = 1 THEN 'test' ELSE 'train' END AS split FROM labels),
""" + P_CTE.removeprefix("WITH ") + """ SELECT p."Metadata_JCP2022" AS pert, "Metadata_Perturbation_Type" AS kind FROM p
WHERE "Metadata_Perturbation_Type" <> 'compound' OR "Metadata_JCP2022" IN (SELECT pert FROM s WHERE split = 'test')""")
def split_restrict(spark, sf_dir):
    splits = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("C"), "doc_id").alias(C.PERT), F.when(F.col("quality") == 1, "test").otherwise("train").alias("split"))
    return A.restrict_to_split(perturbations(spark, sf_dir), splits, "test").select(
        F.col(C.PERT).alias("pert"), F.col(C.PERT_TYPE).alias("kind"))


@register("attach_target_list", f"""{P_CTE}, {GENES}, {CG_FULL}, t AS (
  SELECT a, array_to_string(list_sort(list(DISTINCT target)), '|') AS targets FROM cg SEMI JOIN genes USING (target) GROUP BY a)
SELECT "Metadata_JCP2022" AS pert, targets FROM p LEFT JOIN t ON a = "Metadata_JCP2022" """)
def attach_target_list(spark, sf_dir):
    p = perturbations(spark, sf_dir)
    return A.attach_target_list(p, A.cg_edges(p, "Metadata_graph_target")).select(
        F.col(C.PERT).alias("pert"), F.col(C.TARGET_LIST).alias("targets"))
