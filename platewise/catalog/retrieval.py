"""Retrieval metrics over the embeddings: consistency, batch effects, recall."""

from pyspark.sql import functions as F

from platewise import columns as C
from platewise.catalog.inputs import PROFILES, STANDARD, normalized_sql, precision_sql, profiles
from platewise.catalog.registry import derive, register, table, with_clause
from platewise.operators import retrieval as R
from platewise.operators.similarity import PairRule, top_k
from platewise.plans.evaluation import evaluate
from platewise.session import cut_lineage

# Eight wells per perturbation over four groups; two targets each, some unknown.
KINDS = """
  SELECT vec_id AS row_id, 'C' || CAST(floor(vec_id / 8) AS BIGINT) AS pert, 'plate' || (vec_id % 5) AS plate,
         CASE WHEN vec_id % 4 = 0 THEN 'group_high' WHEN vec_id % 4 = 1 THEN 'group_low'
              WHEN vec_id % 4 = 2 THEN 'group_orf' ELSE 'group_crispr' END AS grp,
         CASE WHEN floor(vec_id / 8) % 9 = 0 THEN 'unknown'
              ELSE 'T' || CAST(floor(vec_id / 8) % 7 AS BIGINT) || '|U' || CAST(floor(vec_id / 8) % 5 AS BIGINT) END AS targets,
         'T' || CAST(floor(vec_id / 8) % 7 AS BIGINT) AS symbol, floor(vec_id / 8) % 10 = 3 AS negcon, label, embedding
  FROM {embeddings}"""

CONSENSUS = with_clause(kinds=KINDS) + """, cells AS (
  SELECT pert, grp, targets, symbol, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS value
  FROM kinds, UNNEST(range(len(embedding))) AS t(i) WHERE NOT negcon
), med AS (SELECT pert, grp, targets, symbol, pos, median(value) AS v FROM cells GROUP BY ALL),
packed AS (SELECT pert, grp, targets, symbol, list(v ORDER BY pos) AS f FROM med GROUP BY ALL),
cons AS (SELECT pert, grp, symbol, pert || '|' || grp AS id, string_split(targets, '|') AS targets,
  list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS u FROM packed)"""


def kinds(spark, sf_dir):
    df = derive(spark, sf_dir, KINDS)
    return df.select(
        F.col("row_id").alias(C.ROW_ID), F.col("pert").alias(C.PERT), F.col("plate").alias(C.PLATE),
        F.col("grp").alias(C.GROUP), F.col("targets").alias(C.TARGET_LIST), F.col("symbol").alias(C.SYMBOL),
        F.col("negcon").alias(C.NEGCON), F.col("embedding").cast("array<double>").alias(C.FEATURES))


@register("cosine_topk", f"""WITH {PROFILES}, unit AS (
  SELECT row_id, list_transform(features, lambda x: x / sqrt(list_dot_product(features, features))) AS u FROM profiles),
s AS (SELECT q.row_id AS q, r.row_id AS r, round(list_dot_product(q.u, r.u), 10) AS sim FROM unit q JOIN unit r ON q.row_id <> r.row_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, CAST(r AS VARCHAR)) AS rank FROM s)
SELECT CAST(q AS VARCHAR) AS query_id, CAST(r AS VARCHAR) AS ref_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank
FROM k WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    out = top_k(profiles(spark, sf_dir), C.ROW_ID, PairRule(), 5, cell_rows=200)
    return out.select("query_id", "ref_id", F.round("sim", 6).alias("sim"), "rank")


VALID = """, known AS (SELECT *, list_filter(targets, lambda t: t <> 'unknown') AS kt FROM cons WHERE {where}),
pairs_t AS (SELECT id, pert, {scope} UNNEST(kt) AS t FROM known),
ok_t AS (SELECT {scope} t FROM pairs_t GROUP BY {scope} t HAVING count(DISTINCT pert) >= 3),
rows_t AS (SELECT p.id, list(DISTINCT p.t) AS ts FROM pairs_t p JOIN ok_t USING ({scope} t) GROUP BY p.id),
base AS (SELECT k.id, k.pert, k.grp, k.u, r.ts FROM known k JOIN rows_t r USING (id))"""

PC_PAIRS = """
  SELECT q.id, q.grp, x.t AS target, 1 AS is_pos, round(list_dot_product(q.u, r.u), 10) AS sim
  FROM base q, UNNEST(q.ts) AS x(t), base r WHERE q.grp = r.grp AND q.id <> r.id AND list_contains(r.ts, x.t)
  UNION ALL
  SELECT q.id, q.grp, x.t, 0, round(list_dot_product(q.u, r.u), 10)
  FROM base q, UNNEST(q.ts) AS x(t), base r WHERE q.grp = r.grp AND NOT list_has_any(q.ts, r.ts)"""

PC = CONSENSUS + VALID.format(where="true", scope="grp,") + ", " + precision_sql(PC_PAIRS, "id, grp, target")
NAP = normalized_sql("ap", "n_pos", "(n_pos + n_neg)")


def target_profiles(spark, sf_dir):
    return cut_lineage(R.target_profiles(kinds(spark, sf_dir)))


@register("consistency_ap", f"""{PC} SELECT id, grp, target, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
  round(ap, 6) AS ap FROM ap""")
def consistency_ap(spark, sf_dir):
    ap = R.phenotypic_consistency(target_profiles(spark, sf_dir), [C.GROUP])
    return ap.select(F.concat_ws("|", C.PERT, C.GROUP).alias("id"), F.col(C.GROUP).alias("grp"), "target", "n_pos",
                     "n_neg", F.round("average_precision", 6).alias("ap"))


@register("consistency_map", f"""{PC} SELECT grp, target, round(avg(ap), 6) AS map, round(avg({NAP}), 6) AS nap, count(*) AS n
FROM ap WHERE ap IS NOT NULL GROUP BY grp, target""")
def consistency_map(spark, sf_dir):
    maps = R.mean_average_precision(R.phenotypic_consistency(target_profiles(spark, sf_dir), [C.GROUP]), ["target", C.GROUP])
    return maps.select(
        F.col(C.GROUP).alias("grp"), "target", F.round("mean_average_precision", 6).alias("map"),
        F.round("mean_normalized_average_precision", 6).alias("nap"), F.col("n_replicates").alias("n"))


@register("consistency_background", CONSENSUS + VALID.format(where="true", scope="grp,") + """, base2 AS (
  SELECT id, grp, u, ts FROM base UNION ALL SELECT id, grp, u, ['unknown'] FROM cons WHERE list_contains(targets, 'unknown')), """
          + precision_sql(PC_PAIRS.replace("base r", "base2 r"), "id, grp, target") + """
SELECT id, grp, target, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(ap, 6) AS ap FROM ap""")
def consistency_background(spark, sf_dir):
    ap = R.phenotypic_consistency(target_profiles(spark, sf_dir), [C.GROUP], keep_unknown=True)
    return ap.select(F.concat_ws("|", C.PERT, C.GROUP).alias("id"), F.col(C.GROUP).alias("grp"), "target", "n_pos",
                     "n_neg", F.round("average_precision", 6).alias("ap"))


@register("target_filter", CONSENSUS + VALID.format(where="true", scope="grp,") + """
SELECT id, array_to_string(list_sort(ts), '|') AS targets FROM base""")
def target_filter(spark, sf_dir):
    out = R.filter_targets(target_profiles(spark, sf_dir), C.ROW_ID, "targets", scope=[C.GROUP])
    return out.select(F.concat_ws("|", C.PERT, C.GROUP).alias("id"), F.array_join("targets", "|").alias("targets"))


# ---- consistency by subset -----------------------------------------------------------


TAGS = """
  SELECT DISTINCT 'C' || CAST(floor(vec_id / 8) AS BIGINT) AS "Metadata_JCP2022", 'T' || label AS target,
         CASE WHEN floor(vec_id / 8) % 4 = 0 THEN 'Tier1' WHEN floor(vec_id / 8) % 4 = 1 THEN 'Tier2'
              WHEN floor(vec_id / 8) % 4 = 2 THEN 'Tier3' ELSE 'Excluded' END AS tier,
         CASE WHEN label % 2 = 0 THEN 'Positive' ELSE 'Negative' END AS modality_clean
  FROM {embeddings}"""
SUBSETS = [
    {"subset": "t1", "tiers": ["Tier1"]}, {"subset": "t12", "tiers": ["Tier1", "Tier2"]},
    {"subset": "t123p", "tiers": ["Tier1", "Tier2", "Tier3"], "modality": "Positive"},
]


@register("consistency_subsets", with_clause(kinds=KINDS, tags=TAGS.replace('"Metadata_JCP2022"', "pert")) + """,
opts AS (SELECT * FROM (VALUES ('t1', ['Tier1'], 'all'), ('t12', ['Tier1', 'Tier2'], 'all'),
  ('t123p', ['Tier1', 'Tier2', 'Tier3'], 'Positive')) AS t(subset, tiers, modality)),
lists AS (SELECT subset, pert, list(DISTINCT target) AS kt FROM tags JOIN opts ON list_contains(tiers, tier)
  AND (modality = 'all' OR modality = modality_clean) GROUP BY 1, 2),
cells AS (SELECT subset, k.pert, grp, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS value, kt
  FROM kinds k JOIN lists USING (pert), UNNEST(range(len(embedding))) AS t(i) WHERE NOT negcon),
med AS (SELECT subset, pert, grp, kt, pos, median(value) AS v FROM cells GROUP BY ALL),
pk AS (SELECT subset, pert, grp, kt, list(v ORDER BY pos) AS f FROM med GROUP BY ALL),
known AS (SELECT subset, pert, subset || '|' || grp AS grp, subset || '|' || pert || '|' || grp AS id, kt,
  list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS u FROM pk),
pairs_t AS (SELECT id, pert, grp, UNNEST(kt) AS t FROM known),
ok_t AS (SELECT grp, t FROM pairs_t GROUP BY ALL HAVING count(DISTINCT pert) >= 3),
rows_t AS (SELECT p.id, list(DISTINCT p.t) AS ts FROM pairs_t p JOIN ok_t USING (grp, t) GROUP BY p.id),
base AS (SELECT k.id, k.pert, k.grp, k.u, r.ts FROM known k JOIN rows_t r USING (id)), """
          + precision_sql(PC_PAIRS, "id, grp, target") + """
SELECT grp, target, round(avg(ap), 6) AS map, count(*) AS n FROM ap WHERE ap IS NOT NULL GROUP BY grp, target""")
def consistency_subsets(spark, sf_dir):
    tags = derive(spark, sf_dir, TAGS.replace('"Metadata_JCP2022"', "Metadata_JCP2022"))
    tagged = R.subset_profiles(kinds(spark, sf_dir), tags, SUBSETS, tier="tier")
    rows = cut_lineage(R.target_profiles(tagged, scope=["subset"]))
    ap = R.phenotypic_consistency(rows, ["subset", C.GROUP])
    maps = R.mean_average_precision(ap, ["subset", C.GROUP, "target"])
    return maps.select(F.concat_ws("|", "subset", C.GROUP).alias("grp"), "target",
                       F.round("mean_average_precision", 6).alias("map"), F.col("n_replicates").alias("n"))


# ---- batch effects -------------------------------------------------------------------


def effect_sql(base: str, pos: str, neg: str, keys: str) -> str:
    pairs = f"""
  SELECT q.row_id, {keys}, 1 AS is_pos, round(list_dot_product(q.u, r.u), 10) AS sim FROM base q JOIN base r
    ON q.row_id <> r.row_id AND {pos}
  UNION ALL
  SELECT q.row_id, {keys}, 0, round(list_dot_product(q.u, r.u), 10) FROM base q JOIN base r ON q.row_id <> r.row_id AND {neg}"""
    names = ", ".join(k.split(".")[1] for k in keys.split(", "))
    return f"WITH {STANDARD}, {base}, {precision_sql(pairs, 'row_id, ' + names)}" + f"""
SELECT {names}, round(avg(ap), 6) AS map, count(*) AS n FROM ap WHERE ap IS NOT NULL GROUP BY {names}"""


def effect(ap, by, names):
    maps = R.mean_average_precision(ap, by)
    return maps.select(*[F.col(b).alias(n) for b, n in zip(by, names)],
                       F.round("mean_average_precision", 6).alias("map"), F.col("n_replicates").alias("n"))


def bucket_sql(seed: int, n: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || row_id), 1, 8) AS BIGINT) % {n} + 1)"


@register("well_effect_full", effect_sql(
    """ok AS (SELECT grp, well FROM unit WHERE NOT negcon GROUP BY 1, 2 HAVING count(DISTINCT pert) >= 2),
    base AS (SELECT unit.* FROM unit SEMI JOIN ok ON unit.grp = ok.grp AND unit.well = ok.well WHERE NOT negcon)""",
    "q.grp = r.grp AND q.well = r.well AND q.pert <> r.pert",
    "q.grp = r.grp AND q.plate = r.plate AND q.well <> r.well AND q.pert <> r.pert", "q.grp, q.well"))
def well_effect_full(spark, sf_dir):
    df = cut_lineage(standardized(spark, sf_dir))
    return effect(R.well_position_effect(df, mode="full"), [C.GROUP, C.WELL], ["grp", "well"])


def standardized(spark, sf_dir):
    from platewise.operators.normalize import standardize

    return standardize(profiles(spark, sf_dir))


@register("well_effect_sampled", effect_sql(
    f"""ok AS (SELECT grp, well FROM unit WHERE NOT negcon GROUP BY 1, 2 HAVING count(DISTINCT plate) >= 2),
    b0 AS (SELECT unit.* FROM unit SEMI JOIN ok ON unit.grp = ok.grp AND unit.well = ok.well WHERE NOT negcon),
    sz AS (SELECT grp, CAST(greatest(2, floor(count(*) / count(DISTINCT plate) / 15)) AS BIGINT) AS k FROM b0 GROUP BY grp),
    base AS (SELECT b0.*, {bucket_sql(0, 'k')} AS ri FROM b0 JOIN sz USING (grp))""",
    "q.grp = r.grp AND q.well = r.well AND q.plate <> r.plate AND q.pert <> r.pert",
    "q.grp = r.grp AND q.plate = r.plate AND q.ri = r.ri AND q.well <> r.well AND q.pert <> r.pert", "q.grp, q.well"))
def well_effect_sampled(spark, sf_dir):
    df = cut_lineage(standardized(spark, sf_dir))
    return effect(R.well_position_effect(df), [C.GROUP, C.WELL], ["grp", "well"])


@register("plate_effect_sampled", effect_sql(
    f"""b0 AS (SELECT * FROM unit WHERE NOT negcon),
    sz AS (SELECT grp, CAST(greatest(2, floor(count(*) / count(DISTINCT plate) / 15)) AS BIGINT) AS kp,
                  CAST(greatest(2, floor(count(*) / 25)) AS BIGINT) AS kn FROM b0 GROUP BY grp),
    base AS (SELECT b0.*, {bucket_sql(0, 'kp')} AS rp, {bucket_sql(1, 'kn')} AS rn FROM b0 JOIN sz USING (grp))""",
    "q.grp = r.grp AND q.plate = r.plate AND q.rp = r.rp AND q.pert <> r.pert",
    "q.grp = r.grp AND q.rn = r.rn AND q.plate <> r.plate AND q.well <> r.well AND q.pert <> r.pert", "q.grp, q.plate"))
def plate_effect_sampled(spark, sf_dir):
    df = cut_lineage(standardized(spark, sf_dir))
    return effect(R.plate_effect(df), [C.GROUP, C.PLATE], ["grp", "plate"])


@register("plate_effect_controls", effect_sql(
    "base AS (SELECT * FROM unit WHERE negcon)", "q.plate = r.plate", "q.well = r.well AND q.plate <> r.plate",
    "q.grp, q.plate"))
def plate_effect_controls(spark, sf_dir):
    df = cut_lineage(standardized(spark, sf_dir))
    return effect(R.plate_effect(df, mode="controls"), [C.GROUP, C.PLATE], ["grp", "plate"])


# ---- recall --------------------------------------------------------------------------


EDGES = """
  SELECT DISTINCT 'C' || l_partkey AS Metadata_JCP2022, 'C' || l_suppkey AS partner_jcp,
         CASE WHEN l_linenumber % 3 = 0 THEN 'cc' WHEN l_linenumber % 3 = 1 THEN 'cg' ELSE 'gg' END AS source,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'orf' ELSE 'crispr' END AS target_modality
  FROM {lineitem}"""


def recall_sql(base: str, positive: str, query: str, ref: str, by: str, pool: str = "true") -> str:
    """Recall by brute force: rank every pool member, same ids last."""
    hits = ", ".join(
        f"avg(hit_{k}) AS recall_{k}" for k in (1, 5, 10))
    inner = ", ".join(
        f"sum(CASE WHEN is_pos AND place <= greatest(1, floor(n_refs * {k} / 100)) THEN 1.0 ELSE 0 END) / sum(is_pos::INT) AS hit_{k}"
        for k in (1, 5, 10))
    rounded = ", ".join(f"round(recall_{k}, 6) AS recall_{k}" for k in (1, 5, 10))
    return f"""{base}, q AS (SELECT * FROM cons WHERE {query}), r AS (SELECT * FROM cons WHERE {ref}),
s AS (SELECT q.id AS qid, r.id AS rid, q.grp AS grp, q.id <> r.id AND ({positive}) AS is_pos,
        CASE WHEN q.id = r.id THEN -9 ELSE round(list_dot_product(q.u, r.u), 10) END AS sim FROM q JOIN r ON {pool}),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rid) AS place, count(*) OVER (PARTITION BY qid) AS n_refs FROM s),
g AS (SELECT qid, grp, sum(is_pos::INT) AS n_pos, max(n_refs) AS n_refs, {inner} FROM k GROUP BY qid, grp HAVING sum(is_pos::INT) > 0),
f AS (SELECT {by}, count(*) AS n_queries_with_positives, CAST(sum(n_pos) AS BIGINT) AS n_positive_pairs,
        max(n_refs) AS n_references, {hits} FROM g GROUP BY {by})
SELECT {by}, n_queries_with_positives, n_positive_pairs, n_references, {rounded} FROM f"""


def summary(tab, by=(C.GROUP,), names=("grp",)):
    out = R.recall_summary(tab, list(by))
    return out.select(*[F.col(b).alias(n) for b, n in zip(by, names)], "n_queries_with_positives", "n_positive_pairs",
                      "n_references", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 5, 10)])


def consensus(spark, sf_dir):
    return cut_lineage(R.consensus_rows(kinds(spark, sf_dir), symbol=C.SYMBOL))


BASE = CONSENSUS + ", " + with_clause(e=EDGES).removeprefix("WITH ")
EDGE = """EXISTS (SELECT 1 FROM e WHERE e.source = '{}' AND e."Metadata_JCP2022" = q.pert AND e.partner_jcp = r.pert{})"""


@register("recall_compounds", recall_sql(
    BASE, EDGE.format("cc", ""), "grp IN ('group_high', 'group_low')", "grp IN ('group_high', 'group_low')", "grp",
    "q.grp = r.grp"))
def recall_compounds(spark, sf_dir):
    rows = consensus(spark, sf_dir)
    return summary(R.compound_recall(rows, derive(spark, sf_dir, EDGES), ["group_high", "group_low"]))


GENE = "grp IN ('group_orf', 'group_crispr')"
MODALITY = " AND 'group_' || e.target_modality = q.grp"


@register("recall_genes", recall_sql(BASE, EDGE.format("gg", MODALITY), GENE, GENE, "grp", "q.grp = r.grp"))
def recall_genes(spark, sf_dir):
    return summary(R.gene_recall(consensus(spark, sf_dir), derive(spark, sf_dir, EDGES)))


POOLED = """, ends AS (SELECT "Metadata_JCP2022" AS pert, 'group_' || target_modality AS grp FROM e WHERE source = 'gg'
  UNION SELECT partner_jcp, 'group_' || target_modality FROM e WHERE source = 'gg'),
gene_pool AS (SELECT DISTINCT partner_jcp AS pert, 'group_' || target_modality AS grp FROM e WHERE source = 'cg')"""


@register("recall_genes_filtered", recall_sql(
    BASE + POOLED, EDGE.format("gg", MODALITY), f"{GENE} AND (pert, grp) IN (SELECT (pert, grp) FROM ends)",
    f"{GENE} AND (pert, grp) IN (SELECT (pert, grp) FROM ends)", "grp", "q.grp = r.grp"))
def recall_genes_filtered(spark, sf_dir):
    return summary(R.gene_recall(consensus(spark, sf_dir), derive(spark, sf_dir, EDGES), "filtered"))


CG = EDGE.format("cg", " AND 'group_' || e.target_modality = r.grp")


@register("recall_compound_gene", recall_sql(
    BASE, CG, "grp IN ('group_high', 'group_low')", "grp = 'group_crispr'", "grp"))
def recall_compound_gene(spark, sf_dir):
    return summary(R.compound_gene_recall(
        consensus(spark, sf_dir), derive(spark, sf_dir, EDGES), "crispr", ["group_high", "group_low"]))


@register("recall_compound_gene_filtered", recall_sql(
    BASE + POOLED, CG, "grp IN ('group_high', 'group_low')",
    "grp = 'group_orf' AND (pert, grp) IN (SELECT (pert, grp) FROM gene_pool)", "grp"))
def recall_compound_gene_filtered(spark, sf_dir):
    return summary(R.compound_gene_recall(
        consensus(spark, sf_dir), derive(spark, sf_dir, EDGES), "orf", ["group_high", "group_low"], "filtered"))


@register("recall_shared_target", recall_sql(
    CONSENSUS, "list_has_any(q.targets, r.targets)", "NOT list_contains(targets, 'unknown')",
    "NOT list_contains(targets, 'unknown')", "grp", "q.grp = r.grp"))
def recall_shared_target(spark, sf_dir):
    rows = target_profiles(spark, sf_dir).filter(~F.array_contains("targets", C.UNKNOWN)).withColumn(
        C.ROW_ID, F.concat_ws("|", C.PERT, C.GROUP))
    return summary(R.shared_target_recall(rows, "targets", [C.GROUP], cell_rows=20))


@register("recall_genetic_pairs", recall_sql(
    CONSENSUS, "q.symbol = r.symbol", "grp = 'group_orf'", "grp = 'group_crispr'", "grp"))
def recall_genetic_pairs(spark, sf_dir):
    return summary(R.symbol_recall(consensus(spark, sf_dir), "group_orf", "group_crispr"))


def subset_recall_sql(sign: str) -> str:
    return CONSENSUS + ", " + with_clause(tags=TAGS.replace('"Metadata_JCP2022"', "pert")).removeprefix("WITH ") + f""",
an AS (SELECT 't1' AS subset, pert, target FROM tags WHERE tier = 'Tier1' UNION
       SELECT 't12', pert, target FROM tags WHERE tier IN ('Tier1', 'Tier2')),
s AS (SELECT q.pert, q.id AS qid, q.grp AS query_group, r.id AS rid, r.grp AS ref_group, r.symbol,
        {sign} round(list_dot_product(q.u, r.u), 10) AS sim FROM cons q JOIN cons r ON r.grp IN ('group_orf', 'group_crispr')
      WHERE q.grp IN ('group_high', 'group_low')),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, ref_group ORDER BY sim DESC, rid) AS place,
        count(*) OVER (PARTITION BY qid, ref_group) AS n_refs FROM s),
h AS (SELECT subset, k.* FROM k JOIN an ON an.pert = k.pert AND an.target = k.symbol),
g AS (SELECT subset, query_group, ref_group, qid, count(*) AS n_pos, max(n_refs) AS n_refs,
        avg(CASE WHEN place <= greatest(1, floor(n_refs * 10 / 100)) THEN 1.0 ELSE 0 END) AS r10 FROM h GROUP BY 1, 2, 3, 4)
SELECT subset, query_group, ref_group, count(*) AS n_queries_with_positives, CAST(sum(n_pos) AS BIGINT) AS n_positive_pairs,
       max(n_refs) AS n_references, round(avg(r10), 6) AS recall_10 FROM g GROUP BY 1, 2, 3"""


def subset_targets(spark, sf_dir):
    tags = derive(spark, sf_dir, TAGS.replace('"Metadata_JCP2022"', "Metadata_JCP2022"))
    names = F.array(F.when(F.col("tier") == "Tier1", "t1"), F.when(F.col("tier").isin("Tier1", "Tier2"), "t12"))
    return tags.withColumn("subset", F.explode(names)).filter("subset is not null").select("subset", C.PERT, "target")


def subset_result(spark, sf_dir, direction):
    out = R.subset_recall(consensus(spark, sf_dir), subset_targets(spark, sf_dir), ["group_high", "group_low"],
                          ["group_orf", "group_crispr"], direction=direction, k_percent=(10.0,))
    return out.select("subset", "query_group", "ref_group", "n_queries_with_positives", "n_positive_pairs",
                      "n_references", F.round("recall_10", 6).alias("recall_10"))


@register("recall_subsets", subset_recall_sql(""))
def recall_subsets(spark, sf_dir):
    return subset_result(spark, sf_dir, "top")


@register("recall_subsets_bottom", subset_recall_sql("-"))
def recall_subsets_bottom(spark, sf_dir):
    return subset_result(spark, sf_dir, "bottom")


@register("edge_coverage", BASE + """, ends AS (SELECT DISTINCT target_modality AS m, partner_jcp AS g FROM e WHERE source = 'gg'
  UNION SELECT target_modality, "Metadata_JCP2022" FROM e WHERE source = 'gg'),
prof AS (SELECT DISTINCT regexp_replace(grp, '^group_', '') AS m, pert AS g FROM cons)
SELECT m AS target_modality, (SELECT count(*) FROM e WHERE source = 'gg' AND e.target_modality = m) AS n_edges,
  count(*) AS genes_in_graph, (SELECT count(*) FROM prof p WHERE p.m = ends.m) AS genes_in_profiles,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM prof p WHERE p.m = ends.m AND p.g = ends.g)) AS genes_in_both
FROM ends GROUP BY m""")
def edge_coverage(spark, sf_dir):
    return R.edge_coverage(consensus(spark, sf_dir), derive(spark, sf_dir, EDGES), "gg")


@register("metric_bundle")
def metric_bundle(spark, sf_dir):
    """Everything of one profile table; significance draws make it unsuited to SQL."""
    df = kinds(spark, sf_dir)
    wells = df.withColumn(C.WELL, F.concat(F.lit("W"), F.col(C.ROW_ID) % 24))
    return evaluate(wells, null_size=1000, batch_effects=True)
