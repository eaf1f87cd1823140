"""Agreement of features, masks and images between variants."""

from pyspark.sql import functions as F

from platewise.catalog.inputs import LONG, PAIRED, PIXELS, PROFILES, profiles
from platewise.catalog.registry import derive, register, table, with_clause
from platewise.functions import naming as N
from platewise.operators import agreement as A
from platewise.operators import images as I
from platewise.operators import masks as M
from platewise.operators.packed import Profiles
from platewise.session import cut_lineage

PR = with_clause(pairs=PAIRED) + """, ok AS (SELECT *, value_ref IS NOT NULL AND value_codec IS NOT NULL AND NOT isnan(value_ref) AND NOT isnan(value_codec) AS ok FROM pairs),
st AS (SELECT codec, feature, count(*) AS n, count(*) FILTER (WHERE ok) AS n_valid, avg(value_ref) FILTER (WHERE ok) AS ma, avg(value_codec) FILTER (WHERE ok) AS mb,
  stddev_pop(value_ref) FILTER (WHERE ok) AS sa, stddev_pop(value_codec) FILTER (WHERE ok) AS sb, median(value_ref) FILTER (WHERE ok) AS da,
  covar_pop(CASE WHEN ok THEN value_ref END, CASE WHEN ok THEN value_codec END) AS cv FROM ok GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN n_valid >= 2 AND sa > 0 AND sb > 0 THEN cv / (sa * sb) END AS r FROM st)"""


def paired(spark, sf_dir):
    return derive(spark, sf_dir, PAIRED)


@register("pair_correlation", PR + """ SELECT codec, feature, n, n_valid, round(ma, 6) AS mean_ref, round(mb, 6) AS mean_codec, round(sa, 6) AS std_ref,
  round(da, 6) AS median_ref, round(r, 6) AS r, round(1 - n_valid / n, 6) AS nan_rate FROM r""")
def pair_correlation(spark, sf_dir):
    out = A.pair_correlation(paired(spark, sf_dir), ["codec", "feature"])
    return out.select("codec", "feature", "n", "n_valid", *[F.round(c, 6).alias(c) for c in (
        "mean_ref", "mean_codec", "std_ref", "median_ref", "r", "nan_rate")])


SITES = with_clause(pairs=PAIRED) + """, m AS (SELECT codec, feature, site, median(CASE WHEN NOT isnan(value_ref) THEN value_ref ELSE NULL END) AS a,
  median(value_codec) AS b FROM pairs GROUP BY 1, 2, 3)"""


@register("site_level_correlation", SITES + """ SELECT codec, feature, count(*) AS n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS r
FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2""")
def site_level_correlation(spark, sf_dir):
    clean = paired(spark, sf_dir).withColumn("value_ref", F.nanvl("value_ref", F.lit(None).cast("double")))
    out = A.pair_correlation(A.site_medians(clean, ["site"], ["codec", "feature"]), ["codec", "feature"], medians=False)
    return out.select("codec", "feature", F.col("n_valid").alias("n"), F.round("r", 6).alias("r"))


@register("level_differences", PR + """, m AS (SELECT codec, feature, site, median(CASE WHEN NOT isnan(value_ref) THEN value_ref ELSE NULL END) AS a,
  median(value_codec) AS b FROM pairs GROUP BY 1, 2, 3),
s AS (SELECT codec, feature, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rs FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2)
SELECT codec, feature, round(rs - r, 6) AS difference FROM r JOIN s USING (codec, feature) WHERE abs(rs - r) > 0.001""")
def level_differences(spark, sf_dir):
    clean = paired(spark, sf_dir).withColumn("value_ref", F.nanvl("value_ref", F.lit(None).cast("double")))
    keys = ["codec", "feature"]
    cell = A.pair_correlation(paired(spark, sf_dir), keys, medians=False)
    site = A.pair_correlation(A.site_medians(clean, ["site"], keys), keys, medians=False)
    return A.level_differences(cell, site, keys, 0.001).select("codec", "feature", F.round("difference", 6).alias("difference"))


@register("rank_features", PR + """ SELECT feature, round(avg(r), 6) AS mean_r, round(max(r) - min(r), 6) AS spread FROM r GROUP BY feature
HAVING count(DISTINCT codec) = (SELECT count(DISTINCT codec) FROM r)""")
def rank_features(spark, sf_dir):
    out = A.rank_features(A.pair_correlation(paired(spark, sf_dir), ["codec", "feature"], medians=False))
    return out.select("feature", F.round("mean_r", 6).alias("mean_r"), F.round("spread", 6).alias("spread"))


@register("weak_cause", PR + """ SELECT codec, feature, CASE WHEN least(sa, sb) < 1e-10 THEN 'constant' WHEN least(sa, sb) < 1e-6 THEN 'near constant'
  WHEN abs(ma - mb) / greatest(sa, 1e-10) > 3 THEN 'mean shift' ELSE 'other' END AS cause FROM r WHERE abs(coalesce(r, 0)) < 0.01""")
def weak_cause(spark, sf_dir):
    return A.weak_cause(A.pair_correlation(paired(spark, sf_dir), ["codec", "feature"], medians=False)).select(
        "codec", "feature", "cause")


TABLE = """
  SELECT codec, feature, site, avg(CASE WHEN isnan(value_ref) THEN NULL ELSE value_ref END) AS value_ref,
         CASE WHEN feature = 'F3' AND (site = 'site4' OR site = 'site9') THEN NULL ELSE avg(value_codec) END AS value_codec
  FROM ({}) GROUP BY 1, 2, 3""".replace("{}", PAIRED)


@register("table_correlation", with_clause(t=TABLE) + """, s AS (SELECT codec, count(DISTINCT site) AS n FROM t GROUP BY 1),
g AS (SELECT codec, feature FROM t JOIN s USING (codec) GROUP BY codec, feature, n HAVING count(value_ref) >= floor(0.7 * n) AND count(value_codec) >= floor(0.7 * n)),
need AS (SELECT codec, count(*) AS need FROM g GROUP BY 1),
w AS (SELECT codec, site FROM t SEMI JOIN g USING (codec, feature) JOIN need USING (codec) GROUP BY codec, site, need
      HAVING count(*) FILTER (WHERE value_ref IS NOT NULL AND value_codec IS NOT NULL) = need)
SELECT codec, feature, round(CASE WHEN stddev_pop(value_ref) > 0 THEN corr(value_ref, value_codec) END, 6) AS corr, count(*) AS size
FROM t SEMI JOIN g USING (codec, feature) SEMI JOIN w USING (codec, site) GROUP BY 1, 2""")
def table_correlation(spark, sf_dir):
    out = A.table_correlation(derive(spark, sf_dir, TABLE), "codec")
    return out.select("codec", "feature", F.round(F.nanvl("corr", F.lit(None).cast("double")), 6).alias("corr"), "size")


@register("correlation_pivot", PR + """ SELECT feature, round(median(r) FILTER (WHERE codec = 'c0'), 6) AS c0, round(median(r) FILTER (WHERE codec = 'c1'), 6) AS c1,
  round(median(r) FILTER (WHERE codec = 'c2'), 6) AS c2 FROM r GROUP BY feature""")
def correlation_pivot(spark, sf_dir):
    stats = A.pair_correlation(paired(spark, sf_dir), ["codec", "feature"], medians=False).withColumnRenamed("r", "corr")
    out = A.correlation_pivot(stats, "feature", "codec", ["c0", "c1", "c2"])
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")])


# ---- replicate wells -----------------------------------------------------------------


WELLS = """
  SELECT l_suppkey % 6 AS plate, 't' || (l_partkey % 5) AS treatment, 'W' || (l_suppkey % 18) AS well, 'F' || l_linenumber AS feature,
         l_extendedprice AS value FROM {lineitem}"""
SIDES = with_clause(w=WELLS) + """, d AS (SELECT DISTINCT plate, treatment, well FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY plate, treatment ORDER BY well) AS rn, count(*) OVER (PARTITION BY plate, treatment) AS c FROM d),
sided AS (SELECT w.*, CASE WHEN rn = 1 THEN 'a' ELSE 'b' END AS side FROM w JOIN p USING (plate, treatment, well) WHERE rn <= 2 AND c >= 2)"""


def sided(spark, sf_dir):
    wells = derive(spark, sf_dir, WELLS)
    return wells.join(A.replicate_wells(wells, "plate", "treatment", "well"), ["plate", "treatment", "well"])


@register("replicate_wells", SIDES + " SELECT DISTINCT plate, treatment, well, side FROM sided")
def replicate_wells(spark, sf_dir):
    return A.replicate_wells(derive(spark, sf_dir, WELLS), "plate", "treatment", "well")


DISTANCE = SIDES + """, u AS (SELECT plate, treatment, feature, value, count(*) FILTER (WHERE side = 'a') AS a, count(*) FILTER (WHERE side = 'b') AS b FROM sided GROUP BY 1, 2, 3, 4),
c AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS na, sum(b) OVER t AS nb, lead(value) OVER w AS nx FROM u
      WINDOW w AS (PARTITION BY plate, treatment, feature ORDER BY value), t AS (PARTITION BY plate, treatment, feature)),
k AS (SELECT plate, treatment, feature, max(abs(ca / na - cb / nb)) AS ks, sum(abs(ca / na - cb / nb) * coalesce(nx - value, 0)) AS w1 FROM c GROUP BY 1, 2, 3),
v AS (SELECT plate, treatment, feature, avg(value) FILTER (WHERE side = 'a') AS ma, avg(value) FILTER (WHERE side = 'b') AS mb,
  var_samp(value) FILTER (WHERE side = 'a') AS va, var_samp(value) FILTER (WHERE side = 'b') AS vb FROM sided GROUP BY 1, 2, 3),
dist AS (SELECT plate, treatment, feature, ks AS ks_stat, abs(ma - mb) / sqrt((va + vb) / 2) AS cohens_d, w1 / sqrt((va + vb) / 2) AS wasserstein_norm,
  least(greatest(va, vb) / least(va, vb), 100) AS variance_ratio FROM k JOIN v USING (plate, treatment, feature))"""
MEASURES = ["ks_stat", "cohens_d", "wasserstein_norm", "variance_ratio"]


def distances(spark, sf_dir):
    return A.distribution_distance(sided(spark, sf_dir), ["plate", "treatment", "feature"])


@register("ks_wasserstein", DISTANCE + " SELECT plate, treatment, feature, " + ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES) + " FROM dist")
def ks_wasserstein(spark, sf_dir):
    return distances(spark, sf_dir).select("plate", "treatment", "feature", *[F.round(m, 6).alias(m) for m in MEASURES])


@register("cross_well_summary", DISTANCE + " SELECT feature, " + ", ".join(
    f"round(avg({m}), 6) AS mean_{m}, round(median({m}), 6) AS median_{m}" for m in MEASURES) + " FROM dist GROUP BY feature")
def cross_well_summary(spark, sf_dir):
    out = A.cross_well_summary(distances(spark, sf_dir), ["feature"])
    return out.select("feature", *[F.round(c, 6).alias(c) for c in out.columns if c != "feature"])


@register("codec_delta", DISTANCE + """ SELECT o.plate, o.treatment, o.feature AS codec, round(o.ks_stat - b.ks_stat, 6) AS delta FROM dist o
JOIN dist b ON o.plate = b.plate AND o.treatment = b.treatment AND b.feature = 'F1' AND o.feature <> 'F1'""")
def codec_delta(spark, sf_dir):
    metrics = distances(spark, sf_dir).withColumnRenamed("feature", "codec")
    out = A.codec_delta(metrics, ["plate", "treatment"], "F1", ["ks_stat"])
    return out.select("plate", "treatment", "codec", F.round("delta_ks_stat", 6).alias("delta"))


MEDIANS = SIDES + """, md AS (SELECT plate, treatment, feature, median(value) FILTER (WHERE side = 'a') AS a, median(value) FILTER (WHERE side = 'b') AS b FROM sided GROUP BY 1, 2, 3)"""


@register("well_profile_spearman", MEDIANS + """, k AS (SELECT plate, treatment, rank() OVER (PARTITION BY plate, treatment ORDER BY a) AS ra,
  rank() OVER (PARTITION BY plate, treatment ORDER BY b) AS rb FROM md)
SELECT plate, treatment, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM k GROUP BY 1, 2""")
def well_profile_spearman(spark, sf_dir):
    medians = A.well_medians(sided(spark, sf_dir), ["plate", "treatment", "feature"])
    return A.well_profile_correlation(medians, ["plate", "treatment"]).withColumn("rho", F.round("rho", 6))


@register("replicate_spearman", MEDIANS + """, k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY a) AS ra,
  rank() OVER (PARTITION BY feature ORDER BY b) AS rb FROM md), c AS (SELECT feature, count(*) AS n, corr(ra, rb) AS rho FROM k GROUP BY 1)
SELECT feature, n, round(rho, 6) AS rho, CASE WHEN rho >= 0.9 THEN 'green' WHEN rho < 0.5 THEN 'red' END AS listing FROM c WHERE n >= 5""")
def replicate_spearman(spark, sf_dir):
    medians = A.well_medians(sided(spark, sf_dir), ["plate", "treatment", "feature"])
    return A.replicate_correlation(medians, []).select("feature", "n", F.round("rho", 6).alias("rho"), "listing")


@register("reference_ranking", DISTANCE + """ SELECT feature, round(avg(ks_stat), 6) AS mean_value FROM dist WHERE plate = 0 GROUP BY feature""")
def reference_ranking(spark, sf_dir):
    out = A.reference_ranking(distances(spark, sf_dir), "0", "ks_stat", codec="plate")
    return out.select("feature", F.round("mean_value", 6).alias("mean_value"))


# ---- naming ----------------------------------------------------------------------------


FEATURE_NAMES = """
  SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN 'cell_0/max/sizeshapeArea' WHEN 2 THEN 'nuclei_3/max/intensityIntensity_MeanIntensity'
    WHEN 3 THEN 'cell_1/max/textureTexture_Contrast_3_00_256' WHEN 4 THEN 'cell_4/max/radial_distributionRadialDistribution_FracAtD_1of4'
    WHEN 5 THEN 'nuclei_2/max/zernikeZernike_4_0' WHEN 6 THEN 'cell_0/max/sizeshapeCentralMoment_0_1' ELSE 'odd' END AS feature FROM {lineitem}"""


@register("feature_names", with_clause(n=FEATURE_NAMES) + """ SELECT id, feature, CASE feature WHEN 'cell_0/max/sizeshapeArea' THEN 'Area' WHEN 'nuclei_3/max/intensityIntensity_MeanIntensity' THEN 'Intensity'
  WHEN 'cell_1/max/textureTexture_Contrast_3_00_256' THEN 'Texture' WHEN 'cell_4/max/radial_distributionRadialDistribution_FracAtD_1of4' THEN 'distributionRadialDistribution_FracAtD'
  WHEN 'nuclei_2/max/zernikeZernike_4_0' THEN '4_0' WHEN 'cell_0/max/sizeshapeCentralMoment_0_1' THEN 'CentralMoment' ELSE 'Unknown' END AS subcategory,
  CASE feature WHEN 'cell_0/max/sizeshapeArea' THEN 'Cells_AreaShape_Area' WHEN 'nuclei_3/max/intensityIntensity_MeanIntensity' THEN 'Nuclei_Intensity_MeanIntensity_RNA'
  WHEN 'cell_1/max/textureTexture_Contrast_3_00_256' THEN 'Cells_Texture_Contrast_AGP_3_00_256' WHEN 'cell_4/max/radial_distributionRadialDistribution_FracAtD_1of4' THEN 'Cells_RadialDistribution_FracAtD_ER_1of4'
  WHEN 'nuclei_2/max/zernikeZernike_4_0' THEN 'Nuclei_AreaShape_Zernike_4_0' WHEN 'cell_0/max/sizeshapeCentralMoment_0_1' THEN 'Cells_AreaShape_CentralMoment_0_1' END AS mapped FROM n""")
def feature_names(spark, sf_dir):
    df = derive(spark, sf_dir, FEATURE_NAMES)
    parts = N.with_name_parts(distinct_names(df)).select(
        F.col("full_feature_name").alias("feature"), N.feature_subcategory("feature").alias("subcategory"),
        N.candidate_name("full_feature_name").alias("mapped"))
    return df.join(parts, "feature")


def distinct_names(df):
    """The few names of a table, written once so that name rules run on them only."""
    return cut_lineage(df.select("feature").distinct())


@register("map_coverage", with_clause(n=FEATURE_NAMES) + """, s AS (SELECT DISTINCT feature FROM n) SELECT 'short' AS vocabulary, 'mapped' AS kind, count(*) AS n FROM s
  WHERE feature IN ('cell_0/max/sizeshapeArea', 'nuclei_2/max/zernikeZernike_4_0')
UNION ALL SELECT 'short', 'unmapped', count(*) FROM s WHERE feature NOT IN ('cell_0/max/sizeshapeArea', 'nuclei_2/max/zernikeZernike_4_0')
UNION ALL SELECT 'long', 'mapped', 2 UNION ALL SELECT 'long', 'unmapped', count(DISTINCT p_type) FROM part UNION ALL SELECT 'long', 'ambiguous', 0""")
def map_coverage(spark, sf_dir):
    short = distinct_names(derive(spark, sf_dir, FEATURE_NAMES))
    known = short.select(N.candidate_name("feature").alias("feature")).filter(F.col("feature").startswith("Cells_AreaShape_Area")
                                                                             | F.col("feature").startswith("Nuclei_AreaShape"))
    long = table(spark, sf_dir, "part").select(F.col("p_type").alias("feature")).unionByName(known)
    return N.map_coverage(short, long, N.map_names(short, long))


@register("green_list", with_clause(n=FEATURE_NAMES) + """ SELECT id, feature FROM n WHERE feature IN ('cell_0/max/sizeshapeArea',
  'nuclei_3/max/intensityIntensity_MeanIntensity')""")
def green_list(spark, sf_dir):
    df = derive(spark, sf_dir, FEATURE_NAMES)
    parts = N.core_parts("feature")
    listed = df.filter(F.col("feature").rlike("Area$|MeanIntensity$|CentralMoment")).select(
        parts["g_object"].alias("object"), F.when(F.col("feature").contains("Intensity"), F.concat_ws("_", parts["g_channel"], parts["g_core"]))
        .otherwise(parts["g_core"]).alias("feature")).distinct()
    return N.filter_by_green_list(df, listed, "feature")


@register("red_features", with_clause(n=FEATURE_NAMES) + " SELECT id, feature FROM n WHERE feature NOT LIKE '%CentralMoment_0_1%'")
def red_features(spark, sf_dir):
    return N.without_red_features(derive(spark, sf_dir, FEATURE_NAMES))


@register("feature_similarity", f"""WITH {PROFILES}, g AS (SELECT a.pos AS i, b.pos AS j, sum(a.value * b.value) AS d FROM cells a JOIN cells b USING (row_id) GROUP BY 1, 2),
nm AS (SELECT i, sqrt(d) AS n FROM g WHERE i = j), c AS (SELECT g.i, d / (x.n * y.n) AS s FROM g JOIN nm x ON x.i = g.i JOIN nm y ON y.i = g.j WHERE g.i <> g.j),
f AS (SELECT i % 8 AS k, avg(s) AS m, stddev_pop(s) AS sd, max(s) AS hi, min(s) AS lo FROM c GROUP BY i)
SELECT 'b' || k AS feature, round(avg(m), 6) AS sim_mean, round(avg(sd), 6) AS sim_std, round(avg(hi), 6) AS sim_max, round(avg(lo), 6) AS sim_min FROM f GROUP BY k""")
def feature_similarity(spark, sf_dir):
    df = profiles(spark, sf_dir)
    out = A.feature_similarity(Profiles(df, [f"c{i // 8}/max/b{i % 8}" for i in range(64)]))
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("sim_mean", "sim_std", "sim_max", "sim_min")])


@register("cell_features", with_clause(l=LONG) + """ SELECT site, label, obs, value, '0_' || metric AS feature FROM l WHERE object = 'cell' AND branch = '0/max/' AND metric NOT IN ('Area')
UNION ALL SELECT site, label, obs, value, '1_' || metric FROM l WHERE object = 'cell' AND branch = '1/max/' AND metric NOT IN ('Area')
UNION ALL SELECT site, label, obs, value, metric FROM l WHERE object = 'cell' AND branch = '0/max/' AND metric = 'Area'""")
def cell_features(spark, sf_dir):
    kind = F.when(F.col("metric") == "Area", "sizeshape").otherwise("intensity")
    df = derive(spark, sf_dir, LONG).withColumn("branch", F.concat("branch", kind))
    return A.cell_features(df).select("site", "label", "obs", "value", "feature")


# ---- masks -----------------------------------------------------------------------------


PX = with_clause(px=PIXELS) + """, o AS (SELECT source_id, file, method, gt_label AS gt_id, pred_label AS pred_id, count(*) AS overlap FROM px GROUP BY ALL),
g AS (SELECT source_id, file, method, gt_id, sum(overlap) AS ga FROM o GROUP BY ALL), p AS (SELECT source_id, file, method, pred_id, sum(overlap) AS pa FROM o GROUP BY ALL),
sc AS (SELECT o.*, overlap / (ga + pa - overlap) AS iou, overlap / ga AS iot, overlap / pa AS iop FROM o JOIN g USING (source_id, file, method, gt_id)
  JOIN p USING (source_id, file, method, pred_id) WHERE gt_id > 0 AND pred_id > 0)"""


def overlap(spark, sf_dir):
    return M.label_overlap(derive(spark, sf_dir, PIXELS))


@register("mask_overlap", PX + """ SELECT source_id, file, method, gt_id, pred_id, overlap, round(iou, 6) AS iou, round(iot, 6) AS iot, round(iop, 6) AS iop FROM sc""")
def mask_overlap(spark, sf_dir):
    out = M.overlap_scores(overlap(spark, sf_dir))
    return out.select("source_id", "file", "method", "gt_id", "pred_id", "overlap", *[F.round(c, 6).alias(c) for c in ("iou", "iot", "iop")])


@register("true_positives", PX + " SELECT source_id, file, method, gt_id, pred_id, round(iou, 6) AS iou FROM sc WHERE iou >= 0.7")
def true_positives(spark, sf_dir):
    return M.true_positives(overlap(spark, sf_dir), 0.7).select(
        "source_id", "file", "method", "gt_id", "pred_id", F.round("iou", 6).alias("iou"))


COUNTS = PX + """, n AS (SELECT source_id, file, method, count(DISTINCT gt_id) FILTER (WHERE gt_id > 0) AS n_true, count(DISTINCT pred_id) FILTER (WHERE pred_id > 0) AS n_pred FROM o GROUP BY ALL),
tp AS (SELECT source_id, file, method, thresh, count(*) FILTER (WHERE iou >= thresh) AS tp FROM sc, (VALUES (0.7), (0.8), (0.9)) AS t(thresh) GROUP BY ALL),
mt AS (SELECT n.*, CAST(thresh AS DOUBLE) AS thresh, tp FROM n JOIN tp USING (source_id, file, method))"""


def mapping(spark, sf_dir):
    return M.instance_mapping(overlap(spark, sf_dir), (0.7, 0.8, 0.9))


@register("match_types", COUNTS + """ SELECT source_id, file, method, thresh, tp AS n_tp, least(n_true, n_pred) - tp AS n_below_thresh,
  n_true - least(n_true, n_pred) AS n_fn, n_pred - least(n_true, n_pred) AS n_fp FROM mt""")
def match_types(spark, sf_dir):
    out = M.match_type_shares(mapping(spark, sf_dir), ["source_id", "file", "method", "thresh"])
    return out.select("source_id", "file", "method", "thresh", "n_tp", "n_below_thresh", "n_fn", "n_fp")


@register("matching_metrics", COUNTS + """ SELECT source_id, file, method, thresh, tp, n_pred - tp AS fp, n_true - tp AS fn, n_true, n_pred,
  round(CASE WHEN tp > 0 THEN tp / n_pred ELSE 0 END, 6) AS precision, round(CASE WHEN tp > 0 THEN tp / n_true ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * tp / (n_true + n_pred) ELSE 0 END, 6) AS f1 FROM mt""")
def matching_metrics(spark, sf_dir):
    out = M.matching_metrics(mapping(spark, sf_dir))
    return out.select("source_id", "file", "method", "thresh", "tp", "fp", "fn", "n_true", "n_pred",
                      *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


FG = PX + """, fg AS (SELECT source_id, file, method, count(*) FILTER (WHERE gt_label > 0 AND pred_label > 0) AS tp,
  count(*) FILTER (WHERE gt_label = 0 AND pred_label > 0) AS fp, count(*) FILTER (WHERE gt_label > 0 AND pred_label = 0) AS fn FROM px GROUP BY ALL)"""


@register("dice_iou", FG + """ SELECT source_id, file, method, round(2 * tp / (2 * tp + fp + fn), 6) AS dice, round(tp / (tp + fp + fn), 6) AS iou,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM fg""")
def dice_iou(spark, sf_dir):
    out = M.foreground_metrics(derive(spark, sf_dir, PIXELS))
    return out.select("source_id", "file", "method", *[F.round(c, 6).alias(c) for c in ("dice", "iou", "precision", "recall")])


@register("extreme_samples", FG + """, m AS (SELECT source_id, file, avg(tp / (tp + fp + fn)) AS mean FROM fg GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY mean) AS rn, count(*) OVER () AS n FROM m)
SELECT source_id, file, round(mean, 6) AS mean, CASE WHEN rn = 1 THEN 'worst' WHEN rn = n THEN 'best' ELSE 'median' END AS sample
FROM r WHERE rn IN (1, n // 2 + 1, n)""")
def extreme_samples(spark, sf_dir):
    return M.extreme_samples(M.foreground_metrics(derive(spark, sf_dir, PIXELS))).withColumn("mean", F.round("mean", 6))


@register("percentile_markers", FG + """, m AS (SELECT method AS codec, tp / (tp + fp + fn) AS iou FROM fg)
SELECT codec, round(quantile_cont(iou, 0.05), 6) AS iou_p5, round(quantile_cont(iou, 0.95), 6) AS iou_p95 FROM m GROUP BY codec""")
def percentile_markers(spark, sf_dir):
    metrics = M.foreground_metrics(derive(spark, sf_dir, PIXELS)).withColumnRenamed("method", "codec")
    out = I.percentile_markers(metrics, ["iou"])
    return out.select("codec", F.round("iou_p5", 6).alias("iou_p5"), F.round("iou_p95", 6).alias("iou_p95"))


@register("codec_summary", FG + """, m AS (SELECT method AS codec, 'dice' AS metric, 2 * tp / (2 * tp + fp + fn) AS v FROM fg UNION ALL SELECT method, 'iou', tp / (tp + fp + fn) FROM fg)
SELECT codec, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(median(v), 6) AS median, count(v) AS n FROM m GROUP BY 1, 2""")
def codec_summary(spark, sf_dir):
    metrics = M.foreground_metrics(derive(spark, sf_dir, PIXELS)).withColumnRenamed("method", "codec")
    out = I.codec_summary(metrics, ["dice", "iou"])
    return out.select("codec", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "median")], "n")


@register("threshold_ablation", COUNTS + """, f AS (SELECT method AS codec, CAST(round(thresh * 100) AS INTEGER) AS threshold, CASE WHEN tp > 0 THEN 2 * tp / (n_true + n_pred) ELSE 0 END AS f1 FROM mt)
SELECT codec, threshold, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std FROM f GROUP BY 1, 2""")
def threshold_ablation(spark, sf_dir):
    metrics = M.matching_metrics(mapping(spark, sf_dir))
    wide = metrics.groupBy("source_id", "file", F.col("method").alias("codec")).pivot("thresh", [0.7, 0.8, 0.9]).agg(F.first("f1"))
    named = wide.withColumnsRenamed({"0.7": "inst_f1_70", "0.8": "inst_f1_80", "0.9": "inst_f1_90"})
    out = M.threshold_ablation(named, "f1", thresholds=(70, 80, 90))
    return out.select("codec", "threshold", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("nearest_threshold", with_clause(px=PIXELS) + """ SELECT source_id, file, gt_label AS gt_id, pred_label AS pred_id, original AS iou_score FROM px
WHERE y = 31 AND method = 'm0'""")
def nearest_threshold(spark, sf_dir):
    df = derive(spark, sf_dir, PIXELS).select(
        "source_id", "file", F.col("gt_label").alias("gt_id"), F.col("pred_label").alias("pred_id"),
        F.col("original").alias("iou_score"), F.col("y").cast("double").alias("thresh"),
        F.when(F.col("method") == "m0", "TP").otherwise("FN").alias("match_type"))
    return A.nearest_threshold(df, 31.3)


MATCHED = """
  SELECT 's' || (l_suppkey % 9) AS source_id, 'f' || l_linenumber AS file, l_partkey % 30 AS gt_id, (l_partkey + 3) % 30 AS pred_id,
         'F' || (l_suppkey % 4) AS feature, avg(l_quantity) AS a, avg(l_tax) AS b FROM {lineitem} GROUP BY 1, 2, 3, 4, 5"""


@register("matched_features", with_clause(m=MATCHED) + """, mp AS (SELECT DISTINCT source_id, file, gt_id, pred_id FROM m)
SELECT x.source_id, x.file, x.feature, round(corr(x.a, y.b), 6) AS r, count(*) AS n FROM m x JOIN mp ON mp.source_id = x.source_id AND mp.file = x.file AND mp.gt_id = x.gt_id
JOIN m y ON y.source_id = mp.source_id AND y.file = mp.file AND y.gt_id = mp.pred_id AND y.feature = x.feature GROUP BY 1, 2, 3""")
def matched_features(spark, sf_dir):
    df = derive(spark, sf_dir, MATCHED)
    ref = df.select("source_id", "file", F.col("gt_id").alias("label"), "feature", F.col("a").alias("value"))
    var = df.select("source_id", "file", F.col("gt_id").alias("label"), "feature", F.col("b").alias("value"))
    mapping_ = df.select("source_id", "file", "gt_id", "pred_id").distinct()
    out = A.pair_correlation(A.matched_features(ref, mapping_, var), ["source_id", "file", "feature"], medians=False)
    return out.select("source_id", "file", "feature", F.round("r", 6).alias("r"), "n")


SURFACES = with_clause(px=PIXELS) + """, on_ AS (SELECT DISTINCT source_id, file, method, y, x, 'gt' AS side FROM px WHERE gt_label > 0
  UNION ALL SELECT DISTINCT source_id, file, method, y, x, 'pred' FROM px WHERE pred_label > 0),
edge AS (SELECT a.* FROM on_ a LEFT JOIN on_ b ON b.source_id = a.source_id AND b.file = a.file AND b.method = a.method AND b.side = a.side
  AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY ALL HAVING count(b.y) < 4),
near_ AS (SELECT a.source_id, a.file, a.method, a.side, a.y, a.x, sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d
  FROM edge a JOIN edge b ON b.source_id = a.source_id AND b.file = a.file AND b.method = a.method AND b.side <> a.side GROUP BY ALL)
SELECT e.source_id, e.file, e.method, round(quantile_cont(d, 0.95), 6) AS hausdorff_95, round(max(d), 6) AS hausdorff_max,
  round(avg(d) FILTER (n.side = 'pred'), 6) AS asd
FROM (SELECT DISTINCT source_id, file, method FROM edge) e LEFT JOIN near_ n
  ON n.source_id = e.source_id AND n.file = e.file AND n.method = e.method GROUP BY ALL"""


@register("surface_distances", SURFACES)
def surface_distances(spark, sf_dir):
    out = M.surface_distances(derive(spark, sf_dir, PIXELS))
    return out.select(*M.SITE, *[F.round(c, 6).alias(c) for c in ("hausdorff_95", "hausdorff_max", "asd")])


@register("pixel_error", with_clause(px=PIXELS) + """ SELECT source_id, method, round(-10 * log10(avg(((original - variant) / 65535) ** 2)), 6) AS psnr FROM px GROUP BY 1, 2""")
def pixel_error(spark, sf_dir):
    out = I.pixel_error(derive(spark, sf_dir, PIXELS), ["source_id", "method"], "original", "variant")
    return out.select("source_id", "method", F.round("psnr", 6).alias("psnr"))


PLANES = """
  SELECT 's' || (l_suppkey % 10) AS site, l_linenumber AS channel, CAST(l_orderkey % 16 AS INT) AS y, CAST(l_partkey % 16 AS INT) AS x,
         CAST(floor(avg(l_quantity) * 1000) AS INT) AS a,
         CAST(floor(avg(l_quantity) * 1000 + avg(l_tax) * 9000) AS INT) AS b
  FROM {lineitem} GROUP BY 1, 2, 3, 4"""


def planes(spark, sf_dir):
    px = derive(spark, sf_dir, PLANES).withColumn("v", F.explode(F.array(
        F.struct(F.lit("raw").alias("codec"), F.col("a").alias("p")), F.struct(F.lit("hq").alias("codec"), F.col("b").alias("p")))))
    held = F.map_from_entries(F.collect_list(F.struct(F.col("y") * 16 + F.col("x"), "v.p")))
    slots = F.sequence(F.lit(0), F.lit(255))
    return px.groupBy("site", "channel", "v.codec").agg(held.alias("m")).select(
        "site", "channel", "codec", F.lit(16).alias("h"), F.lit(16).alias("w"),
        F.transform(slots, lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("pixels"))


IMG = with_clause(pl=PLANES) + """, pix AS (SELECT site, channel, a / 65535 AS a, b / 65535 AS b FROM pl)"""


@register("image_psnr", IMG + """, e AS (SELECT site, sum((a - b) * (a - b)) AS sse, count(DISTINCT channel) * 256 AS n FROM pix GROUP BY site)
SELECT site, round(-10 * log10(sse / n), 6) AS psnr FROM e""")
def image_psnr(spark, sf_dir):
    out = I.image_quality(planes(spark, sf_dir), "raw").filter("codec = 'hq'")
    return out.select("site", F.round("psnr", 6).alias("psnr"))


@register("image_sharpness", with_clause(pl=PLANES) + """, sites AS (SELECT DISTINCT site, channel FROM pl),
grid AS (SELECT site, channel, y, x FROM sites, range(-1, 17) AS ty(y), range(-1, 17) AS tx(x)),
f AS (SELECT g.site, g.channel, g.y, g.x, coalesce(pl.a, 0) AS v FROM grid g LEFT JOIN pl ON pl.site = g.site AND pl.channel = g.channel
  AND pl.y = least(greatest(g.y, 0), 15) AND pl.x = least(greatest(g.x, 0), 15)),
lap AS (SELECT c.site, c.channel, 4 * c.v - u.v - d.v - l.v - r.v AS l FROM f c
  JOIN f u ON u.site = c.site AND u.channel = c.channel AND u.y = c.y - 1 AND u.x = c.x
  JOIN f d ON d.site = c.site AND d.channel = c.channel AND d.y = c.y + 1 AND d.x = c.x
  JOIN f l ON l.site = c.site AND l.channel = c.channel AND l.y = c.y AND l.x = c.x - 1
  JOIN f r ON r.site = c.site AND r.channel = c.channel AND r.y = c.y AND r.x = c.x + 1 WHERE c.y BETWEEN 0 AND 15 AND c.x BETWEEN 0 AND 15),
v AS (SELECT site, channel, var_pop(l) AS v FROM lap GROUP BY 1, 2)
SELECT site, round(avg(v), 3) AS laplacian_orig FROM v GROUP BY site""")
def image_sharpness(spark, sf_dir):
    out = I.image_quality(planes(spark, sf_dir), "raw").filter("codec = 'raw'")
    return out.select("site", F.round("laplacian_orig", 3).alias("laplacian_orig"))


@register("image_quality")
def image_quality(spark, sf_dir):
    return I.image_quality(planes(spark, sf_dir), "raw")


FILES = """SELECT 's' || (l_suppkey % 20) AS source_id, 'f' || (l_partkey % 200) AS file,
  CASE WHEN l_linenumber % 2 = 0 THEN 'ref' ELSE 'var' END AS side, 'p' || l_orderkey AS path FROM {lineitem}"""


@register("matched_sites", with_clause(t=FILES) + """ SELECT a.source_id, a.file, a.path AS reference_path, b.path AS variant_path FROM t a JOIN (
  SELECT source_id, file, max(path) AS path FROM t WHERE side = 'var' GROUP BY ALL) b ON b.source_id = a.source_id AND b.file = a.file WHERE a.side = 'ref'""")
def matched_sites(spark, sf_dir):
    files = derive(spark, sf_dir, FILES)
    return A.matched_sites(files.filter("side = 'ref'"), files.filter("side = 'var'"))


@register("joined_statistics", with_clause(p=PAIRED) + """, n AS (SELECT feature, codec, stddev_samp(value_codec) AS noise FROM p WHERE codec <> 'c1' OR feature <> 'F3' GROUP BY ALL),
s AS (SELECT feature, codec, avg(value_codec) AS level, count(value_codec) AS n FROM p GROUP BY ALL)
SELECT n.feature, n.codec, round(noise, 6) AS noise_noise, round(level, 6) AS similarity_level, n AS similarity_n FROM n JOIN s ON s.feature = n.feature AND s.codec = n.codec""")
def joined_statistics(spark, sf_dir):
    rows = derive(spark, sf_dir, PAIRED)
    noise = rows.filter("codec <> 'c1' or feature <> 'F3'").groupBy("feature", "codec").agg(F.round(F.stddev_samp("value_codec"), 6).alias("noise"))
    level = rows.groupBy("feature", "codec").agg(F.round(F.avg("value_codec"), 6).alias("level"), F.count("value_codec").alias("n"))
    return A.joined_statistics({"noise": noise, "similarity": level}, keys=["codec"])
