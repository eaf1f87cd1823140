"""Analytics over sweep and recall results."""

from pyspark.sql import functions as F

from platewise.catalog.inputs import RECALL, RESULTS
from platewise.catalog.registry import derive, register, table, with_clause
from platewise.operators import results as R

RES = with_clause(res=RESULTS)
REC = with_clause(rec=RECALL)
ORDER = ["raw", "hq", "mq", "d20"]


def results(spark, sf_dir):
    return derive(spark, sf_dir, RESULTS)


def recall(spark, sf_dir):
    return derive(spark, sf_dir, RECALL).withColumnRenamed("grp_", "group")


BEST = RES + """, s AS (SELECT *, PA * PC / 100 AS score FROM res),
own AS (SELECT family, codec, config AS own FROM (SELECT *, row_number() OVER (PARTITION BY family, codec
  ORDER BY score DESC, config) AS rn FROM s) WHERE rn = 1)"""
PINNED = BEST + """, pins AS ({pins}), c AS (SELECT own.family, own.codec, coalesce(
  (SELECT s.config FROM s WHERE s.family = own.family AND s.codec = own.codec AND s.config = pins.config), own.own) AS config
  FROM own LEFT JOIN pins USING (family))
SELECT s.family, s.codec, s.config, round(s.score, 6) AS score FROM s JOIN c USING (family, codec, config)"""
FIRST = "SELECT family, config FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {m} DESC, config) AS rn FROM {t}) WHERE rn = 1"


def best(spark, sf_dir, mode):
    out = R.select_best(R.score_column(results(spark, sf_dir)), mode=mode)
    return out.select("family", "codec", "config", F.round("score", 6).alias("score"))


@register("select_best_per_codec", BEST + """ SELECT s.family, s.codec, s.config, round(score, 6) AS score FROM s
JOIN own ON s.family = own.family AND s.codec = own.codec AND s.config = own.own""")
def select_best_per_codec(spark, sf_dir):
    return best(spark, sf_dir, "per_codec")


@register("select_best_reference", PINNED.format(pins=FIRST.format(m="score", t="s WHERE codec = 'zstd'")))
def select_best_reference(spark, sf_dir):
    return best(spark, sf_dir, "zstd_reference")


@register("select_best_any_codec", PINNED.format(pins=FIRST.format(m="score", t="s")))
def select_best_any_codec(spark, sf_dir):
    return best(spark, sf_dir, "best_any_codec")


@register("select_best_average", PINNED.format(pins=FIRST.format(
    m="m", t="(SELECT family, config, avg(score) AS m FROM s GROUP BY 1, 2)")))
def select_best_average(spark, sf_dir):
    return best(spark, sf_dir, "best_avg_codec")


@register("score_modes", RES + """, t AS (SELECT max(PA_mean_nap) AS a, max(PC_mean_nap) AS c FROM res)
SELECT family, codec, config, round(PA * PC / 100, 6) AS balanced,
  round((CASE WHEN a > 0 THEN PA_mean_nap / a ELSE PA_mean_nap END) * (CASE WHEN c > 0 THEN PC_mean_nap / c ELSE PC_mean_nap END), 6) AS nap_balanced,
  round(CASE WHEN PA_mean_nap > 0 AND PC_mean_nap > 0 THEN sqrt(PA_mean_nap * PC_mean_nap) END, 6) AS geometric FROM res, t""")
def score_modes(spark, sf_dir):
    df = results(spark, sf_dir)
    for mode in ("balanced", "nap_balanced", "geometric"):
        df = R.score_column(df, mode, mode)
    return df.select("family", "codec", "config", *[F.round(m, 6).alias(m) for m in ("balanced", "nap_balanced", "geometric")])


@register("top_configs", RES + """ SELECT family, codec, config, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (
  PARTITION BY family, codec ORDER BY PC_mean_nap DESC, config) AS rn FROM res) WHERE rn <= 3""")
def top_configs(spark, sf_dir):
    return R.top_configs(results(spark, sf_dir), "PC_mean_nap", 3).select("family", "codec", "config", "place")


DELTAS = REC + """, d AS (SELECT o.family, o.codec, o.config, o.task, o.modality, o.grp_ AS "group",
    b.recall_5 AS base, o.recall_5 AS value FROM rec o JOIN rec b ON o.family = b.family AND b.codec = 'raw' AND o.codec <> 'raw'
    AND o.config = b.config AND o.task = b.task AND o.modality IS NOT DISTINCT FROM b.modality AND o.grp_ IS NOT DISTINCT FROM b.grp_)"""


def deltas(spark, sf_dir):
    return R.build_deltas(recall(spark, sf_dir), "recall_5", ORDER)


@register("delta_vs_baseline", DELTAS + """ SELECT family, codec, config, task, modality, "group", round(value - base, 6) AS delta FROM d""")
def delta_vs_baseline(spark, sf_dir):
    return deltas(spark, sf_dir).select("family", "codec", "config", "task", "modality", "group",
                                        F.round("delta", 6).alias("delta"))


@register("percent_deltas", DELTAS + """ SELECT family, codec, task, round(avg(100 * (value - base) / abs(base)), 6) AS mean,
  round(stddev_samp(100 * (value - base) / abs(base)), 6) AS std, count(*) AS n FROM d WHERE abs(base) > 1e-12 GROUP BY 1, 2, 3""")
def percent_deltas(spark, sf_dir):
    out = R.percent_deltas(deltas(spark, sf_dir), ["family", "codec", "task"])
    return out.select("family", "codec", "task", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@register("group_deltas", RES + """, m AS (SELECT family, codec, avg(PA_mean_nap) AS a, avg(PC_mean_nap) AS c FROM res GROUP BY 1, 2),
l AS (SELECT family, codec, 'a' AS metric, greatest(a, 0) AS v FROM m UNION ALL SELECT family, codec, 'c', greatest(c, 0) FROM m)
SELECT o.family, o.codec, o.metric, round(o.v - b.v, 6) AS delta, round(CASE WHEN abs(b.v) > 1e-12 THEN (o.v - b.v) / b.v * 100 END, 4) AS delta_pct
FROM l o JOIN l b ON o.family = b.family AND o.metric = b.metric AND b.codec = 'zstd' AND o.codec <> 'zstd'""")
def group_deltas(spark, sf_dir):
    means = results(spark, sf_dir).groupBy("family", "codec").agg(
        F.avg("PA_mean_nap").alias("a"), F.avg("PC_mean_nap").alias("c"))
    out = R.group_deltas(means, ["a", "c"], ["raw", "zstd"])
    return out.select("family", "codec", "metric", F.round("delta", 6).alias("delta"), F.round("delta_pct", 4).alias("delta_pct"))


@register("panel", REC + """ SELECT family, codec, config, round(recall_5, 6) AS recall_5 FROM rec
WHERE task = 'GG' AND modality = 'orf' AND grp_ IS NULL""")
def panel(spark, sf_dir):
    out = R.panel(recall(spark, sf_dir), "GG", "orf", None)
    return out.select("family", "codec", "config", F.round("recall_5", 6).alias("recall_5"))


@register("axis_table", REC + """, w AS (SELECT family, codec, config, avg(recall_5) FILTER (WHERE task = 'CC') AS cc,
  avg(recall_5) FILTER (WHERE task = 'GG' AND grp_ IS NULL AND modality <> 'orf') AS gg,
  avg(recall_5) FILTER (WHERE task = 'CG' AND grp_ = 'group_high' AND modality <> 'orf') AS cg_div,
  avg(recall_5) FILTER (WHERE task = 'CG' AND grp_ = 'group_low' AND modality <> 'orf') AS cg_bio FROM rec GROUP BY 1, 2, 3)
SELECT family, codec, config, round(cc, 6) AS cc, round(gg, 6) AS gg, round(cg_div, 6) AS cg_div, round(cg_bio, 6) AS cg_bio,
  round(cc * gg * cg_div * cg_bio, 8) AS score FROM w WHERE cc IS NOT NULL AND gg IS NOT NULL AND cg_div IS NOT NULL AND cg_bio IS NOT NULL""")
def axis_table(spark, sf_dir):
    out = R.axis_table(recall(spark, sf_dir), "recall_5", drop_orf=True)
    return out.select("family", "codec", "config", *[F.round(c, 6).alias(c) for c in ("cc", "gg", "cg_div", "cg_bio")],
                      F.round("score", 8).alias("score"))


@register("table_means", REC + """, t AS (SELECT family, codec, task, avg(recall_5) AS m FROM rec GROUP BY 1, 2, 3),
p AS (SELECT family, codec, avg(m) AS a FROM t GROUP BY 1, 2), x AS (SELECT codec, avg(a) AS c FROM (
  SELECT codec, task, avg(m) AS a FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT family, codec, round(a, 6) AS mean_over_tasks, round(c, 6) AS codec_mean FROM p JOIN x USING (codec)""")
def table_means(spark, sf_dir):
    out = R.table_means(recall(spark, sf_dir), "recall_5")
    return out.select("family", "codec", F.round("mean_over_tasks", 6).alias("mean_over_tasks"),
                      F.round("codec_mean", 6).alias("codec_mean"))


@register("sweep_summary", RES + """, l AS (SELECT 'family' AS attribute, family AS level, PC FROM res UNION ALL SELECT 'codec', codec, PC FROM res)
SELECT attribute, level, count(*) AS n, round(max(PC), 6) AS best, round(avg(PC), 6) AS mean FROM l GROUP BY 1, 2""")
def sweep_summary(spark, sf_dir):
    out = R.sweep_summary(results(spark, sf_dir), "PC", ["family", "codec"])
    return out.select("attribute", "level", "n", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"))


STABLE = BEST + """, v AS (SELECT s.family, s.codec, s.score FROM s JOIN own ON s.family = own.family AND s.codec = own.codec AND s.config = own.own),
pr AS (SELECT a.family, a.codec AS codec_1, b.codec AS codec_2, a.score AS x, b.score AS y FROM v a JOIN v b ON a.family = b.family
  JOIN (VALUES ('zstd', 0), ('hq', 1), ('mq', 2), ('d20', 3)) AS o1(c, i) ON o1.c = a.codec
  JOIN (VALUES ('zstd', 0), ('hq', 1), ('mq', 2), ('d20', 3)) AS o2(c, i) ON o2.c = b.codec WHERE o1.i < o2.i),
rk AS (SELECT codec_1, codec_2, rank() OVER (PARTITION BY codec_1, codec_2 ORDER BY x) AS rx,
  rank() OVER (PARTITION BY codec_1, codec_2 ORDER BY y) AS ry FROM pr)"""


@register("rank_stability", STABLE + """ SELECT codec_1, codec_2, round(corr(rx, ry), 6) AS rho, count(*) AS n_models FROM rk GROUP BY 1, 2""")
def rank_stability(spark, sf_dir):
    chosen = R.select_best(R.score_column(results(spark, sf_dir)))
    out = R.rank_stability(chosen, "score", ["zstd", "hq", "mq", "d20"])
    return out.select("codec_1", "codec_2", F.round("rho", 6).alias("rho"), "n_models")


@register("rank_stability_per_config", RES + """, s AS (SELECT family, codec, config, PA * PC / 100 AS score FROM res),
pr AS (SELECT a.config, a.codec AS codec_1, b.codec AS codec_2, a.score AS x, b.score AS y FROM s a JOIN s b ON a.family = b.family
  AND a.config = b.config AND a.codec = 'hq' AND b.codec = 'mq'),
rk AS (SELECT config, codec_1, codec_2, rank() OVER (PARTITION BY config ORDER BY x) AS rx, rank() OVER (PARTITION BY config ORDER BY y) AS ry FROM pr)
SELECT config, codec_1, codec_2, round(corr(rx, ry), 6) AS rho, count(*) AS n_models FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def rank_stability_per_config(spark, sf_dir):
    out = R.rank_stability(R.score_column(results(spark, sf_dir)), "score", ["hq", "mq"], ["config"])
    return out.select("config", "codec_1", "codec_2", F.round("rho", 6).alias("rho"), "n_models")


@register("rank_table", BEST + """, v AS (SELECT s.family, s.codec, s.score FROM s JOIN own ON s.family = own.family AND s.codec = own.codec AND s.config = own.own),
r AS (SELECT family, codec, CAST(rank() OVER (PARTITION BY codec ORDER BY score DESC) AS DOUBLE) AS rk FROM v)
SELECT family, max(rk) FILTER (WHERE codec = 'zstd') AS zstd, max(rk) FILTER (WHERE codec = 'hq') AS hq FROM r GROUP BY family""")
def rank_table(spark, sf_dir):
    return R.rank_table(R.select_best(R.score_column(results(spark, sf_dir))), "score", ["zstd", "hq"])


@register("task_ranking", REC + """, t AS (SELECT family, task, max(recall_5) AS v FROM rec GROUP BY 1, 2),
m AS (SELECT task, max(v) AS top FROM t GROUP BY 1)
SELECT family, round(avg(v / top), 6) AS score FROM t JOIN m USING (task) GROUP BY family""")
def task_ranking(spark, sf_dir):
    best_of = recall(spark, sf_dir).groupBy("family", "task").agg(F.max("recall_5").alias("v"))
    return R.task_ranking(best_of, "v").select("family", F.round("score", 6).alias("score"))


@register("saturation_curve", """WITH s AS (SELECT l_suppkey % 5 AS model, l_linenumber AS n_actual, l_orderkey % 7 AS seed, max(l_tax * l_quantity) AS b
  FROM lineitem GROUP BY 1, 2, 3)
SELECT model, n_actual, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS std, count(*) AS n_seeds FROM s GROUP BY 1, 2""")
def saturation_curve(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("model"), F.col("l_linenumber").alias("n_actual"),
        (F.col("l_orderkey") % 7).alias("seed"), (F.col("l_tax") * F.col("l_quantity")).alias("m"))
    out = R.saturation_curve(df, "m")
    return out.select("model", "n_actual", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_seeds")


NAMES = """
  SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'std_ctrl' ELSE 'robustmad_all' END || '__outlier' || l_partkey
    || CASE WHEN l_suppkey % 3 = 0 THEN '__INT' ELSE '' END || '__prune0.' || (1 + l_suppkey % 9)
    || CASE WHEN l_suppkey % 4 = 0 THEN '__pca' || l_suppkey ELSE '' END
    || CASE WHEN l_linenumber = 1 THEN '__tvn_efaar_e0.5' WHEN l_linenumber = 2 THEN '__tvn_efaar_e1.5_c' || l_suppkey
            WHEN l_linenumber = 3 THEN '__cascade_tvn_k' || l_suppkey || '_k8' WHEN l_linenumber = 4 THEN '__tvn_original_k' || l_suppkey
            WHEN l_linenumber = 5 THEN '__ZCA-cor_all_e0.5' WHEN l_linenumber = 6 THEN '__ZCA-cor_global_ctrl_e4' ELSE '' END AS config,
    l_linenumber AS ln, l_suppkey AS sk, l_partkey AS pk
  FROM {lineitem}"""


@register("config_settings", with_clause(n=NAMES) + """ SELECT id, CASE WHEN ln % 2 = 0 THEN 'standardize' ELSE 'robustmad' END AS norm_method,
  CAST(pk AS INTEGER) AS outlier_cutoff, sk % 3 = 0 AS use_int, round((1 + sk % 9) / 10.0, 6)::DOUBLE AS prune_thresh, sk % 4 = 0 AS use_pca,
  CASE WHEN sk % 4 = 0 THEN CAST(sk AS INTEGER) END AS pca_components,
  CASE ln WHEN 1 THEN 'tvn_efaar' WHEN 2 THEN 'tvn_efaar' WHEN 3 THEN 'cascade_tvn' WHEN 4 THEN 'tvn_original' WHEN 5 THEN 'spherize'
          WHEN 6 THEN 'spherize_global' ELSE 'none' END AS batch_method,
  CASE ln WHEN 5 THEN 'all' WHEN 6 THEN 'ctrl' END AS spherize_fit, CASE ln WHEN 5 THEN 0.5e0 WHEN 6 THEN 1e-4 END AS spherize_epsilon,
  CASE ln WHEN 1 THEN 0.5e0 WHEN 2 THEN 1.5e0 END AS tvn_epsilon, CASE ln WHEN 1 THEN 128 WHEN 2 THEN CAST(sk AS INTEGER) END AS tvn_efaar_n_components,
  CASE ln WHEN 4 THEN CAST(sk AS INTEGER) END AS tvn_original_k, CASE ln WHEN 3 THEN CAST(sk AS INTEGER) END AS tvn_cascade_k1,
  CASE ln WHEN 3 THEN 8 END AS tvn_cascade_k2 FROM n""")
def config_settings(spark, sf_dir):
    df = derive(spark, sf_dir, NAMES)
    return df.select("id", *[v.alias(k) for k, v in R.config_settings("config").items()])


@register("without_degenerate", with_clause(n=NAMES) + " SELECT id, ln FROM n WHERE NOT (ln IN (5, 6) AND sk % 4 <> 0)")
def without_degenerate(spark, sf_dir):
    return R.without_degenerate(derive(spark, sf_dir, NAMES)).select("id", "ln")


MODELS = """
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'dinov2_490' WHEN o_custkey % 5 = 1 THEN 'dinov2'
      WHEN o_custkey % 5 = 2 THEN 'subcell_lite' WHEN o_custkey % 5 = 3 THEN 'Cell_count' ELSE 'other' END
    || '_x' || (o_custkey % 3) || CASE WHEN o_orderkey % 3 = 0 THEN '_jpegxl_lossy_hq_raw' WHEN o_orderkey % 3 = 1 THEN '_zstd_raw'
      ELSE '' END AS model, o_custkey AS ck, o_orderkey AS ok FROM {orders}"""


@register("model_family", with_clause(m=MODELS) + """ SELECT id, model, CASE ck % 5 WHEN 0 THEN 'dinov2_490' WHEN 1 THEN 'dinov2' WHEN 2 THEN 'subcell_lite'
  WHEN 3 THEN 'cell_count' END AS family, CASE ok % 3 WHEN 0 THEN 'hq' WHEN 1 THEN 'zstd' ELSE 'raw' END AS codec FROM m""")
def model_family(spark, sf_dir):
    df = R.with_family(derive(spark, sf_dir, MODELS), R.family_table(spark))
    return df.select("id", "model", "family", R.codec_of("model").alias("codec"))


@register("filter_results", RES + " SELECT family, codec, config FROM res WHERE family IN ('f1', 'f2') AND codec NOT IN ('d20')")
def filter_results(spark, sf_dir):
    return R.filter_results(results(spark, sf_dir), ["f1", "f2"], None, ["d20"]).select("family", "codec", "config")


@register("codec_order", RES + """, o AS (SELECT * FROM (VALUES ('zstd', 0), ('raw', 1), ('hq', 2), ('mq', 3), ('d20', 4)) AS t(codec, r))
SELECT codec, count(*) AS n, any_value(r) AS quality FROM res LEFT JOIN o USING (codec) GROUP BY codec""")
def codec_order(spark, sf_dir):
    counts = results(spark, sf_dir).groupBy("codec").agg(F.count(F.lit(1)).alias("n"))
    return R.sort_by_quality(counts).withColumn("quality", R.quality_rank("codec"))


@register("full_merge", """SELECT coalesce(n, s_nationkey) AS nation, a, b FROM (SELECT c_nationkey AS n, count(*) AS a FROM customer GROUP BY 1)
FULL JOIN (SELECT s_nationkey, count(*) AS b FROM supplier GROUP BY 1) ON n = s_nationkey""")
def full_merge(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("a"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("b"))
    return R.full_merge(a, b, ["nation"])


@register("replace_columns", """SELECT o_orderkey, x.q AS o_totalprice FROM orders LEFT JOIN (
  SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey""")
def replace_columns(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("o_totalprice"))
    return R.replace_columns(left, right, ["o_orderkey"])
