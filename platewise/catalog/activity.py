"""Phenotypic activity: the flagship question."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.catalog.inputs import STANDARD, normalized_sql, precision_sql, profiles
from platewise.catalog.registry import register
from platewise.operators.normalize import standardize
from platewise.operators.retrieval import (
    activity_summary, mean_average_precision, phenotypic_activity, with_significance,
)
from platewise.session import cut_lineage

PAIRS = """
  SELECT q.row_id, q.pert, q.grp, 1 AS is_pos, round(list_dot_product(q.u, r.u), 10) AS sim
  FROM unit q JOIN unit r ON q.pert = r.pert AND q.grp = r.grp AND q.row_id <> r.row_id
  WHERE NOT q.negcon AND NOT r.negcon
  UNION ALL
  SELECT q.row_id, q.pert, q.grp, 0, round(list_dot_product(q.u, r.u), 10)
  FROM unit q JOIN unit r ON q.plate = r.plate AND q.grp = r.grp AND q.pert <> r.pert
  WHERE NOT q.negcon AND r.negcon"""

ACTIVITY = f"WITH {STANDARD}, {precision_sql(PAIRS, 'row_id, pert, grp')}"
NAP = normalized_sql("ap", "n_pos", "(n_pos + n_neg)")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenotypic_activity(cut_lineage(standardize(profiles(spark, sf_dir))))


@register("activity_ap", f"""{ACTIVITY}
SELECT CAST(row_id AS VARCHAR) AS id, pert, grp, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
       round(ap, 6) AS ap, round({NAP}, 6) AS nap FROM ap""")
def activity_ap(spark, sf_dir):
    return activity(spark, sf_dir).select(
        "id", F.col(C.PERT).alias("pert"), F.col(C.GROUP).alias("grp"), "n_pos", "n_neg",
        F.round("average_precision", 6).alias("ap"), F.round("normalized_average_precision", 6).alias("nap"))


@register("activity_map", f"""{ACTIVITY}
SELECT pert, grp, round(avg(ap), 6) AS map, round(avg({NAP}), 6) AS mean_nap, count(*) AS n_replicates
FROM ap WHERE ap IS NOT NULL GROUP BY pert, grp""")
def activity_map(spark, sf_dir):
    maps = mean_average_precision(activity(spark, sf_dir), [C.PERT, C.GROUP])
    return maps.select(
        F.col(C.PERT).alias("pert"), F.col(C.GROUP).alias("grp"),
        F.round("mean_average_precision", 6).alias("map"),
        F.round("mean_normalized_average_precision", 6).alias("mean_nap"), "n_replicates")


@register("activity_group_nap", f"""{ACTIVITY}, maps AS (
  SELECT pert, grp, avg({NAP}) AS nap FROM ap WHERE ap IS NOT NULL GROUP BY pert, grp)
SELECT grp, round(avg(nap), 6) AS mean_nap, round(median(nap), 6) AS median_nap,
       round(avg(greatest(nap, 0)), 6) AS mean_nap_clipped, count(DISTINCT pert) AS n_units
FROM maps GROUP BY grp""")
def activity_group_nap(spark, sf_dir):
    maps = mean_average_precision(activity(spark, sf_dir), [C.PERT, C.GROUP])
    out = activity_summary(maps.withColumn("below_corrected_p", F.lit(True)), [C.GROUP], C.PERT)
    return out.select(F.col(C.GROUP).alias("grp"), *[F.round(c, 6).alias(c) for c in (
        "mean_nap", "median_nap", "mean_nap_clipped")], "n_units")


@register("activity_summary")
def activity_share(spark, sf_dir):
    """Share of significant perturbations per group; the null draws are seeded, not SQL."""
    ap = cut_lineage(activity(spark, sf_dir))
    by = [C.PERT, C.GROUP]
    maps = with_significance(mean_average_precision(ap, by), ap, by, null_size=10_000)
    return activity_summary(maps, [C.GROUP], C.PERT)
