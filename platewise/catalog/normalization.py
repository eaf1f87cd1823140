"""Normalisation and batch correction over the embedding profiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.catalog.inputs import PROFILES, STANDARD, profiles
from platewise.catalog.registry import register
from platewise.functions.expressions import PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW
from platewise.operators import normalize
from platewise.operators.moments import global_moments
from platewise.operators.packed import Profiles, to_long
from platewise.plans.steps import run_steps
from platewise.session import cut_lineage


def cells(df: DataFrame, digits: int = 6) -> DataFrame:
    return to_long(df, [C.ROW_ID]).select(
        C.ROW_ID, F.col("pos").cast("bigint").alias("pos"), F.round("value", digits).alias("value"))


@register("standardize_controls", f"""WITH {STANDARD}
SELECT row_id, i AS pos, round(features[i + 1], 6) AS value
FROM z, UNNEST(range(len(features))) AS t(i)""")
def standardize_controls(spark, sf_dir):
    return cells(normalize.standardize(profiles(spark, sf_dir)))


@register("standardize_global", f"""WITH {PROFILES}, model AS (
  SELECT pos, avg(value) AS center, stddev_pop(value) AS scale FROM cells GROUP BY pos)
SELECT row_id, pos, round((value - center) / (scale + 1e-18), 6) AS value FROM cells JOIN model USING (pos)""")
def standardize_global(spark, sf_dir):
    return cells(normalize.standardize(profiles(spark, sf_dir), None, None))


MAD = """, mid AS (SELECT {keys} pos, median(value) AS center FROM cells {where} GROUP BY {keys} pos),
apart AS (SELECT {keys} pos, center, abs(value - center) AS d FROM cells JOIN mid USING ({keys} pos) {where}),
model AS (SELECT {keys} pos, center, median(d) AS scale FROM apart GROUP BY {keys} pos, center)
SELECT row_id, pos, round((value - center) / (scale + 1e-18), 6) AS value FROM cells JOIN model USING ({keys} pos)"""


@register("robust_mad", f"WITH {PROFILES}" + MAD.format(keys="plate,", where="WHERE negcon"))
def robust_mad(spark, sf_dir):
    return cells(normalize.robust_mad(profiles(spark, sf_dir)))


@register("robust_mad_global", f"WITH {PROFILES}" + MAD.format(keys="", where=""))
def robust_mad_global(spark, sf_dir):
    return cells(normalize.robust_mad(profiles(spark, sf_dir), None, None))


@register("well_position", f"""WITH {PROFILES}
SELECT row_id, pos, round(value - avg(value) OVER (PARTITION BY well, pos), 6) AS value FROM cells""")
def well_position(spark, sf_dir):
    return cells(normalize.well_position_correct(profiles(spark, sf_dir)))


def horner_sql(coefficients: list[float], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


QUANTILE = f"""CASE
  WHEN p < {PPF_LOW} THEN {horner_sql(PPF_C, 'lo')} / {horner_sql(PPF_D, 'lo')}
  WHEN p <= {1 - PPF_LOW} THEN {horner_sql(PPF_A, 'r')} * q / {horner_sql(PPF_B, 'r')}
  ELSE -({horner_sql(PPF_C, 'hi')}) / {horner_sql(PPF_D, 'hi')} END"""


@register("inverse_normal", f"""WITH {PROFILES}, placed AS (
  SELECT row_id, pos, (row_number() OVER (PARTITION BY pos ORDER BY value, row_id) - 0.375e0)
         / ((SELECT count(*) FROM profiles) + 0.25e0) AS p FROM cells
), terms AS (
  SELECT row_id, pos, p, p - 0.5e0 AS q, (p - 0.5e0) * (p - 0.5e0) AS r,
         sqrt(-2e0 * ln(p)) AS lo, sqrt(-2e0 * ln(1e0 - p)) AS hi FROM placed)
SELECT row_id, pos, round({QUANTILE}, 6) AS value FROM terms""")
def inverse_normal(spark, sf_dir):
    return cells(normalize.inverse_normal(profiles(spark, sf_dir)))


NORMS = {"l1": "sum(abs(value))", "l2": "sqrt(sum(value * value))", "max": "max(abs(value))"}


def register_norm(norm: str, expression: str) -> None:
    @register(f"row_norm_{norm}", f"""WITH {PROFILES}, size AS (SELECT row_id, {expression} AS s FROM cells GROUP BY row_id)
    SELECT row_id, pos, round(value / (s + 1e-10), 6) AS value FROM cells JOIN size USING (row_id)""")
    def run(spark, sf_dir):
        return cells(normalize.sample_normalize(profiles(spark, sf_dir), norm))


for _norm, _expression in NORMS.items():
    register_norm(_norm, _expression)


def covariance_cells(df: DataFrame, digits: int) -> DataFrame:
    """Sample covariance of a packed table as ``(i, j, value)`` cells."""
    cov = global_moments(df).cov()
    rows = [(i, j, float(round(v, digits)) + 0.0) for i, row in enumerate(cov.tolist()) for j, v in enumerate(row)]
    return df.sparkSession.createDataFrame(rows, "i bigint, j bigint, value double")


IDENTITY = """WITH d AS (SELECT DISTINCT UNNEST(range(len(embedding))) AS i FROM embeddings)
SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1.0e0 ELSE 0.0e0 END AS value FROM d a, d b"""


@register("spherize_covariance", IDENTITY)
def spherize_covariance(spark, sf_dir):
    """After whitening on all rows the covariance is the identity."""
    df = normalize.spherize(profiles(spark, sf_dir), None, None, "ZCA-cor", epsilon=1e-9)
    return covariance_cells(cut_lineage(df), 5)


@register("spherize_pca_covariance", IDENTITY)
def spherize_pca_covariance(spark, sf_dir):
    df = normalize.spherize(profiles(spark, sf_dir), None, None, "PCA", epsilon=1e-9)
    return covariance_cells(cut_lineage(df), 5)


@register("pca_total_variance", f"""WITH {PROFILES}, v AS (SELECT pos, var_samp(value) AS v FROM cells GROUP BY pos)
SELECT round(sum(v), 6) AS total_variance FROM v""")
def pca_total_variance(spark, sf_dir):
    """Rotating onto nearly all components keeps the total variance but for the last one."""
    df = profiles(spark, sf_dir)
    out, names = normalize.pca(df, n_components=63, control=None)
    kept = global_moments(cut_lineage(out))
    full = global_moments(df)
    import numpy as np

    last = float(np.linalg.eigvalsh(full.cov())[0])
    total = float(np.trace(kept.cov())) + last
    return spark.createDataFrame([(round(total, 6),)], "total_variance double")


@register("tvn_control_means", f"""WITH {PROFILES} SELECT plate, pos, 0.0e0 AS value FROM cells WHERE negcon GROUP BY plate, pos""")
def tvn_control_means(spark, sf_dir):
    """The controls of every corrected plate are centred."""
    out = normalize.tvn(profiles(spark, sf_dir)).filter(C.NEGCON)
    means = to_long(out, [C.PLATE]).groupBy(F.col(C.PLATE).alias("plate"), F.col("pos").cast("bigint").alias("pos"))
    return means.agg(F.abs(F.round(F.avg("value"), 6)).alias("value"))


@register("leading_variance")
def leading_variance(spark, sf_dir):
    ok, share = normalize.leading_variance_gate(profiles(spark, sf_dir))
    return spark.createDataFrame([(ok, share)], "ok boolean, share double")


@register("tvn")
def tvn(spark, sf_dir):
    return cells(normalize.tvn(profiles(spark, sf_dir)))


@register("tvn_efaar")
def tvn_efaar(spark, sf_dir):
    return cells(normalize.tvn_efaar(profiles(spark, sf_dir), n_components=16)[0])


@register("tvn_original")
def tvn_original(spark, sf_dir):
    return cells(normalize.tvn_original(profiles(spark, sf_dir), k=16)[0])


@register("tvn_cascade")
def tvn_cascade(spark, sf_dir):
    return cells(normalize.tvn_cascade(profiles(spark, sf_dir), k1=32, k2=8)[0])


@register("spherize_per_plate")
def spherize_per_plate(spark, sf_dir):
    return cells(normalize.spherize(profiles(spark, sf_dir), C.PLATE, None, "ZCA-cor"))


@register("spherize_truncated")
def spherize_truncated(spark, sf_dir):
    return cells(normalize.spherize(profiles(spark, sf_dir), None, None, remove_variance_method="mp"))


@register("step_pipeline", f"""WITH {STANDARD.replace("WITH ", "")}, away AS (SELECT row_id, well, i AS pos, features[i + 1] AS value FROM z, UNNEST(range(len(features))) AS t(i)),
c AS (SELECT row_id, pos, value - avg(value) OVER (PARTITION BY well, pos) AS value FROM away),
n AS (SELECT row_id, sqrt(sum(value * value)) AS s FROM c GROUP BY row_id)
SELECT c.row_id, pos, round(value / (s + 1e-10), 6) AS value FROM c JOIN n ON n.row_id = c.row_id""")
def step_pipeline(spark, sf_dir):
    """Standardised by controls, centred by well position, rows of unit length, with the gates of every step."""
    df = profiles(spark, sf_dir)
    width = df.select(F.size(C.FEATURES)).first()[0]
    steps = [{"name": "normalize_standardize"}, {"name": "well_position_correct"}, {"name": "sample_norm"}]
    out, _ = run_steps(Profiles(df, [f"f{i}" for i in range(width)]), steps)
    return cells(out.df)
