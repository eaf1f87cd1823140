"""Domain tables derived from the given ones, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.catalog.registry import table


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as packed profiles: label 0 is the control, eight plates, two groups."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias(C.ROW_ID),
        F.concat(F.lit("P"), F.col("label")).alias(C.PERT),
        F.concat(F.lit("plate"), F.col("vec_id") % 8).alias(C.PLATE),
        F.concat(F.lit("W"), F.floor(F.col("vec_id") / 8) % 12).alias(C.WELL),
        F.concat(F.lit("group"), F.col("vec_id") % 2).alias(C.GROUP),
        (F.col("label") == 0).alias(C.NEGCON),
        F.col("embedding").cast("array<double>").alias(C.FEATURES),
    )


PROFILES = """
profiles AS (
  SELECT vec_id AS row_id, 'P' || label AS pert, 'plate' || (vec_id % 8) AS plate,
         'W' || (CAST(floor(vec_id / 8) AS BIGINT) % 12) AS well, 'group' || (vec_id % 2) AS grp, label = 0 AS negcon,
         CAST(embedding AS DOUBLE[]) AS features
  FROM embeddings
), cells AS (
  SELECT row_id, pert, plate, well, grp, negcon, i AS pos, features[i + 1] AS value
  FROM profiles, UNNEST(range(len(features))) AS t(i)
)"""

# Standardised profiles ``z``: per plate on controls, population deviation.
STANDARD = PROFILES + """, model AS (
  SELECT plate, pos, avg(value) AS center, stddev_pop(value) AS scale
  FROM cells WHERE negcon GROUP BY plate, pos
), z AS (
  SELECT c.row_id, c.pert, c.plate, c.well, c.grp, c.negcon,
         list((c.value - m.center) / (m.scale + 1e-18) ORDER BY c.pos) AS features
  FROM cells c JOIN model m ON c.plate = m.plate AND c.pos = m.pos
  GROUP BY ALL
), unit AS (
  SELECT * EXCLUDE (features, n), list_transform(features, lambda x: x / n) AS u
  FROM (SELECT *, CASE WHEN list_dot_product(features, features) = 0 THEN 1.0
                       ELSE sqrt(list_dot_product(features, features)) END AS n FROM z)
)"""

HARMONIC = "list_sum(list_transform(range(1, CAST({n} AS BIGINT) + 1), lambda x: 1.0 / x))"


def normalized_sql(ap: str, pos: str, total: str) -> str:
    """Normalised average precision as SQL text."""
    h = f"({HARMONIC.format(n=total)} / {total})"
    e = f"({h} + ({pos} - 1.0) / ({total} - 1.0) * (1 - {h}))"
    return f"CASE WHEN {e} < 1 THEN ({ap} - {e}) / (1 - {e}) END"


def precision_sql(pairs: str, keys: str) -> str:
    """AP per query from a relation of (keys..., is_pos, sim); ties put positives first."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sim DESC, is_pos DESC) AS place,
         sum(is_pos) OVER (PARTITION BY {keys} ORDER BY sim DESC, is_pos DESC
                           ROWS UNBOUNDED PRECEDING) AS hits
  FROM ({pairs})
), ap AS (
  SELECT {keys}, sum(is_pos) AS n_pos, count(*) - sum(is_pos) AS n_neg,
         avg(CASE WHEN is_pos = 1 THEN hits * 1.0 / place END) AS ap
  FROM ranked GROUP BY {keys} HAVING sum(is_pos) > 0 AND count(*) > sum(is_pos)
)"""


# ---- portable selects: the same text runs on Spark and as SQL --------------------------

# One row per measurement of an object in a site file.
LONG = """
  SELECT 'source_' || (l_suppkey % 3) || '__B' || (l_suppkey % 2) || '__P' || (l_suppkey % 4)
           || '__W' || (l_partkey % 24) || '__' || l_linenumber AS site,
         l_partkey % 50 AS label,
         CASE WHEN l_returnflag = 'A' THEN 'cell' ELSE 'nuclei' END AS object,
         CASE WHEN l_linestatus = 'O' THEN '0/max/' ELSE '1/max/' END AS branch,
         CASE WHEN l_linenumber % 4 = 0 THEN 'Area' WHEN l_linenumber % 4 = 1 THEN 'Perimeter'
              WHEN l_linenumber % 4 = 2 THEN 'Intensity' ELSE 'Texture' END AS metric,
         l_quantity AS value, l_orderkey AS obs
  FROM {lineitem}"""

# Wide features with NULL, NaN, infinite, constant and duplicated columns.
WIDE = """
  SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey % 8 AS plate, l_quantity AS f_quantity,
         l_extendedprice AS f_price, l_discount AS f_discount,
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_tax END AS f_sparse,
         CASE WHEN l_orderkey % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END AS f_nan,
         CASE WHEN l_orderkey % 100 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END AS f_inf,
         CAST(3 AS DOUBLE) AS f_constant,
         CASE WHEN l_orderkey % 1000 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_rare,
         l_quantity * 2 + 1 AS f_copy,
         CASE WHEN l_orderkey = 7 THEN CAST(1e9 AS DOUBLE) ELSE l_discount END AS Location_Center_X
  FROM {lineitem}"""

# Registry wells, plates and perturbations.
WELL = """
  SELECT DISTINCT 'source_' || (o_custkey % 10) AS Metadata_Source, 'P' || (o_custkey % 40) AS Metadata_Plate,
         'W' || (o_orderkey % 120) AS Metadata_Well,
         CASE WHEN o_orderkey % 17 = 0 THEN 'JCP2022_033924' WHEN o_orderkey % 19 = 0 THEN 'JCP2022_800001'
              ELSE 'C' || ((o_custkey % 40) * 7 + o_orderkey % 9) END AS Metadata_JCP2022
  FROM {orders}"""

PLATE = """
  SELECT DISTINCT 'source_' || (c_custkey % 10) AS Metadata_Source, 'B' || (c_custkey % 4) AS Metadata_Batch,
         'P' || (c_custkey % 40) AS Metadata_Plate,
         CASE WHEN c_custkey % 40 = 3 THEN 'JUNK_target2_x' ELSE 'COMPOUND' END AS Metadata_PlateType
  FROM {customer}"""

COMPOUND = """
  SELECT 'C' || p_partkey AS Metadata_JCP2022, CASE WHEN p_partkey % 11 = 0 THEN NULL
         ELSE 'K' || CAST(floor(p_partkey / 3) AS BIGINT) || '-S' || (p_partkey % 5) || '-N' END AS Metadata_InChIKey,
         'I' || p_partkey AS Metadata_InChI
  FROM {part} WHERE p_partkey % 2 = 0"""

CRISPR = """
  SELECT 'C' || p_partkey AS Metadata_JCP2022, 'G' || (p_partkey % 90) AS Metadata_Symbol
  FROM {part} WHERE p_partkey % 6 = 1"""

ORF = """
  SELECT 'C' || p_partkey AS Metadata_JCP2022, 'G' || (p_partkey % 120) AS Metadata_Symbol
  FROM {part} WHERE p_partkey % 6 = 3"""

# Perturbation metadata with targets: parts are compounds and genes.
PERTURBATIONS = """
  SELECT 'C' || p_partkey AS Metadata_JCP2022,
         CASE WHEN p_partkey % 3 = 0 THEN 'orf' WHEN p_partkey % 3 = 1 THEN 'crispr' ELSE 'compound' END
           AS Metadata_Perturbation_Type,
         CASE WHEN p_partkey % 3 < 2 AND p_partkey % 13 > 0 THEN 'G' || CAST(floor(p_partkey / 3) AS BIGINT) END
           AS Metadata_Symbol,
         CASE WHEN p_partkey % 3 < 2 THEN NULL WHEN p_partkey % 5 = 0 THEN 'unknown'
              ELSE 'G' || CAST(floor(p_partkey / 6) AS BIGINT) || '|G' || p_size END AS Metadata_graph_target
  FROM {part}"""

# Curated compound-gene evidence and gene pairs.
CURATED = """
  SELECT 'G' || CAST(floor((l_partkey + l_linenumber * 2) / 9) AS BIGINT) AS target,
         CASE WHEN l_linenumber = 1 THEN 'inhibitor' WHEN l_linenumber = 2 THEN 'agonist'
              WHEN l_linenumber = 3 THEN 'binds' WHEN l_linenumber = 4 THEN 'enzyme' ELSE 'associates' END AS rel_type,
         'K' || l_partkey || '-X' || l_linenumber AS inchikey
  FROM {lineitem}"""

STRUCTURES = """
  SELECT DISTINCT 'K' || p_partkey AS InChIKey_Connectivity, 'C' || p_partkey AS Metadata_JCP2022
  FROM {part} WHERE p_partkey % 3 = 2"""

GENE_PAIRS = """
  SELECT 'G' || l_suppkey AS target_a,
         CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE 'G' || CAST(floor(l_partkey / 3) AS BIGINT) END AS target_b,
         CASE WHEN l_linenumber % 2 = 0 THEN 'ppi' ELSE 'covaries' END AS rel_type
  FROM {lineitem}"""

PAIRS = """
  SELECT 'K' || l_partkey || '-A' AS inchikey_a, 'K' || l_suppkey || '-B' AS inchikey_b
  FROM {lineitem}"""

EVIDENCE = """
  SELECT 'C' || l_orderkey AS Metadata_JCP2022,
         CASE WHEN l_linenumber = 1 THEN 'G' || l_orderkey ELSE 'G' || (l_partkey % 1000) END AS target,
         CASE WHEN l_returnflag = 'R' THEN 'protein' ELSE 'gene' END AS target_type,
         CASE WHEN l_orderkey % 3 = 0 THEN 'Positive' WHEN l_orderkey % 3 = 1 THEN 'Negative' ELSE 'unspecified' END AS mode,
         CAST(l_quantity AS INT) % 9 AS support
  FROM {lineitem}"""

# Sweep results: family, codec, config with two scores.
RESULTS = """
  SELECT 'f' || (l_suppkey % 6) AS family,
         CASE WHEN l_linenumber % 4 = 0 THEN 'zstd' WHEN l_linenumber % 4 = 1 THEN 'hq'
              WHEN l_linenumber % 4 = 2 THEN 'mq' ELSE 'd20' END AS codec,
         CASE WHEN l_suppkey % 6 = 2 AND l_linenumber % 4 = 1 THEN 'own' || (l_partkey % 5)
              ELSE 'cfg' || (l_partkey % 25) END AS config,
         avg(l_quantity) AS PA, avg(l_tax) * 1000 AS PC,
         avg(l_quantity) / 50 - 0.4 AS PA_mean_nap, avg(l_tax) * 10 AS PC_mean_nap
  FROM {lineitem} GROUP BY 1, 2, 3"""

# Recall rows with NULL modality and group as meaningful values.
RECALL = """
  SELECT 'f' || (l_suppkey % 6) AS family,
         CASE WHEN l_linenumber % 4 = 0 THEN 'raw' WHEN l_linenumber % 4 = 1 THEN 'hq'
              WHEN l_linenumber % 4 = 2 THEN 'mq' ELSE 'd20' END AS codec,
         'cfg' || (l_partkey % 9) AS config,
         CASE WHEN l_orderkey % 3 = 0 THEN 'CC' WHEN l_orderkey % 3 = 1 THEN 'GG' ELSE 'CG' END AS task,
         CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 2 = 0 THEN 'orf' ELSE 'crispr' END AS modality,
         CASE WHEN l_orderkey % 3 = 1 THEN NULL WHEN l_orderkey % 5 < 2 THEN 'group_high' ELSE 'group_low' END
           AS grp_,
         avg(l_discount) AS recall_5
  FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, 6"""

# Pixel rows of two label masks, one image per (source_id, file, method).
PIXELS = """
  SELECT 's' || (l_suppkey % 20) AS source_id, 'f' || (l_suppkey % 5) AS file, 'm' || (l_linenumber % 2) AS method,
         CAST(l_orderkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x,
         CASE WHEN l_partkey % 64 < 8 THEN CAST(0 AS BIGINT)
              ELSE CAST(1 + floor((l_orderkey % 64) / 22) + 3 * floor((l_partkey % 64) / 22) AS BIGINT) END AS gt_label,
         CASE WHEN l_partkey % 64 < 12 THEN CAST(0 AS BIGINT)
              ELSE CAST(1 + floor((l_orderkey % 64 + l_suppkey % 9) / 25) + 3 * floor((l_partkey % 64 + 3) / 24)
                        AS BIGINT) END AS pred_label,
         l_quantity * 1000 AS original, l_quantity * 1000 + l_tax * 5000 AS variant
  FROM {lineitem}"""

# Long paired measurements of a reference and several variants, with defects.
PAIRED = """
  SELECT 'c' || (l_linenumber % 3) AS codec, 'F' || (l_suppkey % 12) AS feature, 'site' || (l_orderkey % 40) AS site,
         CASE WHEN l_orderkey % 31 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_suppkey % 12 = 5 THEN CAST(1 AS DOUBLE)
              ELSE l_quantity END AS value_ref,
         CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE l_quantity * 2 + l_discount * 100 * (1 + l_linenumber % 3) END
           AS value_codec
  FROM {lineitem}"""
