"""Corrected profiles cell by cell, on two folded features, where powers and eigenvectors have closed forms in SQL."""

from pyspark.sql import functions as F

from platewise import columns as C
from platewise.catalog.inputs import profiles
from platewise.catalog.normalization import cells
from platewise.catalog.registry import register
from platewise.operators import normalize
from platewise.session import cut_lineage

# Two features of each embedding: the sums of its halves, the second with half of the first added.
FOLDED = """
f AS (SELECT vec_id AS row_id, 'plate' || (vec_id % 8) AS plate, label = 0 AS negcon,
    list_sum(v[1:len(v) // 2]) AS x, list_sum(v[len(v) // 2 + 1:]) + 0.5e0 * list_sum(v[1:len(v) // 2]) AS y
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""


def folded(spark, sf_dir):
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v)
    half = F.floor(F.size(C.FEATURES) / 2).cast("int")
    first, second = total(F.slice(C.FEATURES, F.lit(1), half)), total(F.slice(C.FEATURES, half + 1, F.size(C.FEATURES)))
    return cut_lineage(profiles(spark, sf_dir).withColumn(C.FEATURES, F.array(first, second + 0.5 * first)))


def root_sql(name: str, source: str) -> str:
    """CTE ``name``: ``source`` with the square root (p, q, r) and its inverse (ip, iq, ir) of the matrices (a, b, c)."""
    return f"""
{name} AS (SELECT *, (a + s) / t AS p, b / t AS q, (c + s) / t AS r, (c + s) / (t * s) AS ip, -b / (t * s) AS iq, (a + s) / (t * s) AS ir
  FROM (SELECT *, sqrt(a + c + 2 * s) AS t FROM (SELECT *, sqrt(a * c - b * b) AS s FROM {source})))"""


def axes_sql(name: str, source: str) -> str:
    """CTE ``name``: ``source`` with eigenvalues (l1, l2) and vectors (v1x, v1y), (v2x, v2y) of (a, b, c), larger entry positive."""
    return f"""
{name} AS (SELECT * EXCLUDE (ux, uy, h), ux / h AS v1x, uy / h AS v1y,
    CASE WHEN abs(uy) >= abs(ux) THEN uy / h ELSE -uy / h END * sign(CASE WHEN abs(uy) >= abs(ux) THEN uy ELSE 1 END) AS v2x,
    CASE WHEN abs(uy) >= abs(ux) THEN -ux / h ELSE ux / h END * sign(CASE WHEN abs(uy) >= abs(ux) THEN uy ELSE 1 END) AS v2y
  FROM (SELECT *, sqrt(ux * ux + uy * uy) AS h FROM (
    SELECT * EXCLUDE (wx, wy), wx * g AS ux, wy * g AS uy FROM (
      SELECT *, sign(CASE WHEN abs(wx) >= abs(wy) THEN wx ELSE wy END) AS g FROM (
        SELECT *, b AS wx, l1 - a AS wy FROM (
          SELECT *, (a + c) / 2 + e AS l1, (a + c) / 2 - e AS l2 FROM (
            SELECT *, sqrt((a - c) * (a - c) / 4 + b * b) AS e FROM {source})))))))"""


def both(u: str, v: str, tail: str) -> str:
    """Cells of two output features."""
    return f"""SELECT row_id, CAST(0 AS BIGINT) AS pos, round({u}, 6) AS value {tail}
UNION ALL SELECT row_id, CAST(1 AS BIGINT), round({v}, 6) {tail}"""


MOMENTS = "count(*) AS n, avg({x}) AS mx, avg({y}) AS my, var_samp({x}) AS a, covar_samp({x}, {y}) AS b, var_samp({y}) AS c"
OWN = MOMENTS.format(x="x", y="y")


@register("tvn_folded", f"""WITH {FOLDED}, k AS (SELECT plate, {OWN} FROM f WHERE negcon GROUP BY plate HAVING count(*) > 1),
m AS (SELECT plate, mx, my, a + 1 AS a, b, c + 1 AS c FROM k), {root_sql("w", "m")},
o AS (SELECT f.*, w.mx, w.my, w.ip, w.iq, w.ir FROM f LEFT JOIN w ON w.plate = f.plate)
{both("coalesce((x - mx) * ip + (y - my) * iq, x)", "coalesce((x - mx) * iq + (y - my) * ir, y)", "FROM o")}""")
def tvn_folded(spark, sf_dir):
    return cells(normalize.tvn(folded(spark, sf_dir)))


@register("tvn_efaar_folded", f"""WITH {FOLDED},
g AS (SELECT avg(x) AS gx, avg(y) AS gy, stddev_pop(x) AS sx, stddev_pop(y) AS sy, CASE WHEN corr(x, y) >= 0 THEN 1 ELSE -1 END AS w
  FROM f WHERE negcon),
z AS (SELECT row_id, plate, negcon, (x - gx) / sx AS zx, w * (y - gy) / sy AS zy FROM f, g),
pc AS (SELECT row_id, plate, negcon, (zx + zy) / sqrt(2) AS x, (zx - zy) / sqrt(2) AS y FROM z),
k AS (SELECT plate, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM pc WHERE negcon GROUP BY plate HAVING count(*) > 1),
s AS (SELECT pc.*, k.plate IS NOT NULL AS fitted, (x - coalesce(mx, 0)) / coalesce(sx, 1) AS u, (y - coalesce(my, 0)) / coalesce(sy, 1) AS v
  FROM pc LEFT JOIN k ON k.plate = pc.plate),
tm AS (SELECT var_samp(u) + 0.5e0 AS a, covar_samp(u, v) AS b, var_samp(v) + 0.5e0 AS c FROM s WHERE negcon), {root_sql("t", "tm")},
sm AS (SELECT plate, var_samp(u) + 0.5e0 AS a, covar_samp(u, v) AS b, var_samp(v) + 0.5e0 AS c FROM s WHERE negcon AND fitted GROUP BY plate),
{root_sql("i", "sm")},
o AS (SELECT s.*, u * ip + v * iq AS hx, u * iq + v * ir AS hy, (SELECT p FROM t) AS tp, (SELECT q FROM t) AS tq, (SELECT r FROM t) AS tr
  FROM s LEFT JOIN i ON i.plate = s.plate)
{both("CASE WHEN fitted THEN hx * tp + hy * tq ELSE x END", "CASE WHEN fitted THEN hx * tq + hy * tr ELSE y END", "FROM o")}""")
def tvn_efaar_folded(spark, sf_dir):
    return cells(normalize.tvn_efaar(folded(spark, sf_dir), n_components=16)[0])


ENOUGH = """
e AS (SELECT f.* FROM f JOIN (SELECT plate FROM f WHERE negcon GROUP BY plate HAVING count(*) > 1) h ON h.plate = f.plate WHERE negcon)"""


@register("tvn_original_folded", f"""WITH {FOLDED}, {ENOUGH}, gm AS (SELECT {OWN} FROM e), {axes_sql("g", "gm")},
y AS (SELECT f.row_id, f.plate, f.negcon, ((f.x - mx) * v1x + (f.y - my) * v1y) / sqrt(l1) AS x,
    ((f.x - mx) * v2x + (f.y - my) * v2y) / sqrt(l2) AS y FROM f, g),
k AS (SELECT plate, count(*) AS n, avg(x) AS kx, avg(y) AS ky, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c
  FROM y WHERE negcon GROUP BY plate HAVING count(*) > 1),
q AS (SELECT k.plate, avg(((x - kx) * (x - kx) + (y - ky) * (y - ky)) * ((x - kx) * (x - kx) + (y - ky) * (y - ky))) AS fourth
  FROM y JOIN k ON k.plate = y.plate WHERE negcon GROUP BY k.plate),
d AS (SELECT k.*, (a + c) / 2 AS mu, ((a - c) * (a - c) / 2 + 2 * b * b) / 2 AS delta,
    greatest((fourth - a * a - c * c - 2 * b * b) / (2 * n), 0) AS beta FROM k JOIN q ON q.plate = k.plate),
sh AS (SELECT plate, (1 - h) * a + h * mu AS a, (1 - h) * b AS b, (1 - h) * c + h * mu AS c
  FROM (SELECT *, CASE WHEN delta = 0 THEN 0 ELSE least(beta, delta) / delta END AS h FROM d)), {root_sql("w", "sh")},
o AS (SELECT y.*, ip, iq, ir FROM y LEFT JOIN w ON w.plate = y.plate)
{both("coalesce(x * ip + y * iq, 0)", "coalesce(x * iq + y * ir, 0)", "FROM o")}""")
def tvn_original_folded(spark, sf_dir):
    return cells(normalize.tvn_original(folded(spark, sf_dir), k=2)[0])


@register("tvn_cascade_folded", f"""WITH {FOLDED}, {ENOUGH}, gm AS (SELECT {OWN} FROM e), {axes_sql("g", "gm")},
y AS (SELECT f.row_id, f.plate, f.negcon, ((f.x - mx) * v1x + (f.y - my) * v1y) / sqrt(l1) AS x FROM f, g),
k AS (SELECT plate, stddev_pop(x) AS s FROM y WHERE negcon GROUP BY plate HAVING count(*) > 1)
SELECT row_id, CAST(0 AS BIGINT) AS pos, round(coalesce(x / s, 0), 6) AS value FROM y LEFT JOIN k ON k.plate = y.plate""")
def tvn_cascade_folded(spark, sf_dir):
    return cells(normalize.tvn_cascade(folded(spark, sf_dir), k1=1, k2=1)[0])


@register("spherize_folded", f"""WITH {FOLDED},
k AS (SELECT plate, n, mx, my, sx, sy, n AS a, n * r AS b, n AS c FROM (
  SELECT plate, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, corr(x, y) AS r FROM f GROUP BY plate)),
{root_sql("w", "k")},
o AS (SELECT f.row_id, (x - mx) / sx AS u, (y - my) / sy AS v, p + 1e-6 AS p, q, r + 1e-6 AS r,
    sqrt(n - 1) / ((p + 1e-6) * (r + 1e-6) - q * q) AS h FROM f JOIN w ON w.plate = f.plate)
{both("h * (u * r - v * q)", "h * (v * p - u * q)", "FROM o")}""")
def spherize_folded(spark, sf_dir):
    return cells(normalize.spherize(folded(spark, sf_dir), C.PLATE, None, "ZCA-cor"))


@register("spherize_truncated_folded", f"""WITH {FOLDED},
g AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, CASE WHEN corr(x, y) >= 0 THEN 1 ELSE -1 END AS w FROM f)
SELECT row_id, CAST(0 AS BIGINT) AS pos, round(((x - mx) / sx - w * (y - my) / sy) / sqrt(2), 6) AS value FROM f, g""")
def spherize_truncated_folded(spark, sf_dir):
    """The leading component of the correlations is dropped, the other is kept as it is."""
    return cells(normalize.spherize(folded(spark, sf_dir), None, None, remove_variance_threshold=0.3))


@register("pca_folded", f"""WITH {FOLDED}, gm AS (SELECT {OWN} FROM f), {axes_sql("g", "gm")}
SELECT row_id, CAST(0 AS BIGINT) AS pos, round((x - mx) * v1x + (y - my) * v1y, 6) AS value FROM f, g""")
def pca_folded(spark, sf_dir):
    return cells(normalize.pca(folded(spark, sf_dir), 1, control=None)[0])


@register("leading_variance_folded", f"""WITH {FOLDED}, gm AS (SELECT {OWN} FROM f), {axes_sql("g", "gm")}
SELECT l1 / (l1 + l2) <= 0.95 AS ok, round(l1 / (l1 + l2), 9) AS share FROM g""")
def leading_variance_folded(spark, sf_dir):
    ok, share = normalize.leading_variance_gate(folded(spark, sf_dir), 0.95)
    return spark.createDataFrame([(ok, round(share, 9))], "ok boolean, share double")
