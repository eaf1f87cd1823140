"""Image fidelity, plane grouping and corrected significance against SQL."""

from pyspark.sql import functions as F

from platewise.catalog.agreement import PLANES, planes
from platewise.catalog.registry import derive, register, with_clause
from platewise.operators import images as I
from platewise.operators.retrieval import activity_summary, corrected

SIZE = 16
GRID = with_clause(pl=PLANES) + f""", sites AS (SELECT DISTINCT site, channel FROM pl),
grid AS (SELECT site, channel, y, x FROM sites, range(-1, {SIZE + 1}) AS ty(y), range(-1, {SIZE + 1}) AS tx(x)),
f AS (SELECT g.site, g.channel, g.y, g.x, coalesce(pl.a, 0) AS a, coalesce(pl.b, 0) AS b FROM grid g LEFT JOIN pl
  ON pl.site = g.site AND pl.channel = g.channel AND pl.y = least(greatest(g.y, 0), {SIZE - 1}) AND pl.x = least(greatest(g.x, 0), {SIZE - 1}))"""


@register("image_tenengrad", GRID + f""", slope AS (SELECT c.site, c.channel, c.y, c.x,
  sum((c.y - n.y) * (2 - abs(c.x - n.x)) * n.a) / 4 AS gy, sum((c.x - n.x) * (2 - abs(c.y - n.y)) * n.a) / 4 AS gx
  FROM f c JOIN f n ON n.site = c.site AND n.channel = c.channel AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1
  WHERE c.y BETWEEN 0 AND {SIZE - 1} AND c.x BETWEEN 0 AND {SIZE - 1} GROUP BY ALL),
t AS (SELECT site, channel, avg(gx * gx + gy * gy) AS v FROM slope GROUP BY ALL)
SELECT site, round(avg(v), 3) AS tenengrad_orig FROM t GROUP BY site""")
def image_tenengrad(spark, sf_dir):
    out = I.image_quality(planes(spark, sf_dir), "raw").filter("codec = 'raw'")
    return out.select("site", F.round("tenengrad_orig", 3).alias("tenengrad_orig"))


HALF = I.SSIM_WIDTH // 2
WEIGHT = f"exp(-((i - {HALF}) * (i - {HALF})) / {2 * I.SSIM_SIGMA ** 2})"


@register("image_ssim", GRID + f""", k AS (SELECT i, {WEIGHT} / (SELECT sum({WEIGHT}) FROM range({I.SSIM_WIDTH}) AS t(i)) AS w FROM range({I.SSIM_WIDTH}) AS t(i)),
v AS (SELECT site, channel, y, x, a / 65535 AS a, b / 65535 AS b FROM f WHERE y BETWEEN 0 AND {SIZE - 1} AND x BETWEEN 0 AND {SIZE - 1}),
win AS (SELECT site, channel, y - p.i AS oy, x - q.i AS ox, sum(p.w * q.w * a) AS ma, sum(p.w * q.w * b) AS mb,
  sum(p.w * q.w * a * a) AS aa, sum(p.w * q.w * b * b) AS bb, sum(p.w * q.w * a * b) AS ab
  FROM v, k p, k q WHERE y - p.i BETWEEN 0 AND {SIZE - I.SSIM_WIDTH} AND x - q.i BETWEEN 0 AND {SIZE - I.SSIM_WIDTH} GROUP BY ALL),
s AS (SELECT site, channel, avg((2 * ma * mb + {I.SSIM_C1}) * (2 * (ab - ma * mb) + {I.SSIM_C2})
  / ((ma * ma + mb * mb + {I.SSIM_C1}) * (aa - ma * ma + bb - mb * mb + {I.SSIM_C2}))) AS s FROM win GROUP BY ALL)
SELECT site, round(avg(s), 6) AS ssim FROM s GROUP BY site""")
def image_ssim(spark, sf_dir):
    out = I.image_quality(planes(spark, sf_dir), "raw").filter("codec = 'hq'")
    return out.select("site", F.round("ssim", 6).alias("ssim"))


@register("grouped_planes", with_clause(pl=PLANES) + """ SELECT site, codec, list(DISTINCT channel ORDER BY channel) AS channels
FROM pl, (VALUES ('raw'), ('hq')) AS t(codec) GROUP BY ALL""")
def grouped_planes(spark, sf_dir):
    return I.group_planes(planes(spark, sf_dir)).select(
        "site", "codec", F.transform("planes", lambda p: p["channel"]).alias("channels"))


LEVELS = """SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS family, l_partkey % 500 AS exceed,
  (l_partkey % 500 + 1) / 501.0e0 AS p_value FROM {lineitem}"""


@register("corrected_p_values", with_clause(t=LEVELS) + """, lv AS (SELECT family, exceed, p_value, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY family ORDER BY exceed) AS place, sum(n) OVER (PARTITION BY family) AS m FROM lv),
q AS (SELECT family, exceed, least(1.0, min(p_value * m / place) OVER (PARTITION BY family ORDER BY exceed DESC)) AS corrected FROM r)
SELECT id, line, round(corrected, 9) AS corrected FROM t JOIN q USING (family, exceed)""")
def corrected_p_values(spark, sf_dir):
    out = corrected(derive(spark, sf_dir, LEVELS), "exceed", "p_value", ["family"])
    return out.select("id", "line", F.round("corrected_p_value", 9).alias("corrected"))


FLAGS = """SELECT o_orderstatus AS grp, o_custkey AS pert, o_totalprice / 500000.0e0 - 0.2e0 AS nap, o_orderkey % 7 < 3 AS active FROM {orders}"""


@register("active_share", with_clause(t=FLAGS) + """ SELECT grp, round(100.0 * count(*) FILTER (active) / count(*), 9) AS pct_active,
  count(*) FILTER (active) AS num_active, round(avg(greatest(nap, 0)), 9) AS mean_nap_clipped, count(DISTINCT pert) AS n_units FROM t GROUP BY grp""")
def active_share(spark, sf_dir):
    maps = derive(spark, sf_dir, FLAGS).withColumnsRenamed(
        {"nap": "mean_normalized_average_precision", "active": "below_corrected_p"})
    out = activity_summary(maps, ["grp"], "pert")
    return out.select("grp", F.round("pct_active", 9).alias("pct_active"), "num_active",
                      F.round("mean_nap_clipped", 9).alias("mean_nap_clipped"), "n_units")
