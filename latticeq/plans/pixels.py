"""Queries over pixels: each vector's entries, in threes, are the colors of 21 pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from .catalog import rounded, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
N_PIXELS = 21
KNOTS = [(0.0, 30.0), (51.0, 60.0), (102.0, 90.0), (153.0, 160.0), (204.0, 200.0), (255.0, 230.0)]
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _byte_sql(i: str) -> str:
    return f"floor(least(greatest((embedding[{i}]::DOUBLE + 1) * 127.5::DOUBLE, 0), 255))::INT"


PX_SQL = f"WITH px AS (SELECT vec_id::BIGINT AS id, k::BIGINT AS k, {_byte_sql('3 * k + 1')} AS r, {_byte_sql('3 * k + 2')} AS g, {_byte_sql('3 * k + 3')} AS b FROM embeddings, range({N_PIXELS}) t(k))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(N_PIXELS - 1))).alias("k"))
    value = [color.to_byte((F.element_at("embedding", F.col("k") * 3 + c).cast("double") + 1.0) * 127.5) for c in (1, 2, 3)]
    return e.select("id", F.col("k").cast("bigint").alias("k"), *(v.alias(n) for v, n in zip(value, "rgb")))


def rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


@query(PX_SQL + " SELECT id, k, round((r / 255e0 - 0.485e0) / 0.229e0, 6) + 0e0 AS r, round((g / 255e0 - 0.456e0) / 0.224e0, 6) + 0e0 AS g, round((b / 255e0 - 0.406e0) / 0.225e0, 6) + 0e0 AS b FROM px")
def to_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("id", "k", *(rounded((F.col(c) / 255.0 - m) / s).alias(c) for c, m, s in zip("rgb", CHANNEL_MEAN, CHANNEL_STD)))


@query(PX_SQL + " SELECT id, k, floor(0.299e0 * r + 0.587e0 * g + 0.114e0 * b + 0.5e0)::INT AS y FROM px")
def gray_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("id", "k", color.luma(*rgb()).alias("y"))


@query(PX_SQL + " SELECT id, k, b AS r, 255 - r AS g, g AS b FROM px")
def channel_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels in another order, the second one inverted."""
    return pixels(spark, sf_dir).select("id", "k", F.col("b").alias("r"), (255 - F.col("r")).alias("g"), F.col("g").alias("b"))


@query(PX_SQL + """
, m AS (SELECT *, greatest(r, g, b)::DOUBLE AS v, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS d FROM px),
h AS (SELECT *, CASE WHEN d = 0 THEN 0e0 WHEN v = r THEN 60e0 * (g - b) / d WHEN v = g THEN 120e0 + 60e0 * (b - r) / d ELSE 240e0 + 60e0 * (r - g) / d END AS h0 FROM m),
s AS (SELECT id, k, ((CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END) / 2e0 + 40e0) % 180e0 AS h, least(greatest(CASE WHEN v = 0 THEN 0e0 ELSE 255e0 * d / v END * 1.2e0, 0), 255e0) AS s, 255e0 * pow(v / 255e0, 0.8e0) AS v FROM h),
q AS (SELECT *, h * 2e0 / 60e0 AS p, s / 255e0 AS t FROM s),
w AS (SELECT id, k, v, floor(p)::INT % 6 AS i, v * (1e0 - t) AS a, v * (1e0 - t * (p - floor(p))) AS b, v * (1e0 - t * (1e0 - (p - floor(p)))) AS c FROM q)
SELECT id, k, floor(least(greatest([v, b, a, a, c, v][i + 1], 0), 255) + 0.5e0)::INT AS r, floor(least(greatest([c, v, v, b, a, a][i + 1], 0), 255) + 0.5e0)::INT AS g, floor(least(greatest([a, a, c, v, v, b][i + 1], 0), 255) + 0.5e0)::INT AS b FROM w
""")
def hsv_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = color.hsv_shift(*rgb(), 40.0, 1.2, 0.8)
    return pixels(spark, sf_dir).select("id", "k", *(c.alias(n) for c, n in zip(out, "rgb")))


def _curve_sql(c: str) -> str:
    arms = " ".join(f"WHEN {c} < {x1} THEN {y0} + ({c} - {x0}) * ({y1} - {y0}) / ({x1} - {x0})" for (x0, y0), (x1, y1) in zip(KNOTS[:-2], KNOTS[1:-1]))
    (x0, y0), (x1, y1) = KNOTS[-2:]
    return f"floor(least(greatest(CASE {arms} ELSE {y0} + ({c} - {x0}) * ({y1} - {y0}) / ({x1} - {x0}) END, 0), 255))::INT".replace(".0", "e0")


@query(PX_SQL + f" SELECT id, k, {_curve_sql('r')} AS r, {_curve_sql('g')} AS g, {_curve_sql('b')} AS b FROM px")
def tone_curve_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("id", "k", *(color.curve(c, KNOTS).alias(n) for c, n in zip(rgb(), "rgb")))


def _lin(c: str) -> str:
    return f"CASE WHEN {c} / 255e0 > 0.04045e0 THEN pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) ELSE {c} / 255e0 / 12.92e0 END"


def _f(t: str) -> str:
    return f"CASE WHEN {t} > 0.008856e0 THEN pow({t}, 1e0 / 3e0) ELSE 7.787e0 * {t} + 16e0 / 116e0 END"


LAB_SQL = PX_SQL + f"""
, lin AS (SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM px),
xyz AS (SELECT *, (0.412453e0 * lr + 0.357580e0 * lg + 0.180423e0 * lb) / 0.950456e0 AS x, (0.212671e0 * lr + 0.715160e0 * lg + 0.072169e0 * lb) / 1e0 AS y, (0.019334e0 * lr + 0.119193e0 * lg + 0.950227e0 * lb) / 1.088754e0 AS z FROM lin),
lab AS (SELECT id, k, r, g, b, CASE WHEN y > 0.008856e0 THEN 116e0 * pow(y, 1e0 / 3e0) - 16e0 ELSE 903.3e0 * y END * 255e0 / 100e0 AS ll, 500e0 * ({_f('x')} - {_f('y')}) + 128e0 AS la, 200e0 * ({_f('y')} - {_f('z')}) + 128e0 AS lb FROM (SELECT id, k, r, g, b, x, y, z FROM xyz))
""".replace("500e0 * (CASE", "500e0 * ((CASE").replace("200e0 * (CASE", "200e0 * ((CASE").replace("116e0 END - CASE", "116e0 END) - (CASE").replace("116e0 END) + 128e0", "116e0 END)) + 128e0")


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("id", "k", "r", "g", "b", *(c.alias(n) for c, n in zip(color.rgb_to_lab(*rgb()), ("ll", "la", "lb"))))


LAB = ("ll", "la", "lb")


def lab_cols(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in LAB]


@query(LAB_SQL + " SELECT id, k, round(ll, 4) + 0e0 AS l, round(la, 4) + 0e0 AS a, round(lb, 4) + 0e0 AS b FROM lab")
def rgb_to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab(spark, sf_dir).select("id", "k", *(rounded(F.col(c), 4).alias(n) for c, n in zip(LAB, "lab")))


BACK_SQL = """
, st AS (SELECT *, ll * 100e0 / 255e0 AS star FROM {source}),
fy AS (SELECT *, CASE WHEN star > 7.9996e0 THEN (star + 16e0) / 116e0 ELSE 7.787e0 * (star / 903.3e0) + 16e0 / 116e0 END AS fy, CASE WHEN star > 7.9996e0 THEN pow((star + 16e0) / 116e0, 3e0) ELSE star / 903.3e0 END AS y FROM st),
fx AS (SELECT *, fy + (la - 128e0) / 500e0 AS fx, fy - (lb - 128e0) / 200e0 AS fz FROM fy),
xz AS (SELECT *, 0.950456e0 * CASE WHEN fx > 0.2068966e0 THEN pow(fx, 3e0) ELSE (fx - 16e0 / 116e0) / 7.787e0 END AS x, 1.088754e0 * CASE WHEN fz > 0.2068966e0 THEN pow(fz, 3e0) ELSE (fz - 16e0 / 116e0) / 7.787e0 END AS z FROM fx),
li AS (SELECT id, k, [3.240479e0 * x + -1.537150e0 * y + -0.498535e0 * z, -0.969256e0 * x + 1.875991e0 * y + 0.041556e0 * z, 0.055648e0 * x + -0.204043e0 * y + 1.057311e0 * z] AS v FROM xz),
bk AS (SELECT id, k, list_transform(v, lambda t: floor(least(greatest(255e0 * CASE WHEN t > 0.0031308e0 THEN 1.055e0 * pow(greatest(t, 0), 1e0 / 2.4e0) - 0.055e0 ELSE 12.92e0 * t END + 1e-6, 0), 255))::INT) AS o FROM li)
SELECT id, k, o[1] AS r, o[2] AS g, o[3] AS b FROM bk
"""


@query(LAB_SQL + BACK_SQL.format(source="lab"))
def lab_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back: the channels come out as they were, or one less where the fraction is cut off."""
    return lab(spark, sf_dir).select("id", "k", *(c.alias(n) for c, n in zip(color.lab_to_rgb(*lab_cols()), "rgb")))


MOMENT_SQL = ", mo AS (SELECT id, avg(ll) AS ml, stddev_pop(ll) + 1e-3 AS sl, avg(la) AS ma, stddev_pop(la) + 1e-3 AS sa, avg(lb) AS mb, stddev_pop(lb) + 1e-3 AS sb FROM lab GROUP BY id)"


def moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(*(x for c, n in zip(LAB, "lab") for x in (F.avg(c).alias(f"m{n}"), (F.stddev_pop(c) + 1e-3).alias(f"s{n}"))))


@query(LAB_SQL + MOMENT_SQL + " SELECT id, round(ml, 4) + 0e0 AS ml, round(sl, 4) + 0e0 AS sl, round(ma, 4) + 0e0 AS ma, round(sa, 4) + 0e0 AS sa, round(mb, 4) + 0e0 AS mb, round(sb, 4) + 0e0 AS sb FROM mo")
def lab_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(lab(spark, sf_dir)).select("id", *(rounded(F.col(f"{x}{n}"), 4).alias(f"{x}{n}") for n in "lab" for x in "ms"))


@query(LAB_SQL + MOMENT_SQL + """
, tr AS (SELECT id, k, (ll - ml) / sl * 45e0 + 130e0 AS ll, (la - ma) / sa * 12e0 + 120e0 AS la, (lb - mb) / sb * 15e0 + 140e0 AS lb FROM lab JOIN mo USING (id))
SELECT id, k, round(ll, 4) + 0e0 AS l, round(la, 4) + 0e0 AS a, round(lb, 4) + 0e0 AS b FROM tr
""")
def reinhard_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lab(spark, sf_dir)
    to = zip(LAB, "lab", (130.0, 120.0, 140.0), (45.0, 12.0, 15.0))
    out = [color.match_moments(F.col(c), F.col(f"m{n}"), F.col(f"s{n}"), F.lit(m), F.lit(s)).alias(c) for c, n, m, s in to]
    return rows.join(moments(rows), "id").select("id", "k", *out).select("id", "k", *(rounded(F.col(c), 4).alias(n) for c, n in zip(LAB, "lab")))


#: Distances are rounded before they are compared, so that engines agree on ties.
ASSIGN_SQL = LAB_SQL + """
, ce AS (SELECT id, k AS c, ll, la, lb FROM lab WHERE k < 4),
di AS (SELECT p.id, p.k, ce.c, p.ll, p.la, p.lb, round((p.ll - ce.ll) * (p.ll - ce.ll) + (p.la - ce.la) * (p.la - ce.la) + (p.lb - ce.lb) * (p.lb - ce.lb), 6) AS d FROM lab p JOIN ce USING (id)),
asg AS (SELECT id, k, any_value(ll) AS ll, any_value(la) AS la, any_value(lb) AS lb, arg_min(c, struct_pack(d := d, c := c)) AS cluster FROM di GROUP BY 1, 2)
"""


def assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pixels with their nearest of four centers (the first four pixels of each image), and the centers."""
    rows = lab(spark, sf_dir)
    centers = rows.where("k < 4").select(F.col("id").alias("cid"), F.col("k").alias("c"), *(F.col(x).alias(f"c_{x}") for x in LAB))
    gaps = [F.col(x) - F.col(f"c_{x}") for x in LAB]
    d = F.round(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2], 6)
    near = rows.join(centers, F.col("id") == F.col("cid")).groupBy("id", "k", *LAB).agg(F.min_by("c", F.struct(d.alias("d"), F.col("c"))).alias("cluster"))
    return near, centers


@query(ASSIGN_SQL + " SELECT id, k, cluster FROM asg")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir)[0].select("id", "k", "cluster")


@query(ASSIGN_SQL + """
, mn AS (SELECT id, cluster AS c, avg(ll) AS l, avg(la) AS a, avg(lb) AS b FROM asg GROUP BY 1, 2)
SELECT ce.id, ce.c, round(coalesce(mn.l, ce.ll), 4) + 0e0 AS l, round(coalesce(mn.a, ce.la), 4) + 0e0 AS a, round(coalesce(mn.b, ce.lb), 4) + 0e0 AS b FROM ce LEFT JOIN mn ON ce.id = mn.id AND ce.c = mn.c
""")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New centers: the members' means; a center without members stays."""
    near, centers = assigned(spark, sf_dir)
    means = near.groupBy("id", F.col("cluster").alias("mc")).agg(*(F.avg(x).alias(f"m_{x}") for x in LAB))
    out = centers.join(means, (F.col("cid") == F.col("id")) & (F.col("c") == F.col("mc")), "left")
    return out.select(F.col("cid").alias("id"), "c", *(rounded(F.coalesce(f"m_{x}", f"c_{x}"), 4).alias(n) for x, n in zip(LAB, "lab")))


@query(LAB_SQL + """
, pa AS (SELECT id, list(struct_pack(l := round(ll, 6), a := round(la, 6), b := round(lb, 6)) ORDER BY round(ll, 6), round(la, 6), round(lb, 6)) AS p FROM lab WHERE k < 6 GROUP BY id)
SELECT id, n::BIGINT AS n, i::BIGINT AS i, p[round_even(i * 5e0 / greatest(n - 1, 1), 0)::INT + 1].l + 0e0 AS l FROM pa, (VALUES (1), (3), (4), (6)) v(n), range(6) t(i) WHERE i < n
""")
def fit_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of six colors brought to other sizes by evenly spaced ranks."""
    color_of = F.struct(*(F.round(x, 6).alias(n) for x, n in zip(LAB, "lab")))
    p = lab(spark, sf_dir).where("k < 6").groupBy("id").agg(F.collect_list(color_of).alias("p")).withColumn("n", F.explode(F.array(*(F.lit(n) for n in (1, 3, 4, 6)))))
    q = p.select("id", "n", F.posexplode(color.fit_palette(F.col("p"), F.col("n"))).alias("i", "c"))
    return q.select("id", F.col("n").cast("bigint").alias("n"), F.col("i").cast("bigint").alias("i"), rounded(F.col("c.l")).alias("l"))


DIST_SQL = LAB_SQL + """
, ce AS (SELECT id, k AS c, ll, la, lb FROM lab WHERE k < 4),
ds AS (SELECT p.id, p.k, ce.c, 0.35e0 * (p.ll - ce.ll) * (p.ll - ce.ll) + (p.la - ce.la) * (p.la - ce.la) + (p.lb - ce.lb) * (p.lb - ce.lb) AS d FROM lab p JOIN ce USING (id))
"""


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lab(spark, sf_dir)
    centers = rows.where("k < 4").select(F.col("id").alias("cid"), F.col("k").alias("c"), *(F.col(x).alias(f"c_{x}") for x in LAB))
    return rows.join(centers, F.col("id") == F.col("cid")).select("id", "k", "c", color.palette_distance(lab_cols(), lab_cols("c_")).alias("d"))


@query(DIST_SQL + " SELECT id, k, c, round(d, 2) + 0e0 AS d FROM ds")
def lab_weighted_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).select("id", "k", "c", rounded(F.col("d"), 2).alias("d"))


@query(DIST_SQL + ", w AS (SELECT id, k, c, exp((min(d) OVER (PARTITION BY id, k) - d) / 60e0) AS e FROM ds) SELECT id, k, c, round(e / sum(e) OVER (PARTITION BY id, k), 6) + 0e0 AS w FROM w")
def soft_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distances(spark, sf_dir).groupBy("id", "k").agg(F.array_sort(F.collect_list(F.struct("c", "d"))).alias("x"))
    w = color.soft_weights(F.transform("x", lambda s: s["d"]))
    return d.select("id", "k", F.posexplode(w).alias("c", "w")).select("id", "k", F.col("c").cast("bigint").alias("c"), rounded(F.col("w")).alias("w"))


@query(DIST_SQL + """
, pr AS (SELECT id, k AS i, c AS j, round(d, 6) AS d FROM ds WHERE k < c)
SELECT id, arg_min(i, struct_pack(d := d, i := i, j := j)) AS i, arg_min(j, struct_pack(d := d, i := i, j := j)) AS j, min(d) < 22 * 22 AS merges FROM pr GROUP BY id
""")
def merge_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest two of four colors, and whether they are close enough to be merged."""
    p = distances(spark, sf_dir).where("k < c").select("id", F.col("k").alias("i"), F.col("c").alias("j"), F.round("d", 6).alias("d"))
    best = F.min(F.struct("d", "i", "j"))
    return p.groupBy("id").agg(best.alias("m")).select("id", "m.i", "m.j", (F.col("m.d") < 22 * 22).alias("merges"))
