"""Queries over vectors: identification, verification, ROC, roll-ups, loss, schedules, specifications.

The query set and the gallery are stated: the first vector of each label is its gallery row, all others are queries.
Searches of the whole table (``identify_topk``, ``cosine_matrix_topk``, ``mean_average_precision``) take as queries all
vectors whose id is divisible by 50, against all vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_root, cut
from ..functions import vectors
from ..operators import benchmark, ingest, ranking, reports, roc, specs, training
from ..sources import files
from .catalog import rounded, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def dot_sql(a: str, b: str) -> str:
    return f"list_reduce(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE), lambda p, q: p + q)"


ROLES_SQL = f"""
WITH v AS (SELECT vec_id::BIGINT AS id, label::BIGINT AS label, embedding AS vec, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings),
gal AS (SELECT * FROM v WHERE id = first), que AS (SELECT * FROM v WHERE id <> first),
sc AS (SELECT q.id AS q, q.label AS q_label, g.id AS g, g.label AS g_label, {dot_sql('q.vec', 'g.vec')} AS s FROM que q CROSS JOIN gal g),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rank FROM sc),
hi AS (SELECT *, sum((g_label = q_label)::INT) OVER (PARTITION BY q ORDER BY rank) AS hits FROM rk),
pq AS (SELECT q, q_label, min(rank) FILTER (g_label = q_label) AS first_hit,
  sum(CASE WHEN g_label = q_label THEN hits::DOUBLE / rank ELSE 0 END) / greatest(sum((g_label = q_label)::INT), 1) AS ap,
  arg_min(g_label, rank) AS top_label FROM hi GROUP BY 1, 2)
"""
#: The stated query set against every other vector.
WIDE_SQL = f"""
WITH v AS (SELECT vec_id::BIGINT AS id, label::BIGINT AS label, embedding AS vec, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings),
sc AS (SELECT q.id AS q, q.label AS q_label, g.id AS g, g.label AS g_label, {dot_sql('q.vec', 'g.vec')} AS s FROM (SELECT * FROM v WHERE id % 50 = 0) q JOIN v g ON g.id <> q.id)
"""


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("vec"))
    first = rows.groupBy(F.col("label").alias("__l")).agg(F.min("id").alias("first"))
    return rows.join(first, F.col("label") == F.col("__l")).drop("__l")


def named(rows: DataFrame, p: str) -> DataFrame:
    return rows.select(F.col("id").alias(p), F.col("label").alias(f"{p}_label"), F.col("vec").alias(f"{p}_vec"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vecs(spark, sf_dir)
    return ranking.scores(named(v.where("id <> first"), "q"), named(v.where("id = first"), "g"))


def scored_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against every other vector."""
    v = vecs(spark, sf_dir)
    return ranking.scores(named(v.where("id % 50 = 0"), "q"), named(v, "g")).where("q <> g")


def per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vecs(spark, sf_dir)
    return ranking.ranked(named(v.where("id <> first"), "q"), named(v.where("id = first"), "g"))


@query(WIDE_SQL + """
, l AS (SELECT q, g_label, max(s) AS s, min(g) AS first_g FROM sc GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, first_g) AS rank FROM l)
SELECT q, g_label AS label, round(s, 6) + 0e0 AS score, rank::BIGINT AS rank FROM r WHERE rank <= 5
""")
def identify_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.identify(scored_wide(spark, sf_dir)).select("q", F.col("g_label").alias("label"), rounded(F.col("s")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(WIDE_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rank FROM sc)
SELECT q, g, round(s, 6) + 0e0 AS score, rank::BIGINT AS rank FROM r WHERE rank <= 10
""")
def cosine_matrix_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(scored_wide(spark, sf_dir), 10).select("q", "g", rounded(F.col("s")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(ROLES_SQL + """
SELECT round(avg((coalesce(first_hit, 999) <= 1)::INT), 6) + 0e0 AS r1, round(avg((coalesce(first_hit, 999) <= 5)::INT), 6) + 0e0 AS r5,
  CASE WHEN (SELECT count(*) FROM gal) >= 10 THEN round(avg((coalesce(first_hit, 999) <= 10)::INT), 6) + 0e0 END AS r10, count(*)::BIGINT AS n_queries FROM pq
""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ranking.identification(per_query(spark, sf_dir))
    return m.select(*(rounded(F.col(f"r{k}")).alias(f"r{k}") for k in ranking.KS), "n_queries")


@query(WIDE_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rank FROM sc),
h AS (SELECT *, sum((g_label = q_label)::INT) OVER (PARTITION BY q ORDER BY rank) AS hits FROM r),
p AS (SELECT q, sum(CASE WHEN g_label = q_label THEN hits::DOUBLE / rank ELSE 0 END) / greatest(sum((g_label = q_label)::INT), 1) AS ap FROM h GROUP BY 1)
SELECT round(avg(ap), 6) + 0e0 AS map, count(*)::BIGINT AS n_queries FROM p
""")
def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vecs(spark, sf_dir)
    m = ranking.identification(ranking.ranked(named(v.where("id % 50 = 0"), "q"), named(v, "g"), apart=True))
    return m.select(rounded(F.col("map")).alias("map"), "n_queries")


@query(ROLES_SQL + """
, d AS (SELECT *, (q_label * 7) % 9 + CASE WHEN (q_label * 7) % 9 >= q_label THEN 1 ELSE 0 END AS donor FROM pq)
SELECT round(avg((top_label = donor)::INT), 6) + 0e0 AS trap1, count(*)::BIGINT AS n_queries FROM d
""")
def trap_at_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ranking.identification(per_query(spark, sf_dir).withColumn("donor", specs.donor(F.col("q_label"), 10)), donor="donor")
    return m.select(rounded(F.col("trap1")).alias("trap1"), "n_queries")


@query(ROLES_SQL + """
SELECT q, g, rank::BIGINT AS rank, CASE WHEN g_label = q_label THEN 'green' WHEN g_label = (q_label * 7) % 9 + CASE WHEN (q_label * 7) % 9 >= q_label THEN 1 ELSE 0 END THEN 'red' ELSE 'gray' END AS mark
FROM rk WHERE rank <= 5
""")
def trap_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("g_label") == F.col("q_label"), "green").when(F.col("g_label") == specs.donor(F.col("q_label"), 10), "red").otherwise("gray")
    return ranking.top_k(scored(spark, sf_dir), 5).select("q", "g", F.col("rank").cast("bigint").alias("rank"), mark.alias("mark"))


FAMILY_SQL = f"[{', '.join(repr(f) for f in specs.FAMILIES)}][q % 8 + 1]"
ROLLUP_SQL = ROLES_SQL + f"""
, f AS (SELECT *, {FAMILY_SQL} AS family, CASE WHEN q % 8 >= 6 THEN 'heldout' ELSE 'train' END AS family_class FROM pq)
"""


def by_family(rows: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(f) for f in specs.FAMILIES))
    return rows.withColumn("family", F.element_at(names, (F.col("q") % 8 + 1).cast("int"))).withColumn("family_class", F.when(F.col("q") % 8 >= 6, "heldout").otherwise("train"))


@query(ROLLUP_SQL + """
SELECT family, family_class, round(avg((coalesce(first_hit, 999) <= 1)::INT), 6) + 0e0 AS r1, round(avg((coalesce(first_hit, 999) <= 5)::INT), 6) + 0e0 AS r5,
  round(avg((coalesce(first_hit, 999) <= 10)::INT), 6) + 0e0 AS r10, round(avg(ap), 6) + 0e0 AS map, count(*)::BIGINT AS n_queries
FROM f GROUP BY GROUPING SETS ((family), (family_class), ())
""")
def p1_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ranking.rolled_up(by_family(per_query(spark, sf_dir)), "family", "family_class")
    return m.select("family", "family_class", *(rounded(F.col(c)).alias(c) for c in ("r1", "r5", "r10", "map")), "n_queries")


def cut_sql(d: str) -> str:
    """Ranking of the queries by the first ``d`` entries of their vectors, as another model's run."""
    return f"""
SELECT q, min(rank) FILTER (hit) AS first_hit FROM (
  SELECT q, hit, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rank FROM (
    SELECT q.id AS q, g.id AS g, q.label = g.label AS hit, list_reduce(list_transform(range(1, {d} + 1), lambda i: q.vec[i]::DOUBLE * g.vec[i]::DOUBLE), lambda x, y: x + y) AS s FROM que q CROSS JOIN gal g)) GROUP BY q"""


def run_of(spark: SparkSession, sf_dir: str, d: int) -> DataFrame:
    """Ranked queries of a model that sees the first ``d`` entries only."""
    v = vecs(spark, sf_dir).withColumn("vec", F.slice("vec", 1, d))
    return ranking.ranked(named(v.where("id <> first"), "q"), named(v.where("id = first"), "g"))


@query(ROLES_SQL + f"""
, a AS ({cut_sql('16')}), b AS ({cut_sql('64')}),
x AS (SELECT {FAMILY_SQL} AS family, avg((coalesce(first_hit, 999) <= 1)::INT) AS r1 FROM a GROUP BY 1), y AS (SELECT {FAMILY_SQL} AS family, avg((coalesce(first_hit, 999) <= 1)::INT) AS r1 FROM b GROUP BY 1)
SELECT family || CASE WHEN family IN ('curves', 'reinhard') THEN ' *' ELSE '' END AS family, round(x.r1, 6) + 0e0 AS zero_shot, round(y.r1, 6) + 0e0 AS ours FROM x JOIN y USING (family)
""")
def family_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side by family, those unseen in training marked: a model of 16 entries and one of all 64."""
    a, b = (ranking.identification(by_family(run_of(spark, sf_dir, d)), ("family",), ks=(1,)).select("family", F.col("r1").alias(name)) for d, name in ((16, "zero_shot"), (64, "ours")))
    name = F.concat("family", F.when(F.col("family").isin(*specs.HELD_OUT_FAMILIES), " *").otherwise(""))
    return a.join(b, "family").select(name.alias("family"), rounded(F.col("zero_shot")).alias("zero_shot"), rounded(F.col("ours")).alias("ours"))


@query(ROLES_SQL + """
, r AS (SELECT q % 3 AS round, avg((coalesce(first_hit, 999) <= 1)::INT) AS r1, avg((coalesce(first_hit, 999) <= 5)::INT) AS r5, avg(ap) AS map, count(*)::DOUBLE AS n FROM pq GROUP BY 1)
SELECT round(avg(r1), 6) + 0e0 AS r1, round(avg(r5), 6) + 0e0 AS r5, round(avg(map), 6) + 0e0 AS map, round(avg(n), 6) + 0e0 AS n_queries FROM r
""")
def p3_round_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = ranking.identification(per_query(spark, sf_dir).withColumn("round", F.col("q") % 3), ("round",))
    return per.agg(*(rounded(F.avg(c)).alias(c) for c in ("r1", "r5", "map", "n_queries")))


PAIRS_SQL = f"""
WITH v AS (SELECT vec_id::BIGINT AS id, label::BIGINT AS label, embedding AS vec FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CASE WHEN a.label = b.label THEN 'genuine' WHEN (a.id + b.id) % 2 = 0 THEN 'impostor_random' ELSE 'impostor_samepal' END AS kind,
  {dot_sql('a.vec', 'b.vec')} AS s, round({dot_sql('a.vec', 'b.vec')}, 2) + 0e0 AS t
  FROM v a JOIN v b ON b.id IN (a.id + 1, a.id + 10, a.id + 37, a.id + 101))
"""
CURVE_SQL = PAIRS_SQL + """
, c AS (SELECT t AS s, count(*) FILTER (same) AS tp, count(*) FILTER (NOT same) AS fp FROM p GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY s DESC)::BIGINT AS k, s, tp AS own_tp, fp AS own_fp, sum(tp) OVER (ORDER BY s DESC)::BIGINT AS tp, sum(fp) OVER (ORDER BY s DESC)::BIGINT AS fp,
  sum(tp) OVER ()::BIGINT AS n_pos, sum(fp) OVER ()::BIGINT AS n_neg FROM c),
w AS (SELECT *, lead(own_tp) OVER (ORDER BY k) AS next_tp, lead(own_fp) OVER (ORDER BY k) AS next_fp FROM r),
x AS (SELECT k, s, tp, fp, n_pos, n_neg FROM w WHERE next_tp IS NULL OR next_tp <> own_tp OR next_fp <> own_fp
  UNION ALL SELECT 0, 'inf'::DOUBLE, 0, 0, max(n_pos), max(n_neg) FROM r)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors at fixed distances of their ids."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("vec"))
    a = v.select(F.col("id").alias("a"), F.col("label").alias("la"), F.explode(F.array(*(F.col("id") + d for d in (1, 10, 37, 101)))).alias("b"))
    p = a.join(v.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    same = F.col("la") == F.col("lb")
    kind = F.when(same, "genuine").when((F.col("a") + F.col("b")) % 2 == 0, "impostor_random").otherwise("impostor_samepal")
    out = ranking.pair_scores(p.select("a", "b", same.alias("same"), kind.alias("kind")), v)
    return out.withColumn("t", rounded(F.col("s"), 2))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roc.curve(pairs(spark, sf_dir).select("t", "same"), "t")


@query(PAIRS_SQL + "SELECT a, b, round(s, 6) + 0e0 AS score, s >= 0.05 AS said FROM p")
def verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("a", "b", rounded(F.col("s")).alias("score"), (F.col("s") >= 0.05).alias("said"))


@query(PAIRS_SQL + "SELECT kind, round(avg(s), 6) + 0e0 AS mean, round(stddev_pop(s), 6) + 0e0 AS std, format('{:.2f}±{:.2f}', abs(avg(s)), stddev_pop(s)) AS shown, count(*)::BIGINT AS n FROM p GROUP BY kind")
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, std = F.avg("s"), F.stddev_pop("s")
    return pairs(spark, sf_dir).groupBy("kind").agg(rounded(mean).alias("mean"), rounded(std).alias("std"), F.format_string("%.2f±%.2f", F.abs(mean), std).alias("shown"), F.count("*").alias("n"))


@query(CURVE_SQL + "SELECT k, s, tp, fp FROM x WHERE k > 0")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roc.corners(points(spark, sf_dir)).where("k > 0").select("k", "s", "tp", "fp")


@query(CURVE_SQL + "SELECT round(sum(own_fp * (tp - own_tp / 2e0)) / (max(n_pos)::DOUBLE * max(n_neg)), 6) + 0e0 AS auc FROM r")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roc.auc(points(spark, sf_dir)).select(rounded(F.col("auc")).alias("auc"))


@query("""
WITH d AS (SELECT n_chars::DOUBLE AS s, quality = 1 AS same FROM documents JOIN labels USING (doc_id)),
c AS (SELECT s, count(*) FILTER (same) AS tp, count(*) FILTER (NOT same) AS fp FROM d GROUP BY 1),
r AS (SELECT s, tp AS own_tp, fp AS own_fp, sum(tp) OVER (ORDER BY s DESC)::BIGINT AS tp FROM c)
SELECT round(sum(own_fp * (tp - own_tp / 2e0)) / (sum(own_tp)::DOUBLE * sum(own_fp)), 6) + 0e0 AS auc FROM r
""")
def roc_auc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("same")), "doc_id")
    return roc.auc(roc.curve(d)).select(rounded(F.col("auc")).alias("auc"))


EER_SQL = """
e AS (SELECT arg_min(struct_pack(eer := ((1 - tp / n_pos::DOUBLE) + fp / n_neg::DOUBLE) / 2, t := s), struct_pack(d := abs((1 - tp / n_pos::DOUBLE) - fp / n_neg::DOUBLE), k := k)) AS m FROM x)
"""


@query(CURVE_SQL + "," + EER_SQL + "SELECT round(m.eer, 6) + 0e0 AS eer, m.t AS threshold FROM e")
def eer_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roc.equal_error(roc.corners(points(spark, sf_dir))).select(rounded(F.col("eer")).alias("eer"), "threshold")


@query(CURVE_SQL + """
SELECT round(coalesce(max(tp / n_pos::DOUBLE) FILTER (fp / n_neg::DOUBLE <= 0.01), 0), 6) + 0e0 AS tar_0, round(coalesce(max(tp / n_pos::DOUBLE) FILTER (fp / n_neg::DOUBLE <= 0.001), 0), 6) + 0e0 AS tar_1 FROM x
""")
def tar_at_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roc.accept_at(roc.corners(points(spark, sf_dir))).select(rounded(F.col("tar_0")).alias("tar_0"), rounded(F.col("tar_1")).alias("tar_1"))


@query(CURVE_SQL.replace("FROM p GROUP BY 1", "FROM p WHERE a % 2 = 0 GROUP BY 1") + "," + EER_SQL + """
, t AS (SELECT *, t >= (SELECT m.t FROM e) AS said FROM p WHERE a % 2 = 1)
SELECT round(avg((said = same)::INT), 6) + 0e0 AS acc, round(avg(said::INT) FILTER (same), 6) + 0e0 AS tar, round(avg(said::INT) FILTER (NOT same), 6) + 0e0 AS far,
  count(*) FILTER (same)::BIGINT AS n_genuine, count(*) FILTER (NOT same)::BIGINT AS n_impostor FROM t
""")
def val_calibrated_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold comes from one half of the pairs and is applied to the other."""
    p = cut(pairs(spark, sf_dir).select("a", "t", "same"))
    tau = roc.equal_error(roc.corners(roc.curve(p.where("a % 2 = 0"), "t"))).first()["threshold"]
    m = roc.at_threshold(p.where("a % 2 = 1"), F.lit(float(tau)), "t")
    return m.select(*(rounded(F.col(c)).alias(c) for c in ("acc", "tar", "far")), "n_genuine", "n_impostor")


@query(ROLES_SQL + """
, m AS (SELECT avg((coalesce(first_hit, 999) <= 1)::INT) AS p1, avg((coalesce(first_hit, 999) <= 1)::INT) FILTER (q % 2 = 0) AS p2, avg((coalesce(first_hit, 999) <= 1)::INT) FILTER (q % 2 = 1) AS p3 FROM pq)
SELECT round((p1 + p2 + p3) / 3, 6) + 0e0 AS val_score FROM m
""")
def selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.coalesce(F.col("first_hit"), F.lit(999)) <= 1).cast("double")
    m = per_query(spark, sf_dir).agg(F.avg(hit).alias("p1"), F.avg(F.when(F.col("q") % 2 == 0, hit)).alias("p2"), F.avg(F.when(F.col("q") % 2 == 1, hit)).alias("p3"))
    return m.select(rounded((F.col("p1") + F.col("p2") + F.col("p3")) / 3).alias("val_score"))


HISTORY = [(e, round(5.0 / e, 3), None if e % 2 else [0.2, 0.5, 0.4, 0.5, 0.7, 0.6][e // 2 - 1]) for e in range(1, 13)]
HISTORY_SQL = "WITH h(epoch, loss, val_score) AS (VALUES " + ", ".join(f"({e}, {x}::DOUBLE, {'NULL' if v is None else v}::DOUBLE)" for e, x, v in HISTORY) + ")"


def history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HISTORY, "epoch int, loss double, val_score double")


@query(HISTORY_SQL + "SELECT epoch, val_score, coalesce(val_score > max(val_score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS saved FROM h WHERE val_score IS NOT NULL")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.best_epochs(history(spark)).select("epoch", "val_score", "saved")


@query(HISTORY_SQL + "SELECT epoch, loss, val_score FROM h WHERE val_score IS NOT NULL")
def validation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark).where(F.col("val_score").isNotNull())


@query(ROLES_SQL + f"""
, f AS (SELECT *, q % 8 >= 6 AS held FROM pq),
z AS (SELECT {dot_sql('a.vec', 'b.vec')} AS s, a.label = b.label AS same FROM v a JOIN v b ON b.id = a.id + 10)
SELECT (SELECT count(*) FROM gal)::BIGINT AS n_designs, round(avg((coalesce(first_hit, 999) <= 1)::INT), 6) + 0e0 AS p1_r1, round(avg(ap), 6) + 0e0 AS p1_map,
  round(avg((coalesce(first_hit, 999) <= 1)::INT) FILTER (held), 6) + 0e0 AS p1_heldout_r1,
  round(avg((coalesce(first_hit, 999) <= 1)::INT) FILTER (NOT held), 6) + 0e0 AS p1_train_r1, (SELECT round(avg(s), 6) + 0e0 FROM z WHERE same) AS genuine_mean, NULL::DOUBLE AS p4_r1 FROM f
""")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of the numbers a report leads with; what the data lack is null."""
    rows = cut(by_family(per_query(spark, sf_dir)).drop("q_vec"))
    hit = (F.coalesce(F.col("first_hit"), F.lit(999)) <= 1).cast("double")
    held = F.col("family_class") == "heldout"
    one = rows.agg(rounded(F.avg(hit)).alias("p1_r1"), rounded(F.avg("ap")).alias("p1_map"), rounded(F.avg(F.when(held, hit))).alias("p1_heldout_r1"), rounded(F.avg(F.when(~held, hit))).alias("p1_train_r1"))
    genuine = pairs(spark, sf_dir).where("b = a + 10 AND same").agg(rounded(F.avg("s")).alias("genuine_mean"))
    designs = table(spark, sf_dir, "embeddings").agg(F.countDistinct("label").alias("n_designs"))
    return designs.crossJoin(one).crossJoin(genuine).withColumn("p4_r1", F.lit(None).cast("double"))  # three rows of one


@query(f"""
WITH b AS (SELECT vec_id::BIGINT AS id, label::BIGINT AS label, embedding AS vec, vec_id // 64 AS batch_id FROM embeddings WHERE vec_id < (SELECT count(*) FROM embeddings) // 64 * 64),
x AS (SELECT a.batch_id, a.id, a.label = c.label AS pos, {dot_sql('a.vec', 'c.vec')} / 0.07 AS x FROM b a JOIN b c ON a.batch_id = c.batch_id AND a.id <> c.id),
m AS (SELECT batch_id, id, max(x) AS m FROM x GROUP BY 1, 2),
n AS (SELECT batch_id, id, max(m) + ln(sum(exp(x - m))) AS lse, sum(x) FILTER (pos) AS sp, count(*) FILTER (pos) AS np FROM x JOIN m USING (batch_id, id) GROUP BY 1, 2)
SELECT batch_id::BIGINT AS batch_id, round(avg(lse - sp / np), 5) + 0e0 AS loss, count(*)::BIGINT AS n_anchors FROM n WHERE np > 0 GROUP BY 1
""")
def supcon_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), "label", F.col("embedding").alias("vec"))
    return training.contrastive_loss(training.batches(rows, "id", 64)).select("batch_id", rounded(F.col("loss"), 5).alias("loss"), "n_anchors")


@query("SELECT vec_id::BIGINT AS id, (vec_id // 48)::BIGINT AS batch_id, (vec_id % 48)::BIGINT AS slot FROM embeddings WHERE vec_id < (SELECT count(*) FROM embeddings) // 48 * 48")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"))
    return training.batches(rows, "id", 48).select("id", "batch_id", "slot")


@query("SELECT vec_id::BIGINT AS id, label::BIGINT AS label, v::BIGINT AS view FROM embeddings, range(4) t(v)")
def view_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"))
    return training.views(rows, 4).select("id", "label", F.col("view").cast("bigint").alias("view"))


@query("SELECT s AS step, round(CASE WHEN s < 100 THEN 3e-4 * (s + 1) / 100e0 ELSE 3e-4 * 0.5e0 * (1 + cos(pi() * ((s - 100) / 900e0))) END, 9) + 0e0 AS lr FROM range(1000) t(s)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("step"), rounded(training.learning_rate(F.col("id"), 1000, 100, 3e-4), 9).alias("lr"))


VEC_SQL = "WITH v AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def entries_sql(rows: str, column: str, digits: int = 6) -> str:
    """One row an entry."""
    return f"SELECT id, k::BIGINT AS k, round({column}[k], {digits}) + 0e0 AS x FROM (SELECT id, {column}, unnest(range(1, len({column}) + 1)) AS k FROM {rows})"


def entries(rows: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return rows.select("id", F.posexplode(column).alias("k", "x")).select("id", (F.col("k") + 1).cast("bigint").alias("k"), rounded(F.col("x"), digits).alias("x"))


NORM_SQL = "greatest(sqrt(list_reduce(list_transform({0}, lambda x: x * x), lambda p, q: p + q)), 1e-12)"


@query(VEC_SQL + f", n AS (SELECT id, v, {NORM_SQL.format('v')} AS n FROM v), z AS (SELECT id, list_transform(v, lambda x: x / n) AS z FROM n) " + entries_sql("z", "z"))
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), vectors.l2_normalize("embedding").alias("v")), "v")


@query(VEC_SQL + f", f AS (SELECT id, list_transform(range(1, 65), lambda i: v[i] + v[65 - i]) AS f FROM v), n AS (SELECT id, f, {NORM_SQL.format('f')} AS n FROM f), z AS (SELECT id, list_transform(f, lambda x: x / n) AS z FROM n) " + entries_sql("z", "z"))
def tta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirrored view's stand-in is the vector read backwards."""
    return entries(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), vectors.merge_views(F.col("embedding"), F.reverse("embedding")).alias("v")), "v")


@query(VEC_SQL + " SELECT id, round(pow(list_reduce(list_transform(v, lambda x: pow(greatest(x, 1e-6), 3e0)), lambda p, q: p + q) / 64, 1 / 3e0), 6) + 0e0 AS gem FROM v")
def gem_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), rounded(vectors.generalized_mean("embedding")).alias("gem"))


@query(VEC_SQL + " SELECT id, round(list_reduce(v[2:64], lambda p, q: p + q) / 63, 6) + 0e0 AS mean FROM v")
def patch_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), rounded(vectors.token_mean("embedding", 1)).alias("mean"))


HEAD_WIDTHS = (7, 5, 11, 3)


@query(VEC_SQL + f"""
, y AS (SELECT id, [{', '.join(f"(list_reduce(list_transform(range(1, 65), lambda i: v[i] * (((i % {m}) - {m // 2}) / 10e0)), lambda p, q: p + q) + {0.5 - 0.25 * k}e0 - {0.1 * (k + 1):.1f}e0) / sqrt({0.04 * (k + 1) + 1e-5:.5f}e0)" for k, m in enumerate(HEAD_WIDTHS))}] AS y FROM v)
{entries_sql('y', 'y', 5)}
""")
def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a linear layer with batch normalisation."""
    n = len(HEAD_WIDTHS)
    weights = [[((i % m) - m // 2) / 10 for i in range(1, 65)] for m in HEAD_WIDTHS]
    y = vectors.linear_head("embedding", weights, [0.5 - 0.25 * k for k in range(n)], [round(0.1 * (k + 1), 1) for k in range(n)], [0.04 * (k + 1) for k in range(n)])
    return entries(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), y.alias("y")), "y", 5)


@query("SELECT id, batch_id, slot FROM (SELECT id, (k // 48)::BIGINT AS batch_id, (k % 48)::BIGINT AS slot, k, n FROM (SELECT vec_id::BIGINT AS id, row_number() OVER (ORDER BY md5('3-' || vec_id), vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings)) WHERE k < n // 48 * 48")
def batch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one epoch, in its own order."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"))
    return training.shuffled_batches(rows, "id", 48, 3).select("id", "batch_id", "slot")


@query("SELECT (event_id % 12 + 1)::BIGINT AS epoch, round(avg(value), 6) + 0e0 AS loss, count(*)::BIGINT AS n_steps FROM events WHERE value IS NOT NULL GROUP BY 1")
def epoch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean step loss of each epoch; an event's value is a step's loss."""
    steps = table(spark, sf_dir, "events").where("value IS NOT NULL").select((F.col("event_id") % 12 + 1).cast("bigint").alias("epoch"), F.col("value").alias("loss"))
    return training.epoch_losses(steps).select("epoch", rounded(F.col("loss")).alias("loss"), "n_steps")


@query("SELECT doc_id, source FROM documents ORDER BY md5('1-' || doc_id), doc_id LIMIT 6")
def report_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.samples(table(spark, sf_dir, "documents").select("doc_id", "source"), 6, "doc_id", 1)


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({" || '-' || ".join(parts)}), 1, 8))::BIGINT"


@query(f"""
WITH n AS (SELECT count(DISTINCT label) AS n FROM embeddings), i AS (SELECT DISTINCT label::BIGINT AS i FROM embeddings), d AS (SELECT i, {draw_sql("'0'", "i")} % (n - 1) AS j FROM i, n)
SELECT i, j + CASE WHEN j >= i THEN 1 ELSE 0 END AS other FROM d
""")
def other_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("i")).distinct()
    n = ids.count()
    return ids.select("i", specs.other_than(F.col("i"), training.portable_draw("0", F.col("i")) % (n - 1)).alias("other"))


@query(f"""
WITH u AS (SELECT vec_id::BIGINT AS id, {draw_sql("'7'", "vec_id")} / 4294967296e0 AS u FROM embeddings)
SELECT id, CASE WHEN u < 0.08 THEN 'identity' WHEN u < 0.33 THEN 'palette_random' WHEN u < 0.45 THEN 'palette_permute' WHEN u < 0.75 THEN 'palette_transfer' WHEN u < 0.87 THEN 'hsv' WHEN u < 0.95 THEN 'channel' ELSE 'gray' END AS family FROM u
""")
def family_weights_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = training.portable_uniform("7", F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), training.weighted_choice(u, list(specs.FAMILY_WEIGHTS)).alias("family"))


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One design a label, numbered from 0."""
    return ingest.with_position(table(spark, sf_dir, "embeddings").select(F.col("label").alias("l")).distinct(), "l").select(F.col("pos").alias("label"))


SPEC_SQL = f"""
WITH d AS (SELECT dense_rank() OVER (ORDER BY l) - 1 AS label FROM (SELECT DISTINCT label AS l FROM embeddings)), n AS (SELECT count(*) AS n FROM d),
f AS (SELECT k AS ord, [{', '.join(repr(x) for x in specs.FAMILIES)}][k + 1] AS family FROM range(8) t(k)),
s AS (
  SELECT label AS spec_id, 'orig' AS op, 'gallery' AS role, label, NULL AS family, NULL::BIGINT AS seed, NULL::BIGINT AS j FROM d
  UNION ALL SELECT n + label * 8 + ord, 'colorway', 'p1', label, family, {draw_sql("'0'", "'p1'", "label", "ord")} % 2147483648, {draw_sql("'0'", "'donor'", "'p1'", "label", "ord")} % (n - 1) FROM d, n, f
  UNION ALL SELECT n * 9 + label, 'colorway', 'trap', label, 'palette_transfer', {draw_sql("'0'", "'trap'", "label")} % 2147483648, {draw_sql("'0'", "'donor'", "'trap'", "label")} % (n - 1) FROM d, n
  UNION ALL SELECT n * 10 + (r * 2 + e) * n + label, 'palette', 'shared', label, NULL, {draw_sql("'0'", "'shared'", "r", "e", "label")} % 2147483648, NULL FROM d, n, range(3) a(r), range(2) b(e)
)
"""


@query(SPEC_SQL + "SELECT spec_id::BIGINT AS spec_id, op, role, label::BIGINT AS label, family, coalesce(seed, -1)::BIGINT AS seed, coalesce(j + CASE WHEN j >= label THEN 1 ELSE 0 END, -1)::BIGINT AS donor_label FROM s")
def spec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.build(designs(spark, sf_dir)).select("spec_id", "op", "role", "label", "family", F.coalesce("seed", F.lit(-1)).alias("seed"), F.coalesce("donor_label", F.lit(-1)).alias("donor_label"))


@query(SPEC_SQL + "SELECT role, count(*)::BIGINT AS n_specs FROM s GROUP BY role")
def spec_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.build(designs(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("n_specs"))


@query(SPEC_SQL.rsplit("s AS (", 1)[0] + f"""
t AS (SELECT label, n, t, {draw_sql("'0'", "'other'", "label", "t")} % (n - 1) AS j, {draw_sql("'0'", "'same'", "label", "t")} % (n - 1) AS i, {draw_sql("'0'", "'family'", "label", "t")} % 8 AS f, {draw_sql("'0'", "'round'", "label", "t")} % 3 AS r FROM d, n, range(2) x(t)),
o AS (SELECT *, j + CASE WHEN j >= label THEN 1 ELSE 0 END AS other, i + CASE WHEN i >= label THEN 1 ELSE 0 END AS same FROM t)
SELECT 'genuine' AS kind, label::BIGINT AS a, (n + label * 8 + f)::BIGINT AS b FROM o
UNION ALL SELECT 'impostor_random', label, n + other * 8 + f FROM o
UNION ALL SELECT 'impostor_samepal', n * 10 + r * 2 * n + label, n * 10 + r * 2 * n + same FROM o
""")
def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.pairs(designs(spark, sf_dir)).select("kind", "a", "b")


ABLATIONS = (("ours", False, 24, 64), ("gray", True, 24, 48), ("no_bank", False, 0, 32), ("small", False, 24, 8))


@query(ROLES_SQL + ", c(name, gray, bank, dim) AS (VALUES " + ", ".join(f"('{n}', {str(g).lower()}, {b}, {d})" for n, g, b, d in ABLATIONS) + "), " + ", ".join(f"r_{n} AS ({cut_sql(str(d))})" for n, _, _, d in ABLATIONS) + """
, m AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS name, round(avg((coalesce(first_hit, 999) <= 1)::INT), 6) + 0e0 AS r1, round(avg((coalesce(first_hit, 999) <= 5)::INT), 6) + 0e0 AS r5 FROM r_{n}" for n, *_ in ABLATIONS) + """)
SELECT name, gray, bank::INT AS bank, dim::INT AS dim, r1, r5, round(r1 - (SELECT r1 FROM m WHERE name = 'ours'), 6) + 0e0 AS against_ours FROM c JOIN m USING (name)
""")
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run: its configuration and its result file, written by the run and read back, against the first run.

    The runs' stand-ins see that many entries of the vectors.
    """
    root = f"{checkpoint_root(spark).rstrip('/')}/ablation-{uuid.uuid4().hex}"
    for name, gray, bank, dim in ABLATIONS:
        found = ranking.identification(run_of(spark, sf_dir, dim), ks=(1, 5)).first()
        files.write_document(spark, {"name": name, "config": {"gray": gray, "bank": bank, "dim": dim}, "headline": {"r1": found["r1"], "r5": found["r5"]}}, f"{root}/{name}")
    rows = spark.read.schema("name string, config struct<gray:boolean,bank:int,dim:int>, headline struct<r1:double,r5:double>").json(f"{root}/*")
    rows = rows.select("name", "config.*", "headline.*")
    ours = rows.where("name = 'ours'").select(F.col("r1").alias("__ours"))
    return rows.crossJoin(F.broadcast(ours)).select("name", "gray", "bank", "dim", rounded(F.col("r1")).alias("r1"), rounded(F.col("r5")).alias("r5"), rounded(rounded(F.col("r1")) - rounded(F.col("__ours"))).alias("against_ours"))  # one row


@query(ROLLUP_SQL + "SELECT family AS model, round(avg((coalesce(first_hit, 999) <= 1)::INT), 6) + 0e0 AS r1, count(*)::BIGINT AS n_queries FROM f GROUP BY family")
def results_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files written by run, and read back as one table with their stems as names."""
    root = f"{checkpoint_root(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    found = ranking.identification(by_family(per_query(spark, sf_dir)), ("family",), ks=(1,)).select("family", "r1", "n_queries")
    files.write_results(found.withColumnRenamed("family", "model"), root)
    read = spark.read.schema("model string, r1 double, n_queries bigint").json(root)
    return read.select("model", rounded(F.col("r1")).alias("r1"), "n_queries")


@query(f"SELECT b::BIGINT AS bank_id, {draw_sql("'10003'", "'bank'", "b")} % (SELECT count(*) FROM embeddings) AS pos FROM range(12) t(b)")
def bank_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose palettes the real half of an epoch's bank takes, drawn with replacement."""
    n = table(spark, sf_dir, "embeddings").count()
    return training.bank_sources(spark, n, 3, 24)


# ---- the whole protocol run over a table of specifications

RUN_SPECS = SPEC_SQL.rsplit("s AS (", 1)[0] + f"""
dn AS (SELECT label, ord, j + CASE WHEN j >= label THEN 1 ELSE 0 END AS donor FROM (SELECT label, 0 AS ord, {draw_sql("'0'", "'donor'", "'trap'", "label")} % (n - 1) AS j FROM d, n)),
s AS (
  SELECT label AS spec_id, 'gallery' AS role, label, NULL AS family, NULL::BIGINT AS donor, -1 AS rnd, 0 AS side FROM d
  UNION ALL SELECT n + label * 8 + ord, 'p1', label, family, NULL, -1, 1 FROM d, n, f
  UNION ALL SELECT n * 9 + label, 'trap', label, 'palette_transfer', donor, -1, 1 FROM n, dn
  UNION ALL SELECT n * 10 + (r * 2 + e) * n + label, 'shared', label, NULL, NULL, r, e FROM d, n, range(3) a(r), range(2) b(e)
),
base AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT label FROM embeddings) t WHERE t.label < e.label) AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings e WHERE vec_id = (SELECT min(vec_id) FROM embeddings m WHERE m.label = e.label)),
z AS (SELECT s.*, list_transform(range(1, 65), lambda i: b.v[i] + 0.8e0 * x.v[i] + 0.9e0 * coalesce(o.v[i], 0e0)) AS raw FROM s JOIN base b ON b.label = s.label
  JOIN (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) x ON x.vec_id = (s.spec_id * 7 + 3) % (SELECT count(*) FROM embeddings) LEFT JOIN base o ON o.label = s.donor),
vec AS (SELECT * EXCLUDE (raw), list_transform(raw, lambda x: x / {NORM_SQL.format('raw')}) AS vec FROM z),
rk AS (SELECT q.spec_id AS q, q.role, q.family, q.rnd, q.donor, g.label AS g_label, g.label = q.label AS hit, row_number() OVER (PARTITION BY q.spec_id ORDER BY {dot_sql('q.vec', 'g.vec')} DESC, g.spec_id) AS rank
  FROM vec q JOIN vec g ON g.rnd = q.rnd AND g.side = 0 AND q.side = 1),
hi AS (SELECT *, sum(hit::INT) OVER (PARTITION BY q ORDER BY rank) AS hits FROM rk),
pq AS (SELECT q, role, family, rnd, donor, min(rank) FILTER (hit) AS first_hit, sum(CASE WHEN hit THEN hits::DOUBLE / rank ELSE 0 END) / greatest(sum(hit::INT), 1) AS ap, arg_min(g_label, rank) AS top FROM hi GROUP BY 1, 2, 3, 4, 5),
mt AS (SELECT CASE WHEN role = 'p1' THEN 'P1' WHEN role = 'trap' THEN 'P2' ELSE 'P3' END AS protocol, rnd,
    CASE WHEN role = 'trap' THEN 'trap' WHEN role = 'shared' THEN 'shared' ELSE coalesce(family, CASE WHEN grouping(cls) = 0 THEN cls END, 'all') END AS family,
    avg((first_hit <= 1)::INT) AS r1, avg((first_hit <= 5)::INT) AS r5, avg((first_hit <= 10)::INT) AS r10, avg(ap) AS map, avg((top = donor)::INT) AS trap1, count(*)::DOUBLE AS n_queries
  FROM (SELECT * REPLACE (CASE WHEN role = 'p1' THEN family END AS family), CASE WHEN role <> 'p1' THEN NULL WHEN family IN ('curves', 'reinhard') THEN 'heldout' ELSE 'train' END AS cls FROM pq)
  GROUP BY GROUPING SETS ((role, rnd, family), (role, rnd, cls), (role, rnd)) HAVING role = 'p1' OR (grouping(family) = 1 AND grouping(cls) = 1)),
lm AS (SELECT protocol, family, avg(r1) AS r1, avg(r5) AS r5, avg(r10) AS r10, avg(map) AS map, avg(trap1) AS trap1, avg(n_queries) AS n_queries FROM mt GROUP BY 1, 2),
t AS (SELECT label, n, {draw_sql("'0'", "'other'", "label", "t")} % (n - 1) AS j, {draw_sql("'0'", "'same'", "label", "t")} % (n - 1) AS i, {draw_sql("'0'", "'family'", "label", "t")} % 8 AS f, {draw_sql("'0'", "'round'", "label", "t")} % 3 AS r FROM d, n, range(2) x(t)),
o AS (SELECT *, j + CASE WHEN j >= label THEN 1 ELSE 0 END AS other, i + CASE WHEN i >= label THEN 1 ELSE 0 END AS same FROM t),
pr AS (SELECT 'genuine' AS kind, label AS a, n + label * 8 + f AS b FROM o UNION ALL SELECT 'impostor_random', label, n + other * 8 + f FROM o UNION ALL SELECT 'impostor_samepal', n * 10 + r * 2 * n + label, n * 10 + r * 2 * n + same FROM o),
ps AS (SELECT kind, kind = 'genuine' AS same, {dot_sql('x.vec', 'y.vec')} AS s FROM pr JOIN vec x ON x.spec_id = a JOIN vec y ON y.spec_id = b),
vs AS (SELECT 'all' AS family, s, same FROM ps UNION ALL SELECT 'samepalette', s, same FROM ps WHERE kind <> 'impostor_random'),
c AS (SELECT family, s, count(*) FILTER (same) AS tp, count(*) FILTER (NOT same) AS fp FROM vs GROUP BY 1, 2),
r AS (SELECT family, row_number() OVER w AS k, s, tp AS own_tp, fp AS own_fp, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(tp) OVER (PARTITION BY family) AS n_pos, sum(fp) OVER (PARTITION BY family) AS n_neg FROM c WINDOW w AS (PARTITION BY family ORDER BY s DESC)),
w AS (SELECT *, lead(own_tp) OVER (PARTITION BY family ORDER BY k) AS next_tp, lead(own_fp) OVER (PARTITION BY family ORDER BY k) AS next_fp FROM r),
x AS (SELECT family, k, s, tp, fp, n_pos, n_neg FROM w WHERE next_tp IS NULL OR next_tp <> own_tp OR next_fp <> own_fp UNION ALL SELECT family, 0, 'inf'::DOUBLE, 0, 0, max(n_pos), max(n_neg) FROM r GROUP BY family),
e AS (SELECT family, arg_min(struct_pack(eer := ((1 - tp / n_pos::DOUBLE) + fp / n_neg::DOUBLE) / 2, t := s), struct_pack(d := abs((1 - tp / n_pos::DOUBLE) - fp / n_neg::DOUBLE), k := k)) AS m,
  coalesce(max(tp / n_pos::DOUBLE) FILTER (fp / n_neg::DOUBLE <= 0.01), 0) AS tar_0, coalesce(max(tp / n_pos::DOUBLE) FILTER (fp / n_neg::DOUBLE <= 0.001), 0) AS tar_1 FROM x GROUP BY family),
au AS (SELECT family, sum(own_fp * (tp - own_tp / 2e0)) / (max(n_pos)::DOUBLE * max(n_neg)) AS auc FROM r GROUP BY family),
sd AS (SELECT kind, avg(s) AS mean, stddev_pop(s) AS std FROM ps GROUP BY kind),
l AS (
  """ + " UNION ALL ".join(f"SELECT protocol, family, '{m}' AS metric, {m} AS value FROM lm" for m in ("r1", "r5", "r10", "map", "n_queries")) + """
  UNION ALL SELECT protocol, family, 'trap1', trap1 FROM lm WHERE protocol = 'P2'
  UNION ALL SELECT 'verification', family, 'auc', auc FROM au UNION ALL SELECT 'verification', family, 'eer', m.eer FROM e UNION ALL SELECT 'verification', family, 'threshold', m.t FROM e
  UNION ALL SELECT 'verification', family, 'tar_0', tar_0 FROM e UNION ALL SELECT 'verification', family, 'tar_1', tar_1 FROM e
  UNION ALL SELECT 'scores', kind, 'mean', mean FROM sd UNION ALL SELECT 'scores', kind, 'std', std FROM sd
)
"""


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All protocols over the specifications of the labels; a specification's vector is its label's first one, noise, and for traps the donor's."""
    spec = cut(specs.build(designs(spark, sf_dir)))
    emb = table(spark, sf_dir, "embeddings")
    first = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    base = ingest.with_position(first, "label").select(F.col("pos").alias("label"), "v")
    noise = emb.select(F.col("vec_id").alias("__noise"), F.col("embedding").alias("z"))
    trap = F.when(F.col("role") == "trap", F.col("donor_label"))
    rows = spec.select("spec_id", "label", trap.alias("__donor"), ((F.col("spec_id") * 7 + 3) % emb.count()).alias("__noise")).join(base, "label").join(noise, "__noise")
    rows = rows.join(base.select(F.col("label").alias("__donor"), F.col("v").alias("o")), "__donor", "left")
    zero = F.array_repeat(F.lit(0.0), 64)
    mixed = F.zip_with(F.zip_with("v", "z", lambda a, b: a.cast("double") + 0.8 * b.cast("double")), F.coalesce(F.col("o").cast("array<double>"), zero), lambda a, b: a + 0.9 * b)
    vecs = rows.select("spec_id", vectors.l2_normalize(mixed).alias("embedding"))
    return benchmark.protocols(spec, specs.pairs(designs(spark, sf_dir)), vecs).where("protocol <> 'P4'")


@query(RUN_SPECS + "SELECT protocol, family, metric, round(value, 6) + 0e0 AS value FROM l")
def run_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_metrics(spark, sf_dir).select("protocol", "family", "metric", rounded(F.col("value")).alias("value"))


@query(RUN_SPECS + "SELECT " + ", ".join(f"round(max(value) FILTER (protocol = '{p}' AND family = '{f}' AND metric = '{m}'), 6) + 0e0 AS {n}" for n, (p, f, m) in benchmark.HEADLINE.items()) + " FROM l")
def run_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that a report leads with, of the same run."""
    head = benchmark.headline(run_metrics(spark, sf_dir))
    return head.select(*(rounded(F.col(c)).alias(c) for c in head.columns))
