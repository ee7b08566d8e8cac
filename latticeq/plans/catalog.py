"""Queries over files and documents: scan, naming, ingest, groups, split, manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_root, cut
from ..functions import hashing
from ..operators import groups, ingest
from ..sources import files

QUERIES: dict = {}
ORACLE_SQL: dict = {}
NEAR_BITS = 6
FURTHER = 1_000_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


@query(r"""
SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, lower(regexp_extract(url, '.(\.[^./]+)$', 1)) AS suffix
FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/]+)', 1) LIKE '%.com'
""")
def scan_filter_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return table(spark, sf_dir, "pages").where(host.endswith(".com")).select("page_id", "url", host.alias("host"), F.lower(F.regexp_extract("url", r".(\.[^./]+)$", 1)).alias("suffix"))


@query(r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '_jpg.rf.' || page_id || '.jpg' ELSE url END AS path FROM pages),
n AS (SELECT page_id, path, split_part(path, '/', -1) AS name, split_part(path, '/', 3) AS source FROM p)
SELECT page_id, name, split_part(name, '.rf.', 1) AS stem,
  CASE WHEN contains(path, '.rf.') THEN source || '/' || split_part(name, '.rf.', 1) ELSE path END AS key,
  split_part(path, '/', -2) AS folder
FROM n
""")
def source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("_jpg.rf."), F.col("page_id").cast("string"), F.lit(".jpg"))).otherwise(F.col("url"))
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    c = F.col("path")
    return p.select("page_id", ingest.base_name(c).alias("name"), ingest.source_stem(c).alias("stem"), ingest.source_key(F.split_part(c, F.lit("/"), F.lit(3)), c).alias("key"), ingest.parent_name(c).alias("folder"))


@query("""
WITH r AS (SELECT DISTINCT CASE WHEN source IN ('src1', 'src2') THEN '/data/' || source || '/versions/3' ELSE '/data/' || source END AS root FROM documents)
SELECT root, CASE WHEN regexp_matches(root, '/versions/[0-9]+/?$') THEN split_part(root, '/', -3) ELSE split_part(root, '/', -1) END AS source FROM r
""")
def source_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.concat(F.lit("/data/"), F.col("source"), F.when(F.col("source").isin("src1", "src2"), "/versions/3").otherwise(""))
    return table(spark, sf_dir, "documents").select(root.alias("root")).distinct().select("root", ingest.source_name(F.col("root")).alias("source"))


@query("""
SELECT DISTINCT array_to_string(string_split(url, '/')[1:4], '/') AS root FROM pages
""")
def root_prefix_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.root_prefixes(table(spark, sf_dir, "pages"), "url", 4)


@query("""
SELECT doc_id, source, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1
""")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    return ingest.distinct_first(docs, F.col("digest"), "doc_id").select("doc_id", "source", "digest")


STATUS_SQL = """
WITH f AS (SELECT doc_id, source, n_chars, md5(text) AS digest, CASE WHEN coalesce(text, '') = '' OR contains(text, '***') THEN 'bad' WHEN n_chars < 96 THEN 'small' END AS flaw FROM documents),
k AS (SELECT *, coalesce(flaw, CASE WHEN row_number() OVER (PARTITION BY digest, flaw IS NULL ORDER BY doc_id) = 1 THEN 'kept' ELSE 'dup' END) AS status FROM f)
"""


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: an asterisk run or no text is undecodable, the character count is the short side."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("digest"), (F.col("text").isNotNull() & (F.col("text") != "") & ~F.col("text").contains("***")).alias("usable"))
    return ingest.classify(docs, F.col("digest"), F.col("n_chars"), F.col("usable"), F.col("doc_id"))


@query(STATUS_SQL + " SELECT doc_id, status FROM k")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status(spark, sf_dir).select("doc_id", "status")


@query(STATUS_SQL + " SELECT count(*) FILTER (status = 'kept')::BIGINT AS n_kept, count(*) FILTER (status = 'bad')::BIGINT AS n_bad, count(*) FILTER (status = 'small')::BIGINT AS n_small, count(*) FILTER (status = 'dup')::BIGINT AS n_dup FROM k")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counters(status(spark, sf_dir))


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars >= 96")
def filter_min_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("n_chars") >= ingest.MIN_SIDE).select("doc_id", "source", "n_chars")


def _orientation_sql() -> str:
    out = []
    for k in range(8):
        cells = ", ".join(f"{'-' if s < 0 else ''}v[{i + 1}]" for i, s in hashing.orientation_index(k))
        out.append(f"SELECT pos, {k} AS o, [{cells}] AS c FROM e")
    return " UNION ALL ".join(out)


#: Every third vector has a further photo: mirrored, in steps of 0.05, under an id of its own.
PHOTOS_SQL = f"""e AS (SELECT vec_id AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  UNION ALL SELECT vec_id + {FURTHER}, list_transform(range(1, 65), lambda i: CASE WHEN i % 2 = 0 THEN -1e0 ELSE 1e0 END * (floor(embedding[i]::DOUBLE * 20e0 + 0.5e0) / 20e0)) FROM embeddings WHERE vec_id % 3 = 0)"""
#: Hashes as two halves, since a signed integer cannot be shifted into its top bit there.
HASH_SQL = f"""
WITH RECURSIVE {PHOTOS_SQL},
t AS ({_orientation_sql()}),
b AS (SELECT pos, o, c, list_sort(c[2:64])[32] AS m FROM t),
h AS (SELECT pos, o,
  list_sum(list_transform(range(1, 33), lambda i: CASE WHEN c[i] > m THEN 1::BIGINT << (32 - i) ELSE 0 END))::BIGINT AS hi,
  list_sum(list_transform(range(33, 65), lambda i: CASE WHEN c[i] > m THEN 1::BIGINT << (64 - i) ELSE 0 END))::BIGINT AS lo FROM b),
d AS (SELECT a.pos AS a, b.pos AS b, min(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::BIGINT AS distance
  FROM h a JOIN h b ON a.pos < b.pos AND b.o = 0 WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {NEAR_BITS} GROUP BY 1, 2)
"""


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("v"))
    steps = F.transform("v", lambda x, i: F.when(i % 2 == 1, -1.0).otherwise(1.0) * (F.floor(x * 20.0 + 0.5).cast("double") / 20.0))
    photos = first.unionByName(first.where("pos % 3 = 0").select((F.col("pos") + FURTHER).alias("pos"), steps.alias("v")))
    return photos.select("pos", hashing.hashes("v").alias("hash"))


@query(HASH_SQL + " SELECT pos, o, hi, lo FROM h")
def phash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashed(spark, sf_dir).select("pos", F.posexplode("hash").alias("o", "h"))
    return h.select("pos", "o", hashing.high_half(F.col("h")).alias("hi"), hashing.low_half(F.col("h")).alias("lo"))


@query(HASH_SQL + " SELECT a, b, distance FROM d")
def near_dup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.near_pairs_full(cut(hashed(spark, sf_dir)), NEAR_BITS).select("a", "b", F.col("distance").cast("bigint").alias("distance"))


@query("SELECT first AS a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents) WHERE doc_id > first")
def near_dup_edges_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.md5("text").alias("key"))
    return groups.key_edges(docs, "key")


GROUP_SQL = HASH_SQL + """
, bi AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
reach AS (SELECT pos AS n, pos AS m FROM e UNION SELECT bi.b, reach.m FROM reach JOIN bi ON bi.a = reach.n),
roots AS (SELECT n AS pos, min(m) AS root FROM reach GROUP BY n),
g AS (SELECT pos, root, (dense_rank() OVER (ORDER BY root) - 1)::BIGINT AS grp FROM roots)
"""


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(hashed(spark, sf_dir))
    return cut(groups.dense_groups(groups.group_roots(rows, hashing.near_pairs(rows, NEAR_BITS))))


@query(GROUP_SQL + " SELECT pos, grp FROM g")
def components_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).select("pos", F.col("group").alias("grp"))


@query(GROUP_SQL + " SELECT count(*)::BIGINT AS n_rows, count(DISTINCT grp)::BIGINT AS n_groups, (SELECT count(*) FROM (SELECT grp FROM g GROUP BY grp HAVING count(*) > 1))::BIGINT AS n_multi FROM g")
def group_sizes_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = grouped(spark, sf_dir).groupBy("group").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_multi"))


@query(GROUP_SQL + " SELECT pos, grp FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS k FROM g) WHERE k = 1")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.representatives(grouped(spark, sf_dir)).where("is_rep").select("pos", F.col("group").alias("grp"))


@query(GROUP_SQL + " SELECT pos, grp FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS k FROM g) WHERE k > 1")
def rephotos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.representatives(grouped(spark, sf_dir)).where("NOT is_rep").select("pos", F.col("group").alias("grp"))


SPLIT_SQL = GROUP_SQL + """
, o AS (SELECT grp, row_number() OVER (ORDER BY md5('0-' || grp), grp) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM g)),
s AS (SELECT grp, CASE WHEN k < floor(n * 0.7::DOUBLE) THEN 'train' WHEN k < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o)
"""


def with_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(spark, sf_dir)
    return rows.join(cut(groups.split_groups(rows)), "group")


@query(SPLIT_SQL + " SELECT split, count(*)::BIGINT AS n_rows, count(DISTINCT grp)::BIGINT AS n_groups FROM g JOIN s USING (grp) GROUP BY split")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("group").alias("n_groups"))


@query(SPLIT_SQL + " SELECT count(*)::BIGINT AS n_groups, count(*) FILTER (n > 1)::BIGINT AS n_leaks FROM (SELECT grp, count(DISTINCT split) AS n FROM g JOIN s USING (grp) GROUP BY grp)")
def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = with_split(spark, sf_dir).groupBy("group").agg(F.countDistinct("split").alias("n"))
    return per.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_leaks"))


@query("""
SELECT source, count(*) FILTER (k >= 2)::BIGINT AS train, count(*) FILTER (k = 1)::BIGINT AS val, count(*) FILTER (k = 0)::BIGINT AS test
FROM (SELECT source, doc_id % 10 AS k FROM documents) GROUP BY source
""")
def source_split_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 10
    split = F.when(k == 0, "test").when(k == 1, "val").otherwise("train")
    return table(spark, sf_dir, "documents").withColumn("split", split).groupBy("source").pivot("split", ["train", "val", "test"]).count().fillna(0)


@query("SELECT '/data/' || doc_id AS path, source, doc_id::BIGINT AS \"group\", CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM documents")
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 10
    path = F.concat(F.lit("/data/"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), path.alias("path"), "source", path.alias("orig"), F.col("doc_id").alias("group"), F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("split"))
    to = f"{checkpoint_root(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    files.write_manifest(rows, to)
    sides = [files.read_manifest(spark, to, name) for name in ("train", "val", "test")]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


@query("""
SELECT doc_id, h, w,
  CASE WHEN 320 >= least(h, w) THEN h ELSE round_even(h * (320::DOUBLE / least(h, w)), 0)::BIGINT END AS new_h,
  CASE WHEN 320 >= least(h, w) THEN w ELSE round_even(w * (320::DOUBLE / least(h, w)), 0)::BIGINT END AS new_w
FROM (SELECT doc_id, n_chars % 1000 + 100 AS h, doc_id % 700 + 200 AS w FROM documents)
""")
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 1000 + 100).alias("h"), (F.col("doc_id") % 700 + 200).alias("w"))
    scale = F.lit(320.0) / F.least("h", "w")
    return d.select("doc_id", "h", "w", *(F.when(F.least("h", "w") <= 320, F.col(c)).otherwise(F.bround(F.col(c) * scale).cast("bigint")).alias(f"new_{c}") for c in "hw"))


@query("""
SELECT doc_id, h, w, (h - 224) // 2 AS top, (w - 224) // 2 AS "left" FROM (SELECT doc_id, n_chars % 1000 + 224 AS h, doc_id % 700 + 224 AS w FROM documents)
""")
def crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 1000 + 224).alias("h"), (F.col("doc_id") % 700 + 224).alias("w"))
    return d.select("doc_id", "h", "w", F.expr("(h - 224) div 2").alias("top"), F.expr("(w - 224) div 2").alias("left"))


@query("""
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN '/data/a' ELSE '/data/b/versions/2' END AS root FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, (row_number() OVER (ORDER BY page_id % 2, url, page_id) - 1)::BIGINT AS pos FROM p
""")
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two roots in (root, path) order, each with its place and its root's source name."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 2).alias("root_ord"))
    root = F.when(F.col("root_ord") == 0, "/data/a").otherwise("/data/b/versions/2")
    return ingest.with_position(p.withColumn("source", ingest.source_name(root)), "root_ord", "url", "page_id").select("page_id", "source", "pos")


@query(r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/gallery/p' || page_id || '.v2.PNG' ELSE '/gallery/d' || page_id % 7 || '/p' || page_id || '.jpg' END AS path FROM pages)
SELECT page_id, path, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id || '.v2' ELSE 'd' || page_id % 7 END AS label FROM p
""")
def gallery_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of gallery files: the folder, or the stem of a file directly in the root."""
    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/gallery/p"), i, F.lit(".v2.PNG"))).otherwise(F.concat(F.lit("/gallery/d"), (F.col("page_id") % 7).cast("string"), F.lit("/p"), i, F.lit(".jpg")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("label", ingest.folder_label(F.col("path"), "/gallery/"))
