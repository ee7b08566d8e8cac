"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds. Four kinds are found by their form (email, ip, card, phone; the *base* spans), and a fifth by a cue word
   before it (``secret``: ``token = "..."`` and the like).
2. Patterns. Each seed and each other identifier-like word (letters, digits and single separators between them, of
   eight characters or more, four of them digits, of any length) gives two lexical patterns: what stands to its left,
   and its shape.
3. Graph. Patterns and the distinct strings they occur with make a bipartite graph. Spark scores it in rounds: a
   pattern is as sure as its strings are on average (with a prior against rare patterns), a string as its patterns
   are together; seeds stay sure. Scores only rise from round to round; rounds go on until none rises by more than
   ``STILL``.
4. Discovery. Strings that a high-confidence pattern with enough distinct seeds vouches for become ``found`` spans.

A base span never changes. Positions are code points, the end is exclusive.

The patterns are written so that Java matches them in linear time and without recursion: runs are possessive and
start only where a leftmost match of the plain pattern can start.

Defined cases: a null text is empty; rows with equal id and text share their spans; null ids keep theirs; equal
spans of two kinds both count; other columns, whatever their names, pass through :func:`redact` and are not looked at
elsewhere; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_names, release

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("secret", "found")
#: kind: (cheap test that a text may have one, pattern, test of a match)
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A word with a digit, tried only where a word begins, so that no part of a text is read twice.
CANDIDATE = r"(?<![A-Za-z0-9_])(?<![A-Za-z0-9_][-.:/])(?:[A-Za-z_]++[-.:/]?+)*+[0-9][A-Za-z0-9_]*+(?:[-.:/][A-Za-z0-9_]++)*+"
LEAST_CHARS, LEAST_DIGITS = 8, 4
CUE = r"(?:^|[^a-z])(?:token|secret|password|passwd|pwd|apikey|api_key|api-key|access_key|access-key|credential)\s*[=:]\s*[\"'(\[]?$"
LEFT = r"(\S{1,24}\s*(?:[=:]\s*)?[\"'(\[]?)$"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
STILL = 0.005
SURE = 0.7
LEAST_SEEDS = 5
PRIOR = 2.0
LEAST_TRUST = 0.05
SALTS = 8


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def value(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        w = F.when(i % 2 == 0, v * 2).otherwise(v)
        return F.when(w > 9, w - 9).otherwise(w)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _tested(kind: str) -> Callable[[Column], Column]:
    return lambda s: _passes(kind, s["text"])


SPAN = "array<struct<kind:string,start:int,end:int,text:string>>"


def located(text: Column, pattern: str, kind: str | None, may: Column) -> Column:
    """Spans of the leftmost non-overlapping matches: a match starts behind the gaps and matches before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    starts = F.aggregate(sizes, begin, lambda s, z: F.struct((s["at"] + z["g"] + z["m"]).alias("at"), F.array_append(s["starts"], s["at"] + z["g"]).alias("starts")), lambda s: s["starts"])
    spans = F.zip_with(starts, found, lambda s, m: F.struct(F.lit(kind).cast("string").alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("text")))
    return F.when(may, spans).otherwise(F.array()).cast(SPAN)


def base_spans(text: Column) -> dict[str, Column]:
    """The four kinds' spans, in the order of their start."""
    out = {}
    for kind, (test, pattern) in PATTERNS.items():
        may = text.contains(test) if kind == "email" else text.rlike(test)
        out[kind] = F.filter(located(text, pattern, kind, may), _tested(kind))
    return out


def _key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _context(text: Column, span: Column) -> Column:
    before = F.substring(text, F.greatest(span["start"] - 31, F.lit(1)), F.least(span["start"], F.lit(32)))
    return F.lower(before)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, email, ip, card, phone, others``: spans by kind; ``others`` are identifier-like words.

    Every span carries the lower-cased characters before it, so the text is read once and not carried on.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    kinds = base_spans(t)
    d = d.select("doc_id", "t", *(c.alias(k) for k, c in kinds.items()), located(t, CANDIDATE, None, t.rlike("[0-9]")).alias("others"))

    def with_left(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), _context(t, s).alias("left")))

    def word(s: Column) -> Column:
        return (F.length(s["text"]) >= LEAST_CHARS) & (F.length(_digits(s["text"])) >= LEAST_DIGITS)

    d = d.withColumn("others", F.filter("others", word))
    return d.select("doc_id", _key(t).alias("key"), *(with_left(F.col(k)).alias(k) for k in [*KINDS, "others"]))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _shape(text: Column) -> Column:
    low, n = F.lower(text), F.length(text).cast("string")
    return (
        F.when(low.rlike("^[0-9]+$"), F.concat(F.lit("9{"), n, F.lit("}")))
        .when(low.rlike("^[0-9a-f]+$"), F.concat(F.lit("x{"), n, F.lit("}")))
        .otherwise(F.left(F.regexp_replace(F.regexp_replace(low, "[a-z]+", "a"), "[0-9]+", "9"), F.lit(64)))
    )


def occurrences(scanned: DataFrame) -> DataFrame:
    """One row per seed and per other identifier-like word that no base span touches; ``kind`` is null for the latter."""
    base = F.flatten(F.array(*(F.col(k) for k in KINDS)))
    free = F.filter("others", lambda s: ~F.exists(base, lambda b: _overlaps(s, b)))
    told = F.transform(free, lambda s: F.struct(F.when(s["left"].rlike(CUE), F.lit("secret")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["left"].alias("left")))
    rows = scanned.select("doc_id", "key", F.explode(F.concat(base, told)).alias("s"))
    left = F.regexp_replace(F.regexp_extract(F.col("s.left"), LEFT, 1), "[0-9]", "9")
    return rows.select("doc_id", "key", "s.kind", "s.start", "s.end", F.xxhash64(F.lower("s.text")).alias("instance"), F.array(F.concat(F.lit("L:"), left), F.concat(F.lit("S:"), _shape(F.col("s.text")))).alias("patterns"))


def score_graph(occ: DataFrame, sure: float = SURE, least_seeds: int = LEAST_SEEDS, still: float = STILL) -> DataFrame:
    """``instance`` of every string that is no seed and that a high-confidence pattern vouches for.

    A pattern's rows are dealt by a salt as well, so that a shape that most strings have is no single task's.
    """
    salt = F.pmod(F.xxhash64(F.lit(3), "instance"), F.lit(SALTS)).cast("int")
    edges = occ.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max(F.col("kind").isNotNull().cast("double")).alias("seed"))
    edges = cut(edges.withColumn("salt", salt))
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    strings, before = cut(seeds.withColumn("sure", F.col("seed")).withColumn("strong", F.lit(False))), None
    while True:
        own = edges.join(strings.select("instance", "sure"), "instance")
        patterns = own.groupBy("pattern").agg((F.sum("sure") / (F.count("*") + PRIOR)).alias("trust"), F.sum("seed").alias("seeds"))
        patterns = cut(patterns.where((F.col("trust") > LEAST_TRUST) & (F.col("seeds") >= 1)))
        rise = F.max("trust") if before is None else F.max(F.col("trust") - F.coalesce("was", F.lit(0.0)))
        moved = patterns if before is None else patterns.join(before, "pattern", "left")
        if (moved.agg(rise).first()[0] or 0.0) <= still:
            return strings.where((F.col("seed") == 0) & F.col("strong") & (F.col("sure") >= sure)).select("instance")
        before = patterns.select("pattern", F.col("trust").alias("was"))
        strong = (F.col("trust") >= sure) & (F.col("seeds") >= least_seeds)
        back = edges.join(patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pattern", "salt"])
        joint = back.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))).alias("joint"), F.max(strong).alias("strong"))
        strings = seeds.join(joint, "instance", "left")
        strings = cut(strings.select("instance", "seed", F.greatest("seed", F.coalesce("joint", F.lit(0.0)) * 0.99).alias("sure"), F.coalesce("strong", F.lit(False)).alias("strong")))
        release(occ.sparkSession)


def discovered(scanned: DataFrame) -> DataFrame:
    """``doc_id, key, extra``: the ``secret`` and ``found`` spans of each text that has any, in the order of start."""
    occ = cut(occurrences(scanned))
    new = score_graph(occ)
    others = occ.where(F.col("kind").isNull()).join(new, "instance", "left_semi").select("doc_id", "key", F.lit("found").alias("kind"), "start", "end")
    rows = occ.where("kind = 'secret'").select("doc_id", "key", "kind", "start", "end").unionByName(others)
    span = F.struct("start", "end", "kind")
    return rows.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(span)).alias("extra"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base spans by kind, and ``extra``: one row per row of ``docs``."""
    scanned = cut(scan(docs, id_col, text_col))
    more = discovered(scanned).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "extra")
    return scanned.join(more, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left").select("doc_id", "key", *KINDS, F.coalesce("extra", F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("extra"))


def _written(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; same columns, ``chars_col`` follows the text.

    Of spans that overlap, the one that starts first stands (the longer of two that start together). Only texts
    with a digit or an at sign are exchanged; all others cannot hold a span and pass by.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    may = text.rlike("[0-9@]")
    names = docs.columns
    key, spans, told_id, told_key = free_names(names, "pii_key", "pii_spans", "pii_told_id", "pii_told_key")
    found = find(docs.where(may), id_col, text_col)
    flat = F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind"))) for k in (*KINDS, "extra")))
    told = found.select(F.col("doc_id").alias(told_id), F.col("key").alias(told_key), F.sort_array(flat).alias(spans)).where(F.size(spans) > 0).dropDuplicates([told_id, told_key])
    some = docs.where(may).withColumn(key, _key(text)).join(told, F.col(f"`{id_col}`").eqNullSafe(F.col(told_id)) & (F.col(key) == F.col(told_key)), "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        put = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct((-x["stop"]).alias("at"), put.alias("out")))

    made = F.aggregate(F.col(spans), begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    kind = docs.schema[text_col].dataType
    some = some.withColumn(text_col, F.when(F.col(spans).isNotNull(), made.cast(kind)).otherwise(F.col(f"`{text_col}`")))
    if chars_col in names:
        some = some.withColumn(chars_col, F.when(F.col(spans).isNotNull(), F.length(F.col(text_col)).cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"`{chars_col}`")))
    return some.select(*(F.col(f"`{c}`") for c in names)).unionByName(docs.where(~may))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 2 over all documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*(_written(F.col(k)) for k in KINDS))
    extra = F.concat(*(_written(F.filter("extra", _of_kind(k))) for k in EXTRA))
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, extra), ",").alias("spans"),
    )
