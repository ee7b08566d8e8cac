"""Line-first quality rules.

Every line of a text is judged by itself; lines that fail a rule are removed, and a document that loses
more than ``max_loss`` of its word characters that way is rejected. The whole-document base rules (too few
words, too much repetition) are evaluated on the text as it came.

Boilerplate is counted, not listed: a line is one if it stands between different neighbours in at least one of
``boilerplate_share`` documents (and ``boilerplate_least`` times). Copies of a document repeat its lines between the
same neighbours, so they make no line common. Such lines are at most ``boilerplate_share`` times as many as a
document has lines on average, however many documents there are; their hashes are what reaches the workers.

Defined cases: a null text has no words and fails the base rules; so does an empty one. Null ids, repeated
rows and extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, column_index, in_slices, map_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
NOISE = re.compile(r"[#*$%&!|<>~^=]{2,}")
NAV_MARKS = frozenset(("|", "»", "«", "›", "·", "•", "/", ">", "::"))
BULLET = re.compile(r"[\x20\x09-\x0D]*[-*•‣◦▪–]")
CUT_OFF = re.compile(r"(?:…|\.\.\.)[\x20\x09-\x0D]*\Z")
SEED = 42


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of a line's words, but ``max_loss`` is of the document's word characters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    noise_share: float = 0.3
    nav_share: float = 0.15
    nav_least: int = 2
    one_word_share: float = 0.5
    one_word_least: int = 10
    shout_least: int = 5
    bullet_most_words: int = 6
    boilerplate_most_words: int = 30
    boilerplate_share: int = 1000
    boilerplate_least: int = 10
    max_loss: float = 0.5


def common_lines(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> frozenset[int]:
    """Hashes of the lines that stand between different neighbours in many texts, counted over all of ``docs``."""
    lines = F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "\n", -1)
    place = F.sequence(F.lit(0), F.size("lines") - 1)

    def at(i: Column) -> Column:
        between = F.xxhash64(F.get("lines", i - 1), F.lit(0), F.get("lines", i + 1))
        return F.struct(F.xxhash64(F.col("lines")[i]).alias("line"), between.alias("between"), F.col("lines")[i].rlike(WORD.pattern).alias("any"))

    rows = docs.select(lines.alias("lines")).select(F.explode(F.transform(place, at)).alias("at")).where("at.any").select("at.line", "at.between")
    least = max(rules.boilerplate_least, docs.count() / rules.boilerplate_share)
    found = rows.distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return frozenset(found.select("line").toArrow().column(0).to_pylist())


def line_hash(line: str) -> int:
    """The hash that Spark's ``xxhash64`` gives a line."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(line.encode("utf-8", "surrogatepass"), SEED)
    return h - (1 << 64) if h >> 63 else h


def line_fault(line: str, words: list[str], seen: bool, rules: Rules = Rules(), common: frozenset[int] = frozenset()) -> str | None:
    """The first rule that the line fails, or None.

    ``seen``: an equal line stood before it in the text. ``common``: what :func:`common_lines` found.
    """
    n = len(words)
    if not n:
        return None
    if seen:
        return "repeated"
    if NOISE.search(line) and sum(1 for w in words if NOISE.search(w)) > rules.noise_share * n:
        return "punctuation"
    if CUT_OFF.search(line):
        return "cut off"
    if n <= rules.bullet_most_words and BULLET.match(line):
        return "bullet"
    marks = sum(1 for w in words if w in NAV_MARKS)
    if marks >= rules.nav_least and marks > rules.nav_share * n:
        return "navigation"
    if n >= rules.shout_least and line.isupper():
        return "shouting"
    if n >= rules.one_word_least and len(set(words)) <= n * rules.one_word_share and Counter(words).most_common(1)[0][1] > rules.one_word_share * n:
        return "one word"
    if common and n <= rules.boilerplate_most_words and line_hash(line) in common:
        return "boilerplate"
    return None


def repeat_words(words: list[str]) -> int:
    """Words that stand in a 3-word window found twice or more, each word once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def judge(text: str | None, rules: Rules = Rules(), common: frozenset[int] = frozenset()) -> dict:
    """All measures of one text, the cleaned text and the verdict."""
    text = text or ""
    words: list[str] = []
    left: list[str] = []
    seen: set[str] = set()
    n_dup = lost = 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        again = bool(own) and line in seen
        if own:
            seen.add(line)
            n_dup += again
        if line_fault(line, own, again, rules, common):
            lost += sum(map(len, own))
        else:
            left.append(line)
        words += own
    chars = sum(map(len, words))
    repeats = repeat_words(words)
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": not failed and lost <= rules.max_loss * chars,
        "lost_chars": lost,
        "cleaned": "\n".join(left),
    }


MEASURES = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64()), ("cleaned", pa.string())]
)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: the measures, the verdict and, if ``with_text``, the cleaned text."""
    names = MEASURES.names[1 : None if with_text else -1]
    schema = pa.schema([MEASURES.field(n) for n in ["doc_id", *names]])
    common = common_lines(docs, text_col, rules)

    def make():
        def work(ids, texts):
            found = [judge(t, rules, common) for t in texts]
            return [ids, *([x[n] for x in found] for n in names)]

        return work

    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}
    ddl = ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)
    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"cast(`{text_col}` as string) AS text").mapInArrow(arrow_rows(make, schema), ddl)


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 8 over all documents."""
    found = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return found.drop("lost_chars")


def keep_clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """``docs`` without the rejected rows and without the failed lines; same columns, ``chars_col`` follows the text."""
    common = common_lines(docs, text_col, rules)

    at = column_index(docs.columns, text_col)
    lower = [c.lower() for c in docs.columns]
    chars = lower.index(chars_col.lower()) if chars_col.lower() in lower else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches):
            found = [judge(t, rules, common) for t in piece.column(at).to_pylist()]
            columns = list(piece.columns)
            columns[at] = pa.array([x["cleaned"] for x in found], piece.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array([len(x["cleaned"]) for x in found], pa.int64()).cast(piece.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=piece.schema).filter(pa.array([x["kept"] for x in found], pa.bool_()))

    return map_rows(docs, run)


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
wi AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM ws WHERE len(w) > 2)),
wc AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM wi),
rp AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM wc WHERE n > 1) GROUP BY r),
ln AS (SELECT r, k, parts[k] AS line FROM (SELECT r, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT r, string_split(text, chr(10)) AS parts FROM d))),
lw AS (SELECT r, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, row_number() OVER (PARTITION BY r, line ORDER BY k) AS seen,
  lag(line) OVER (PARTITION BY r ORDER BY k) AS above, lead(line) OVER (PARTITION BY r ORDER BY k) AS below FROM ln),
cm AS (SELECT line AS common FROM (SELECT DISTINCT line, above, below FROM lw WHERE len(w) > 0) GROUP BY line HAVING count(*) >= greatest(10, (SELECT count(*) FROM documents) / 1000e0)),
lf AS (SELECT r, k, line, w, seen, line IN (SELECT common FROM cm) AS common, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS chars,
  len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&!|<>~^=]{2,}'))) AS noisy,
  len(list_filter(w, lambda x: list_contains(['|', '»', '«', '›', '·', '•', '/', '>', '::'], x))) AS marks FROM lw),
mx AS (SELECT r, k, max(c) AS most FROM (SELECT r, k, x, count(*) AS c FROM (SELECT r, k, unnest(w) AS x FROM lw) GROUP BY 1, 2, 3) GROUP BY 1, 2),
ft AS (SELECT lf.r, chars, n > 0 AND seen > 1 AS dup, n > 0 AND (seen > 1 OR noisy > 0.3 * n OR (marks >= 2 AND marks > 0.15 * n)
  OR (n >= 5 AND upper(line) = line AND lower(line) <> line) OR (n >= 10 AND len(list_distinct(w)) <= 0.5 * n AND most > 0.5 * n)
  OR regexp_matches(line, '(…|\.\.\.)[\x20\x09-\x0D]*$') OR (n <= 6 AND regexp_matches(line, '^[\x20\x09-\x0D]*[-*•‣◦▪–]'))
  OR (n <= 30 AND common)) AS fault
  FROM lf LEFT JOIN mx ON lf.r = mx.r AND lf.k = mx.k),
pl AS (SELECT r, count(*) FILTER (dup) AS n_dup, coalesce(sum(chars) FILTER (fault), 0) AS lost FROM ft GROUP BY r),
m AS (SELECT d.r, d.doc_id, len(ws.w) AS n, coalesce(list_sum(list_transform(ws.w, lambda x: length(x))), 0) AS chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS sym, n_dup, coalesce(n_repeat, 0) AS rep, lost
  FROM d JOIN ws USING (r) JOIN pl USING (r) LEFT JOIN rp USING (r)),
f AS (SELECT *, n < 50 OR 100 * rep > 50 * n AS failed FROM m)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, sym::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND lost <= 0.5 * chars AS kept FROM f
"""
