"""Compression classifier: zstandard dictionaries of good and of bad text, calibrated to a probability.

Two dictionaries are trained, one from labelled good texts and one from labelled bad texts. A text is compressed
whole with each of them; the difference of the two sizes, over the text's own size, is the only thing that a score
looks at. A logistic curve over it, fitted on labelled texts that the dictionaries have not seen, turns it into the
probability of label 1.

The model is fitted on a bounded sample: at most ``dictionary_docs + calibration_docs`` labelled documents of each
class, of at most ``max_chars`` characters each, those with the least hash of their id; no other text is collected. Rows whose
``crc32(doc_id as text) mod 5`` is 0 are held out and never looked at. Scoring covers every whole text.

Defined cases: null and empty texts get the share of good labels as their score; with fewer than
``least_per_class`` usable labelled texts of a class every score is that share (0.5 without labels); contradicting
labels of one id count as 1; labels other than 0 and 1 are ignored; of rows that repeat an id the text with the
least hash is the labelled one; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, column_index, in_slices, map_rows

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    dictionary_docs: int = 600
    calibration_docs: int = 900
    max_chars: int = 20_000
    dictionary_bytes: int = 65_536
    level: int = 9
    penalty: float = 1e-4
    least_per_class: int = 16


@dataclass
class Model:
    """Dictionaries and the curve ``(intercept, slope)``; ``prior`` is the score of a text without content."""

    prior: float = 0.5
    level: int = 3
    good: bytes = b""
    bad: bytes = b""
    curve: tuple[float, float] | None = None

    def measure(self):
        """``f(bytes) -> normalised size difference``, above 0 where the good dictionary helps more."""
        import zstandard

        def one(data: bytes):
            return zstandard.ZstdCompressor(level=self.level, write_checksum=False, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(data))

        good, bad = one(self.good), one(self.bad)  # made once
        return lambda data: (len(bad.compress(data)) - len(good.compress(data))) / (len(data) + 1)

    def scorer(self):
        """``f(text) -> probability of label 1``."""
        if self.curve is None:
            return lambda text: self.prior
        difference, (base, slope) = self.measure(), self.curve

        def score(text: str | None) -> float:
            if not text:
                return self.prior
            z = base + slope * difference(text.encode("utf-8", "surrogatepass"))
            return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

        return score


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the intercept is not penalised."""
    a = np.column_stack((np.ones(len(x)), x))
    w, ridge = np.zeros(a.shape[1]), penalty * np.diag([1e-9, *[1.0] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) / weight.sum() + ridge @ w
        hess = (a * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ a / weight.sum() + ridge
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(texts: dict[int, list[bytes]], counts: dict[int, int], settings: Settings = Settings()) -> Model:
    """A model from whole labelled texts (of class 1 and 0) and the true counts of both classes."""
    import zstandard

    total = sum(counts.values())
    model = Model(prior=counts.get(1, 0) / total if total else 0.5, level=settings.level)
    if min(len(texts.get(q, [])) for q in (0, 1)) < settings.least_per_class:
        return model
    seen = {q: texts[q][: min(settings.dictionary_docs, len(texts[q]) // 2)] for q in (0, 1)}
    rest = {q: texts[q][len(seen[q]) :][: settings.calibration_docs] for q in (0, 1)}

    def dictionary(samples: list[bytes]) -> bytes:
        size = min(settings.dictionary_bytes, max(1024, sum(map(len, samples)) // 8))
        try:
            return zstandard.train_dictionary(size, samples, level=settings.level).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself, as raw content
            return b"".join(samples)[-settings.dictionary_bytes :]

    model.good, model.bad = dictionary(seen[1]), dictionary(seen[0])
    difference = model.measure()
    x = np.array([difference(t) for q in (1, 0) for t in rest[q]])
    y = np.array([float(q) for q in (1, 0) for _ in rest[q]])
    weight = np.array([counts[q] / len(rest[q]) for q in (1, 0) for _ in rest[q]])
    mean, scale = x.mean(), x.std() + 1e-9
    base, slope = logistic(((x - mean) / scale)[:, None], y, weight / weight.mean(), settings.penalty)
    model.curve = float(base - slope * mean / scale), float(slope / scale)
    return model


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the bounded sample; what reaches the driver is that sample and the two class counts."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~is_held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    per = settings.dictionary_docs + settings.calibration_docs
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text").between(1, settings.max_chars))
    usable = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    picked = {r["doc_id"]: r["quality"] for q in (0, 1) for r in usable.where(F.col("quality") == q).orderBy(*order).limit(per).collect()}
    own: dict[int, list[bytes]] = {0: [], 1: []}
    if picked:
        ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in picked], "doc_id bigint"))  # at most 2 * (600 + 900) ids
        found = texts.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        for r in found.orderBy(*order).collect():
            own[picked[r["doc_id"]]].append(r["text"].encode("utf-8", "surrogatepass"))
    return fit(own, counts, settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def make():
        f = model.scorer()

        def work(ids, texts):
            s = [f(t) for t in texts]
            return [ids, s, [int(v >= threshold) for v in s]]

        return work

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"cast(`{text_col}` as string) AS text").mapInArrow(arrow_rows(make, schema), "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; same columns."""

    at = column_index(docs.columns, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for piece in in_slices(batches):
            yield piece.filter(pa.array([f(t) >= threshold for t in piece.column(at).to_pylist()], pa.bool_()))

    return map_rows(docs, run)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 5 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
