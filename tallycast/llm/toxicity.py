"""Toxicity scores: a linear model on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of the labelled rows (``Settings.most_toxic`` and
``most_clean`` documents, those with the smallest hash of their id). Each n-gram is counted
once per document and class; the log ratio of the two classes' shares scales its feature;
n-grams whose ratio carries most weight are kept; a logistic regression on them is fitted by
Spark ML. Scoring reads every text whole, needs no shuffle, and ships one table of weights,
whose size is fixed by the number of n-gram buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import fresh, table, text_of
from tallycast.storage import materialise


class Settings(NamedTuple):
    lengths: tuple[int, ...] = (4, 5, 6)
    bits: int = 20  # n-grams are hashed into 2 ** bits buckets
    most_toxic: int = 3000  # bounds of the training sample
    most_clean: int = 6000
    features: int = 10_000
    least_documents: int = 3  # rarer n-grams are not kept
    smoothing: float = 1.0
    penalty: float = 1e-5


class Model(NamedTuple):
    weights: np.ndarray  # by bucket, ratio included
    intercept: float
    settings: Settings


def buckets(text: str, settings: Settings) -> np.ndarray:
    """Bucket of every character n-gram of the lower-case text, in order, repeats included."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = []
    for n in settings.lengths:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        mixed = np.full(count, n * 40503, dtype=np.uint32)
        for k in range(n):
            mixed = (mixed ^ codes[k : k + count]) * np.uint32(2654435769)
            mixed ^= mixed >> np.uint32(15)
        found.append(mixed >> np.uint32(32 - settings.bits))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def training_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(text, toxic, weight): the bounded sample, weighted back to the classes' shares."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    parts = []
    for label, most in ((1, settings.most_toxic), (0, settings.most_clean)):
        drawn = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        weight = max(1.0, sizes.get(label, 0) / most)
        parts.append(drawn.withColumn("weight", F.lit(weight)))
    drawn = parts[0].unionByName(parts[1])
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "toxic", "weight")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``docs`` (doc_id, text) joined with ``labels`` (doc_id, toxic); unknown labels are left out.

    With fewer than two classes among the labelled documents there is nothing to tell apart:
    every text then gets the smoothed share of the class that is there.
    """
    spark = docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = materialise(training_sample(docs, labels, settings).repartition(min(spread, 16)), "labelled")
    have = {r[0]: (r[1], r[2]) for r in sample.groupBy("toxic").agg(F.count("*"), F.sum("weight")).collect()}
    if len(have) < 2:
        toxic, every = have.get(1, (0, 0))[0], sum(n for n, _ in have.values())
        share = (toxic + 1) / (every + 2) if every else 0.5
        share = share if toxic else min(share, 0.1)
        return Model(np.zeros(1 << settings.bits), float(np.log(share / (1 - share))), settings)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << settings.bits), dtype=np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[toxic][np.unique(buckets(text, settings))] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"bucket": some, "clean": seen[0][some], "toxic": seen[1][some]})

    counts = materialise(
        sample.select("text", "toxic")
        .mapInPandas(count, "bucket long, clean long, toxic long")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "ngrams",
    )
    totals = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    a = settings.smoothing
    ratio = F.log((F.col("toxic") + a) / (totals[1] + a)) - F.log((F.col("clean") + a) / (totals[0] + a))
    ranked = counts.withColumn("ratio", ratio).withColumn("documents", F.col("clean") + F.col("toxic"))
    kept = (
        ranked.where(F.col("documents") >= settings.least_documents)
        .orderBy(F.desc(F.abs("ratio") * F.sqrt("documents")), "bucket")
        .limit(settings.features)
        .select("bucket", "ratio")
        .toPandas()  # at most ``features`` rows
        .sort_values("bucket")
    )
    chosen, ratios = kept["bucket"].to_numpy(), kept["ratio"].to_numpy()
    if not len(chosen):
        share = have[1][1] / (have[0][1] + have[1][1])
        return Model(np.zeros(1 << settings.bits), float(np.log(share / (1 - share))), settings)

    @F.udf(VectorUDT())  # a few thousand rows
    def scaled(text):
        at = np.flatnonzero(np.isin(chosen, buckets(text, settings)))
        return Vectors.sparse(len(chosen), at.tolist(), ratios[at].tolist())

    # Kept as plain rows: Spark ML reads them once per step.
    frame = sample.select(scaled("text").alias("features"), F.col("toxic").cast("double").alias("label"), "weight")
    fitted = LogisticRegression(
        weightCol="weight", regParam=settings.penalty, standardization=False, maxIter=100, tol=1e-6
    ).fit(materialise(frame, "ngram-vectors"))
    weights = np.zeros(1 << settings.bits)
    weights[chosen] = fitted.coefficients.toArray() * ratios
    return Model(weights, float(fitted.intercept), settings)


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` with a score between 0 and 1. A null text is empty; an empty text gets the model's intercept."""
    weights, intercept, settings = model
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 4 MB at 20 bits

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table_ = shared.value
        for texts in batches:
            out = []
            for text in texts:
                found = buckets(text, settings)
                found = np.unique(found[table_[found] != 0])
                margin = intercept + float(table_[found].sum(dtype=np.float64))
                out.append(1.0 / (1.0 + np.exp(-min(max(margin, -500.0), 500.0))))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(column, F.pandas_udf(of, "double")(text_of()))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that never teach: CRC-32 of the id's text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score) per row of ``docs``; labels of held-out rows are not read.

    Rows that repeat a doc_id are scored each by its text, and teach once per label and text.
    Columns other than doc_id and text, and doc_id itself, are never inputs of a score.
    """
    rows = docs.select("doc_id", "text")
    model = fit(rows, labels.select("doc_id", "toxic").where(~held_out()), settings)
    return score(rows, model, "score").select("doc_id", held_out().alias("held_out"), "score")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, columns unchanged."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where(~held_out()), settings)
    name = fresh(docs, "toxicity")
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)


def op8(spark, folder: str) -> DataFrame:
    scored = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
