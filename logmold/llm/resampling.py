"""Quality classifier by importance resampling of hashed n-gram models.

Two bag-of-n-gram models over ``BUCKETS`` hashed word unigrams and bigrams
(A-Z lower-cased) are counted: one of the raw corpus (all rows), one of the
target (rows labelled good). A document's weight is the ratio of its
probabilities under them; adding Gumbel noise to the logarithm and taking the
k largest draws k documents without replacement in proportion to the weights.
The noise is a hash of the row, so a run can be repeated. k is a share of the
rows, by default the share of good quality among the labels.

The k-th largest key is found by counting keys in ranges of a grid, narrower
each time, so neither the keys nor the chosen rows meet in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.llm.common import lower_hashes, map_batches, ngrams, prepare, stash, texts

BUCKETS = 1 << 14
#: Bound of the labelled rows that the target model is fitted on: those of the
#: smallest id hashes. The raw model and the draw cover all rows.
MAX_TARGET = 100_000
#: Pseudo-count of each bucket.
SMOOTH = 1.0
#: Keys are compared in steps of 1 / GRID.
GRID = 1 << 20
RANGES = 1 << 14


def buckets(text: str | None) -> np.ndarray:
    """Buckets of the text's unigrams and bigrams."""
    h = lower_hashes(text)
    return (np.concatenate([ngrams(h, 1), ngrams(h, 2)]) % np.uint64(BUCKETS)).astype(np.int64)


class _Models:
    """A task's n-gram counts of all rows and of the target rows."""

    def __init__(self, target: np.ndarray):
        self.target = target
        self.raw, self.good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)

    def __call__(self, batch: pa.RecordBatch) -> None:
        ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
        good = np.isin(ids, self.target) & ~batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
        for text, is_good in zip(batch["text"].to_pylist(), good.tolist()):
            counts = np.bincount(buckets(text), minlength=BUCKETS)
            self.raw += counts
            if is_good:
                self.good += counts

    def finish(self) -> dict | None:
        at = np.flatnonzero(self.raw)
        return {"bucket": at, "raw": self.raw[at], "good": self.good[at]} if len(at) else None


def _cut(rows: DataFrame, value: str, k: int) -> tuple[int, int]:
    """The k-th largest ``value`` (long) and how many rows are above it."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    above = 0
    while low < high:
        # signed 64-bit bounds; the width fits since values span less than 2^64
        width = (high - low) // RANGES + 1
        part = rows.where(F.col(value).between(low, high)).groupBy(
            F.expr(f"cast((cast({value} as decimal(20)) - {low}) div {width} as long)").alias("r")).agg(F.count("*").alias("m"))
        for r, m in sorted(((x["r"], x["m"]) for x in part.collect()), reverse=True):
            if above + m >= k:
                low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                break
            above += m
    return low, above


def gumbel(k1: Column, k2: Column) -> Column:
    """Standard Gumbel noise from a row's key."""
    uniform = (F.pmod(F.xxhash64(k2, k1, F.lit(11)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, kept`` for each row of ``docs (doc_id, text)``.

    ``labels (doc_id, quality, toxic)``: target ids are those with quality 1
    and never 0, and never toxic. k is ``round(share * rows)``. Null and empty texts have
    no n-grams and weight 1. Equal keys are decided by a hash of the row; a row
    written twice gets one decision, so at most the repeats go beyond k. With
    no target row every weight is 1 and all rows are kept, unless ``share`` is
    given. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    given = share is not None
    if not given:
        share = judged.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.0
    target = judged.where("quality = 1 and toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TARGET).select("doc_id").toArrow()
    ids = spark.sparkContext.broadcast(np.sort(target["doc_id"].to_numpy()))

    rows = texts(docs)
    sums = map_batches(rows.select("doc_id", "text"), lambda: _Models(ids.value), "bucket int, raw long, good long") \
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()  # BUCKETS rows at most
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"].to_numpy()], good[sums["bucket"].to_numpy()] = sums["raw"].to_numpy(), sums["good"].to_numpy()
    ratio = np.zeros(BUCKETS)
    if good.sum():
        ratio = np.log((good + SMOOTH) / (good.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))
    elif not given:
        share = 1.0
    shared = spark.sparkContext.broadcast(ratio)

    def weigh():
        of = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            found = [buckets(t) for t in batch["text"].to_pylist()]
            return {c: batch[c] for c in ("k1", "k2", "doc_id")} | {
                "n_grams": [len(b) for b in found], "log_weight": [float(of[b].sum()) for b in found]}

        return work

    scored = map_batches(rows, weigh, "k1 long, k2 long, doc_id long, n_grams long, log_weight double")
    keyed = stash(scored.withColumn("key", F.floor((F.col("log_weight") + gumbel(F.col("k1"), F.col("k2"))) * GRID).cast("long")), "weights")
    n = keyed.count()
    k = round(share * n)
    if not 0 < k < n:
        chosen = F.lit(k > 0)
    else:
        cut, above = _cut(keyed, "key", k)
        tied, _ = _cut(keyed.where(F.col("key") == cut), "k1", k - above)
        chosen = (F.col("key") > cut) | (F.col("key") == cut) & (F.col("k1") >= tied)
    return keyed.select("doc_id", "n_grams", "log_weight", (F.col("key") / GRID).alias("key"), chosen.alias("kept"))
