"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics. For every language and
source, and as a fallback for every language and for all rows, a minimum
covariance determinant estimate gives location and scatter of the ordinary
rows, and a text is rejected when its Mahalanobis distance is too large.

Estimation is distributed: a C-step sorts rows into bins of their distance
(a fixed grid), sums counts, values and products by group and bin, and takes
whole bins up to the ``CORE`` share of the rows into the next estimate. A
group's rows are never gathered, only its bounded table of bins. All rows
count; the start is the coordinatewise median and spread, from the same bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmold.llm.common import map_batches, ngrams, prepare, settle, stash, texts, utf8, whole_rows, word_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Share of a group's rows in the core, and the 5-dimensional chi-square value
#: there. Half of the rows: alike junk has to be more than that to get into it.
CORE, CORE_CHI2 = 0.5, 4.3515
#: Squared distance beyond which a text is rejected (chi-square, 5 dimensions:
#: below 1e-8): ordinary texts are to be kept, also where their tails are heavy.
CUTOFF = 50.0
#: Smallest group with an estimate of its own.
MIN_GROUP = 100
#: Concentration steps after the start.
STEPS = 5
#: Bins of the transformed values in the start.
GRID = 256
#: Transformed statistics and the resolution (a standard deviation) below which
#: a group's scatter isn't taken: most texts have no symbol and no repeat at all.
FEATURES = {"f_length": 0.08, "f_symbols": 0.05, "f_lines": 0.12, "f_repeats": 0.14, "f_distinct": 0.05}
NAMES = list(FEATURES)
DIM = len(NAMES)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by runs of ``window`` words that occur more than once."""
    runs = ngrams(hashes, window)
    if len(runs) < 2:
        return 0
    _, which, times = np.unique(runs, return_inverse=True, return_counts=True)
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(times[which] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def _counts():
    def work(batch: pa.RecordBatch) -> dict:
        out = {c: batch[c] for c in ("k1", "k2", "doc_id", "lang", "source")}
        rows = []
        for text in batch["text"].to_pylist():
            text = text or ""
            found = word_hashes(utf8(text))
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            rows.append((len(found), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
                         len(lines) - len(set(lines)), repeated_words(found), len(lines), len(np.unique(found))))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
        return out | dict(zip(names, map(list, zip(*rows))))

    return work


def text_statistics(docs: DataFrame) -> DataFrame:
    """Word, symbol, line and repeat counts of each row, ``base_failed``, and
    the transformed vector. Null and empty texts have zeros throughout."""
    counts = map_batches(
        texts(docs, "lang", "source").withColumns({c: F.col(c).cast("string") for c in ("lang", "source")}), _counts,
        "k1 long, k2 long, doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long")

    def share(a: str, b: str) -> Column:
        return F.asin(F.sqrt(F.least(F.col(a) / F.greatest(b, F.lit(1)), F.lit(1.0))))

    return counts.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "f_length": F.log(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1))),
        "f_symbols": share("n_symbols", "word_chars"),
        "f_lines": share("n_dup_lines", "n_lines"),
        "f_repeats": share("n_repeat_words", "n_words"),
        # share of distinct words, on a scale that depends little on the length
        "f_distinct": F.log(F.greatest("n_distinct", F.lit(1)) + 1.0) / F.log(F.greatest("n_words", F.lit(1)) + 1.0),
    })


def _group(level: int) -> Column:
    return F.to_json(F.struct(F.lit(level).alias("level"), *[F.col(c) for c in ("lang", "source")[:2 - level]]))


def _squared() -> Column:
    """Squared Mahalanobis distance to the model columns ``mean`` and ``inverse``."""
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        term = (F.col(NAMES[i]) - F.col("mean")[i]) * (F.col(NAMES[j]) - F.col("mean")[j]) * F.col("inverse")[k]
        total = total + (term if i == j else 2 * term)
    return total


def _bin(squared: Column) -> Column:
    return F.floor(F.log2(1 + F.greatest(squared, F.lit(0.0))) * 32)


def _start(rows: DataFrame) -> DataFrame:
    """Median and spread of each coordinate, from histograms on a grid."""
    long = rows.select("key", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.round(F.col(c) * GRID).cast("long").alias("v")) for i, c in enumerate(NAMES)])).alias("x")) \
        .groupBy("key", "x.i", "x.v").agg(F.count("*").alias("m"))

    def middle(df: DataFrame, name: str) -> DataFrame:
        by = Window.partitionBy("key", "i")
        return df.withColumn("upto", F.sum("m").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))) \
            .withColumn("all", F.sum("m").over(by)).where(2 * F.col("upto") >= F.col("all")) \
            .groupBy("key", "i").agg((F.min("v") / GRID).alias(name))

    center = middle(long, "center")
    off = long.join(center, ["key", "i"]).withColumn("v", F.abs(F.col("v") - F.round(F.col("center") * GRID)).cast("long")) \
        .groupBy("key", "i", "v").agg(F.sum("m").alias("m"))
    floors = F.array(*[F.lit(x) for x in FEATURES.values()])
    spread = center.join(middle(off, "mad"), ["key", "i"]).withColumn(
        "w", 1 / (F.pow(1.4826 * F.col("mad"), 2) + F.pow(F.element_at(floors, F.col("i") + 1), 2)))
    one = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    return spread.groupBy("key").agg(
        F.array(*[one("center", i) for i in range(DIM)]).alias("mean"),
        F.array(*[one("w", i) if i == j else F.lit(0.0) for i, j in PAIRS]).alias("inverse"))


def _estimates():
    """Mean and inverse scatter from sums over a group's core."""
    floor2 = np.square(list(FEATURES.values()))

    def work(batch: pa.RecordBatch) -> dict:
        means, inverses = [], []
        for r in batch.to_pylist():
            mean = np.array(r["sums"]) / r["m"]
            scatter = np.zeros((DIM, DIM))
            for (i, j), p in zip(PAIRS, r["products"]):
                scatter[i, j] = scatter[j, i] = p / r["m"] - mean[i] * mean[j]
            # the core's widest distance against that of a normal distribution
            grow = max(1.0, (2.0 ** ((r["edge"] + 0.5) / 32) - 1) / CORE_CHI2) if r["last"] else 1.0
            inverse = np.linalg.inv(grow * scatter + np.diag(floor2))
            means.append(mean.tolist())
            inverses.append([inverse[i, j] for i, j in PAIRS])
        return {"key": batch["key"], "mean": means, "inverse": inverses}

    return work


def _step(rows: DataFrame, model: DataFrame, last: bool) -> DataFrame:
    bins = rows.join(model, "key").withColumn("bin", _bin(_squared())).groupBy("key", "bin").agg(
        F.count("*").alias("m"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(NAMES)],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}{j}") for i, j in PAIRS])
    by = Window.partitionBy("key")
    core = bins.withColumn("below", F.sum("m").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")) \
        .withColumn("all", F.sum("m").over(by)).where(F.col("below") < CORE * F.col("all"))
    sums = core.groupBy("key").agg(
        F.sum("m").alias("m"), F.max("bin").alias("edge"), F.lit(last).alias("last"),
        F.array(*[F.sum(f"s{i}") for i in range(DIM)]).alias("sums"),
        F.array(*[F.sum(f"p{i}{j}") for i, j in PAIRS]).alias("products"))
    return stash(map_batches(sums, _estimates, "key string, mean array<double>, inverse array<double>"), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs (doc_id, text, lang, source)``: keys, counts,
    ``base_failed``, ``distance2`` and ``kept``.

    Rows that the base rules fail are left out of the estimates, and get no
    distance. Null languages and sources are values of their own. Groups below
    ``MIN_GROUP`` rows take the estimate of their language, then that of all
    rows; with fewer rows than that in all nothing more than the base rules
    rejects. Repeated rows are judged alike; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = stash(text_statistics(docs), "statistics")
    good = rows.where("not base_failed")
    leveled = good.select(*NAMES, F.explode(F.array(*[_group(i) for i in range(3)])).alias("key"))
    sizes = leveled.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_GROUP)
    model = stash(_start(leveled), "mcd")
    for step in range(STEPS):
        model = _step(leveled, model, step == STEPS - 1)
        settle(docs.sparkSession)
    keys = good.select("lang", "source").distinct().select(
        "lang", "source", F.posexplode(F.array(*[_group(i) for i in range(3)])).alias("level", "key"))
    own = keys.join(model.join(sizes.select("key"), "key"), "key").groupBy("lang", "source").agg(F.min_by(F.struct("mean", "inverse"), "level").alias("own")) \
        .select(F.col("lang").alias("g1"), F.col("source").alias("g2"), "own.*")
    same = rows["lang"].eqNullSafe(own["g1"]) & rows["source"].eqNullSafe(own["g2"])
    return rows.join(own, same, "left").withColumn("distance2", F.when(~F.col("base_failed"), _squared())).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True)))


def keep_ordinary(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    gone = judge(docs).where("not kept").select("k1", "k2").distinct()
    return whole_rows(docs).join(gone, ["k1", "k2"], "left_anti").select("row.*")
