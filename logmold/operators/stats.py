"""Template usage statistics.

The reference updates one row per log line; here a run is one aggregation
and merging history is one more (partial aggregation on both sides).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.functions.text import pct

STATS_COLUMNS = ["template_text", "usage_count", "cache_count", "slm_count", "first_seen", "last_used", "example_log"]


def _ts(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def template_stats(logs: DataFrame, run_ts) -> DataFrame:
    """A4: per template usage, cache / generator counts, times and the first
    non-empty example line in trace order (batch_id, idx)."""
    ts = _ts(run_ts)
    is_cache = F.upper(F.col("source")) == F.lit("CACHE")
    first_pos = F.when(F.col("text") != F.lit(""), F.struct("batch_id", "idx"))
    return logs.groupBy(F.col("template").alias("template_text")).agg(
        F.count(F.lit(1)).alias("usage_count"),
        F.count_if(is_cache).alias("cache_count"),
        F.count_if(~is_cache).alias("slm_count"),
        F.min_by("text", first_pos).alias("example_log"),
    ).select(
        "template_text", "usage_count", "cache_count", "slm_count",
        ts.alias("first_seen"), ts.alias("last_used"),
        F.coalesce(F.col("example_log"), F.lit("")).alias("example_log"),
    )


def template_stats_of(batches: DataFrame, run_ts) -> DataFrame:
    """A4 from the run's batches: a batch has one template and one source, so
    nothing is exploded and the sums are a hash aggregate of batch rows. The
    example is the first non-empty line of the first batch that has one,
    fetched by its batch id."""
    ts = _ts(run_ts)
    is_cache = F.upper(F.col("source")) == F.lit("CACHE")
    n = F.col("number_of_logs")
    filled = F.exists("lines", lambda x: x["text"] != F.lit(""))
    sums = batches.groupBy(F.col("template").alias("template_text")).agg(
        F.sum(n).cast("long").alias("usage_count"),
        F.sum(F.when(is_cache, n).otherwise(0)).cast("long").alias("cache_count"),
        F.sum(F.when(is_cache, 0).otherwise(n)).cast("long").alias("slm_count"),
        F.min(F.when(filled, F.col("batch_id"))).alias("example_batch"),
    )
    first = batches.select(F.col("batch_id").alias("example_batch"),
                           F.get(F.filter("lines", lambda x: x["text"] != F.lit("")), F.lit(0))["text"].alias("example_log"))
    return sums.join(first, "example_batch", "left").select(
        "template_text", "usage_count", "cache_count", "slm_count", ts.alias("first_seen"), ts.alias("last_used"),
        F.coalesce(F.col("example_log"), F.lit("")).alias("example_log"),
    )


def merge_stats(history: DataFrame, run: DataFrame) -> DataFrame:
    """Counts add, first_seen kept, last_used moves forward, a missing
    example is filled from the run."""
    hist = history.select(*STATS_COLUMNS).withColumn("_run", F.lit(0))
    cur = run.select(*STATS_COLUMNS).withColumn("_run", F.lit(1))
    example_pos = F.when(F.col("example_log") != F.lit(""), F.col("_run"))
    return hist.unionByName(cur).groupBy("template_text").agg(
        F.sum("usage_count").cast("long").alias("usage_count"),
        F.sum("cache_count").cast("long").alias("cache_count"),
        F.sum("slm_count").cast("long").alias("slm_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_used").alias("last_used"),
        F.coalesce(F.min_by("example_log", example_pos), F.lit("")).alias("example_log"),
    )


def stats_view(stats: DataFrame) -> DataFrame:
    """A5/R2: stats with the source ratio in percent (2 digits, half-even)."""
    return stats.select(
        *STATS_COLUMNS,
        pct(F.col("cache_count"), F.col("usage_count")).alias("cache_pct"),
        pct(F.col("slm_count"), F.col("usage_count")).alias("slm_pct"),
    )


def stats_order() -> list[Column]:
    """O1: most used first; ties by first_seen, then text (explicit, so stable)."""
    return [F.col("usage_count").desc(), F.col("first_seen").asc(), F.col("template_text").asc()]


def top_templates(stats: DataFrame, n: int = 10) -> DataFrame:
    """O2: the ``n`` most used templates (a top-k: TakeOrderedAndProject)."""
    return stats.select(
        "template_text", "usage_count", "cache_count", "slm_count", "first_seen", "last_used"
    ).orderBy(*stats_order()).limit(n)


def source_table(stats: DataFrame) -> DataFrame:
    """R2: template, usage, cache_pct, slm_pct."""
    return stats_view(stats).select("template_text", "usage_count", "cache_pct", "slm_pct")
