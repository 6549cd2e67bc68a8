"""Run trace views.

The reference keeps the run trace as one nested object. Here the trace is two
flat tables (``logs``, ``batches``); nested JSON is produced per batch only,
where the nested array is bounded by ``batch_size``.
"""

from __future__ import annotations

import time
from typing import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logmold.functions.text import event_type, log_level, mask_dynamic_parts


def run_totals(batches: DataFrame) -> DataFrame:
    """A1: total_logs, batch_count, template_count (one row, also for no
    input), from the run's batches: a batch has one template."""
    return batches.agg(
        F.coalesce(F.sum("number_of_logs"), F.lit(0)).cast("long").alias("total_logs"),
        F.count(F.lit(1)).alias("batch_count"),
        F.count_distinct("template").alias("template_count"),
    )


def template_distribution(batches: DataFrame) -> DataFrame:
    """A2: lines per template, from the run's batches."""
    return batches.groupBy("template").agg(F.sum("number_of_logs").cast("long").alias("n"))


def batch_summary(batches: DataFrame) -> DataFrame:
    """R4 + A3: batch id, cluster, size, source and its template distribution.

    A batch has one template, so the per-batch distribution is one entry.
    """
    return batches.select(
        "batch_id", "cluster_id", "number_of_logs", "source", "template",
        F.col("number_of_logs").alias("n"),
    )


def structure_table(logs: DataFrame) -> DataFrame:
    """Text, masked, level, event_type, source in trace order."""
    return logs.select("batch_id", "idx", "text", "masked", "level", "event_type", "source")


def _log_struct(template, source):
    return lambda l: F.struct(
        l["text"].alias("text"),
        template.alias("template"),
        source.alias("source"),
        log_level(l["text"]).alias("level"),
        event_type(l["text"]).alias("event_type"),
        mask_dynamic_parts(l["text"]).alias("masked"),
    )


def batch_trace_json(batches: DataFrame) -> DataFrame:
    """One JSON object per batch (BatchTrace shape, logs nested).

    The per-batch timing of the reference has no meaning in a set-oriented
    plan and is not produced (run metrics come from the query progress).
    """
    logs = F.transform("lines", _log_struct(F.col("template"), F.col("source")))
    body = F.struct(
        "batch_id", "cluster_id", "number_of_logs", "cache_key", "source",
        "slm_raw_output", logs.alias("logs"),
    )
    return batches.select("batch_id", F.to_json(body).alias("batch_json"))


def batch_events(batches: DataFrame, event_ts) -> DataFrame:
    """``batch_processed`` JSON-lines records (level, logger, message, ts + payload)."""
    logs = F.transform("lines", _log_struct(F.col("template"), F.col("source")))
    record = F.struct(
        F.lit("INFO").alias("level"), F.lit("logmold").alias("logger"),
        F.lit("batch_processed").alias("message"),
        F.date_format(F.lit(event_ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        "batch_id", "cluster_id", "number_of_logs", "cache_key", "source", "slm_raw_output",
        logs.alias("logs"),
    )
    return batches.select(F.to_json(record).alias("value"))


def run_event(batches: DataFrame, event_ts) -> DataFrame:
    """The ``run_completed`` record with the run totals (one row)."""
    totals = run_totals(batches)
    record = F.struct(
        F.lit("INFO").alias("level"), F.lit("logmold").alias("logger"),
        F.lit("run_completed").alias("message"),
        F.date_format(F.lit(event_ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        "total_logs", "batch_count", "template_count",
    )
    return totals.select(F.to_json(record).alias("value"))


def write_events(batches: DataFrame, path: str, event_ts) -> None:
    """S5 sink: append the run's JSON-lines records under ``path``."""
    batch_events(batches, event_ts).unionByName(run_event(batches, event_ts)).write.mode("append").text(path)


def run_with_metrics(logs: DataFrame, sink: Callable[[DataFrame], None], name: str = "run") -> dict:
    """R5/F17 re-aimed: run metrics of one write of the trace, collected by
    an ``Observation`` while the sink runs (no second pass over the data).
    The wall time of the run is reported in ms, rounded to 3 digits."""
    obs = Observation(name)
    is_cache = F.upper(F.col("source")) == F.lit("CACHE")
    observed = logs.observe(
        obs,
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(is_cache).alias("cache_logs"),
        F.count_if(~is_cache).alias("slm_logs"),
        F.coalesce(F.max("batch_id"), F.lit(0)).alias("batch_count"),
    )
    started = time.perf_counter()
    sink(observed)
    metrics = dict(obs.get)
    metrics["processing_time_ms"] = round((time.perf_counter() - started) * 1000.0, 3)
    return metrics
