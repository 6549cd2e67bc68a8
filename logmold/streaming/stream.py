"""Structured Streaming jobs.

X1 parses every micro-batch with the persisted cache and merges the run into
the persisted stats, inside ``foreachBatch``. Every write of an epoch goes to
the partition of that epoch, so a replayed epoch overwrites its own output
and the job stays idempotent. Batches don't span triggers here; those of
:mod:`logmold.streaming.microbatch` do.

X2 counts lines per event-time window, level and event type, with a
watermark: state of windows behind the watermark is dropped and rows older
than the watermark of the previous micro-batch are ignored (Spark's rule for
late rows). The sink keeps the newest count of every window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmold.functions.text import event_type, log_level
from logmold.operators.parse import cache_hits, new_cache_entries, parse_logs
from logmold.operators.stats import template_stats_of
from logmold.session import scratch_path
from logmold.sources import store as ST
from logmold.sources.lines import events_to_log_lines

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "props"]


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of ``events`` as a stream (schema taken from the files)."""
    schema = spark.read.parquet(path).schema
    # A glob keeps the file source from taking a single file as its base directory.
    path = path if any(ch in path for ch in "*?[") else _as_glob(path)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path).select(*EVENT_COLUMNS)


def _as_glob(path: str) -> str:
    head, _, tail = path.rstrip("/").rpartition("/")
    return f"{head}/[{tail[0]}]{tail[1:]}" if tail else path


def parse_stream(lines: DataFrame, store: ST.EpochTables, checkpoint: str, run_ts,
                 batch_size: int = 16, min_tokens: int = 3, generator=None):
    """``lines(idx, text, ...)`` stream -> trace logs, cache and stats tables
    in ``store``. Runs until the input available now is consumed."""

    def per_epoch(batch: DataFrame, epoch_id: int) -> None:
        # State as it was before this epoch: a replayed epoch sees the same input.
        epoch = int(epoch_id)
        result = parse_logs(batch.select("idx", "text"), cache=ST.load_cache(store, before=epoch), generator=generator,
                            batch_size=batch_size, min_tokens=min_tokens)
        # The parse runs once: everything else of the epoch reads its batches.
        store.write("trace_batches", result.batches, epoch)
        written = store.spark.read.schema(result.batches.schema).parquet(f"{store.root}/trace_batches/epoch={epoch}")
        result = result.over(written)
        store.write("trace_logs", result.logs.select(
            "idx", "text", "batch_id", "cluster_id", "template", "source", "level", "event_type", "masked"), epoch)
        # State changes are added as rows of the epoch (O(run), not O(state)).
        ST.append_cache(store, ST.cache_delta(new_cache_entries(result, run_ts), cache_hits(result)), epoch)
        ST.append_stats(store, template_stats_of(result.batches, run_ts), epoch)

    query = (
        lines.writeStream.foreachBatch(per_epoch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


TRACE_SCHEMA = ("idx BIGINT, text STRING, batch_id BIGINT, cluster_id STRING, template STRING, source STRING, "
                "level STRING, event_type STRING, masked STRING, epoch BIGINT")


def stream_parse_events(spark: SparkSession, sf_dir: str, batch_size: int = 16, min_tokens: int = 3,
                        run_ts="2024-02-01 00:00:00", root: str | None = None) -> DataFrame:
    """X1 over the ``events`` table as a file stream; returns the trace table."""
    root = root or scratch_path(spark, "stream-parse")
    store = ST.EpochTables(spark, f"{root}/tables")
    events = event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    parse_stream(events_to_log_lines(events), store, f"{root}/checkpoint", run_ts, batch_size, min_tokens)
    return store.read("trace_logs", TRACE_SCHEMA)


def feed(spark: SparkSession, parts: list[DataFrame], root: str, run) -> None:
    """Add each part to the input folder and run the stream over it: the same
    checkpoint, so every call is a trigger that sees only the new files."""
    for part in parts:
        part.select(*EVENT_COLUMNS).write.mode("append").parquet(f"{root}/in")
        run(event_stream(spark, f"{root}/in"))


def stream_parse_parts(spark: SparkSession, sf_dir: str, ends: list, batch_size: int = 16, min_tokens: int = 3,
                       run_ts="2024-02-01 00:00:00", root: str | None = None) -> DataFrame:
    """X1 over ``events`` in several triggers, cut at the times ``ends``."""
    root = root or scratch_path(spark, "stream-parts")
    store = ST.EpochTables(spark, f"{root}/tables")
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    cuts = [F.lit(e).cast("timestamp") for e in ends]
    bounds = zip([None, *cuts], [*cuts, None])
    parts = [events.filter((F.lit(True) if a is None else F.col("ts") >= a) & (F.lit(True) if b is None else F.col("ts") < b))
             for a, b in bounds]
    feed(spark, parts, root, lambda stream: parse_stream(
        events_to_log_lines(stream), store, f"{root}/checkpoint", run_ts, batch_size, min_tokens))
    return store.read("trace_logs", TRACE_SCHEMA)


WINDOW_SCHEMA = "window_start TIMESTAMP, window_end TIMESTAMP, level STRING, event_type STRING, n BIGINT, epoch BIGINT"


def level_counts(lines: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """X2 (streaming or batch): lines per tumbling window, level, event type."""
    return (
        lines.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), log_level(F.col("text")).alias("level"),
                 event_type(F.col("text")).alias("event_type"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "level", "event_type", "n")
    )


def run_level_counts(lines: DataFrame, store: ST.EpochTables, checkpoint: str,
                     window: str = "1 hour", watermark: str = "10 minutes"):
    """X2 with update output: every epoch adds the windows that it changed."""

    def per_epoch(batch: DataFrame, epoch_id: int) -> None:
        store.write("window_counts", batch, int(epoch_id))

    query = (
        level_counts(lines, window, watermark).writeStream.outputMode("update")
        .foreachBatch(per_epoch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def latest_window_counts(rows: DataFrame) -> DataFrame:
    """Newest count per window key (the last epoch that updated it)."""
    return rows.groupBy("window_start", "window_end", "level", "event_type").agg(
        F.max_by("n", "epoch").alias("n"))


def stream_level_counts(spark: SparkSession, sf_dir: str, window: str = "1 hour",
                        watermark: str = "10 minutes", root: str | None = None) -> DataFrame:
    root = root or scratch_path(spark, "stream-levels")
    store = ST.EpochTables(spark, f"{root}/tables")
    events = event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    run_level_counts(events_to_log_lines(events), store, f"{root}/checkpoint", window, watermark)
    return latest_window_counts(store.read("window_counts", WINDOW_SCHEMA))


def stream_level_counts_late(spark: SparkSession, sf_dir: str, split, window: str = "1 hour", watermark: str = "10 minutes",
                             root: str | None = None) -> DataFrame:
    """X2 over ``events`` before and after ``split`` as two triggers, then a
    third with the first part again, moved behind the watermark."""
    root = root or scratch_path(spark, "stream-late")
    store = ST.EpochTables(spark, f"{root}/tables")
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    early = events.filter(F.col("ts") < F.lit(split).cast("timestamp"))
    late = early.withColumn("ts", (F.col("ts") - F.expr("INTERVAL 90 DAYS")).cast(events.schema["ts"].dataType))
    parts = [early, events.filter(F.col("ts") >= F.lit(split).cast("timestamp")), late]
    feed(spark, parts, root, lambda stream: run_level_counts(
        events_to_log_lines(stream), store, f"{root}/checkpoint", window, watermark))
    return latest_window_counts(store.read("window_counts", WINDOW_SCHEMA))
