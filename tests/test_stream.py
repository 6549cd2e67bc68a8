"""Structured Streaming jobs: X1 per-trigger parse with persisted state, X2
windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF0001
from logmold.operators.parse import parse_logs
from logmold.sources import store as ST
from logmold.sources.lines import events_to_log_lines
from logmold.streaming.stream import TRACE_SCHEMA, WINDOW_SCHEMA, event_stream, latest_window_counts, parse_stream, \
    run_level_counts


def _split_events(spark, root, cut):
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    early = ev.filter(F.col("event_id") < cut)
    late = ev.filter(F.col("event_id") >= cut)
    early.coalesce(1).write.parquet(f"{root}/in/part1")
    late.coalesce(1).write.parquet(f"{root}/in/part2")
    return early, late


def test_stream_parse_per_trigger(spark, tmp_root):
    early, late = _split_events(spark, tmp_root, 600)
    files = sorted(str(p) for p in __import__("pathlib").Path(f"{tmp_root}/in").glob("*/*.parquet"))
    staging = f"{tmp_root}/stream_in"
    import shutil, os

    os.makedirs(staging)
    for i, f in enumerate(files):
        shutil.copy(f, f"{staging}/f{i}.parquet")
        # the file source takes files in modification-time order
        os.utime(f"{staging}/f{i}.parquet", (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    store = ST.EpochTables(spark, f"{tmp_root}/tables")
    events = event_stream(spark, staging, max_files_per_trigger=1)
    parse_stream(events_to_log_lines(events), store, f"{tmp_root}/ckpt", "2024-02-01 00:00:00")
    out = store.read("trace_logs", TRACE_SCHEMA)
    assert out.select("epoch").distinct().count() == 2
    # trigger 1 equals a batch parse of the first file; trigger 2 uses its cache
    b1 = parse_logs(events_to_log_lines(early))
    got1 = {r["idx"]: (r["template"], r["source"], r["batch_id"]) for r in out.filter("epoch = 0").collect()}
    exp1 = {r["idx"]: (r["template"], r["source"], r["batch_id"]) for r in b1.logs.collect()}
    assert got1 == exp1
    cache1 = ST.load_cache(store, before=1)
    b2 = parse_logs(events_to_log_lines(late), cache=cache1)
    got2 = {r["idx"]: (r["template"], r["source"]) for r in out.filter("epoch = 1").collect()}
    exp2 = {r["idx"]: (r["template"], r["source"]) for r in b2.logs.collect()}
    assert got2 == exp2
    stats = {r["template_text"]: r["usage_count"] for r in ST.load_stats(store).collect()}
    assert sum(stats.values()) == out.count()


def test_stream_level_counts_drops_late_rows(spark, tmp_root):
    import os, shutil
    from pathlib import Path

    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    hi = ev.agg(F.max("ts")).first()[0]
    cut = F.lit(hi) - F.expr("INTERVAL 2 DAYS")
    on_time = ev.filter(F.col("ts") < cut)
    recent = ev.filter(F.col("ts") >= cut)
    late = on_time.orderBy("ts").limit(5).withColumn("ts", F.col("ts") - F.expr("INTERVAL 20 DAYS"))
    staging = f"{tmp_root}/stream_in"
    os.makedirs(staging)
    # Late rows are judged against the watermark of the previous micro-batch,
    # so they come in the third trigger.
    for i, df in enumerate([on_time, recent, late]):
        d = f"{tmp_root}/w{i}"
        df.coalesce(1).write.parquet(d)
        shutil.copy(next(Path(d).glob("*.parquet")), f"{staging}/f{i}.parquet")
        os.utime(f"{staging}/f{i}.parquet", (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    store = ST.EpochTables(spark, f"{tmp_root}/tables")
    run_level_counts(events_to_log_lines(event_stream(spark, staging, max_files_per_trigger=1)), store,
                     f"{tmp_root}/ckpt")
    got = latest_window_counts(store.read("window_counts", WINDOW_SCHEMA))
    total = got.agg(F.sum("n")).first()[0]
    # the late file is 20 days behind the watermark: none of its rows count
    assert total == on_time.count() + recent.count()


def test_replayed_epoch_changes_nothing(spark, tmp_root):
    """A trigger that ran but wasn't committed runs again and writes the same rows."""
    import os, shutil
    from pathlib import Path

    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    staging = f"{tmp_root}/stream_in"
    os.makedirs(staging)
    for i, df in enumerate([ev.filter("event_id < 400"), ev.filter("event_id >= 400")]):
        d = f"{tmp_root}/c{i}"
        df.coalesce(1).write.parquet(d)
        shutil.copy(next(Path(d).glob("*.parquet")), f"{staging}/f{i}.parquet")
        os.utime(f"{staging}/f{i}.parquet", (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    store = ST.EpochTables(spark, f"{tmp_root}/tables")
    run = lambda: parse_stream(events_to_log_lines(event_stream(spark, staging, max_files_per_trigger=1)), store,
                               f"{tmp_root}/ckpt", "2024-02-01 00:00:00")
    state = lambda: (sorted(map(tuple, ST.load_cache(store).collect())), sorted(map(tuple, ST.load_stats(store).collect())),
                     sorted(map(tuple, store.read("trace_logs", TRACE_SCHEMA).collect())))
    run()
    before = state()
    for name in ("1", ".1.crc"):
        os.remove(f"{tmp_root}/ckpt/commits/{name}")
    run()
    assert state() == before
