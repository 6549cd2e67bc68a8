"""X1, batches that span triggers: line and time windows as keyed state.

The lines of a cluster (and lane, see below) are cut into batches in the order
of ``idx``: a batch closes when it has ``batch_size`` lines, or when ``wait`` has
passed since its first line. Open lines and the number of the next batch are
state in the state store; a trigger carries them on, and an event-time timer
closes a batch whose time is over when no further line of its cluster comes.
Which of the two closes a batch, a later line or the timer, makes no difference
to it, so neither do the triggers: the result is that of one pass over all
lines, as long as lines come in the order of their times (up to ``delay``).

Lines of a cluster are put in order in one task, a trigger at a time: bound the
trigger (``max_files_per_trigger``). Where one cluster has much of the input,
``lanes`` deals its lines out by ``idx``; each lane has batches of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logmold.functions.text import cache_key, signature
from logmold.operators.generators import fallback_template
from logmold.session import DEFAULT_CONF, ship_package
from logmold.sources import store as ST

LINES = "array<struct<idx: bigint, us: bigint, text: string>>"
BATCHES = f"cluster_id STRING, lane BIGINT, batch_no BIGINT, closed_by STRING, lines {LINES}"
TABLE = ("cluster_id STRING, lane BIGINT, batch_no BIGINT, closed_by STRING, number_of_logs BIGINT, first_idx BIGINT, last_idx BIGINT, "
         f"cache_key STRING, template STRING, lines {LINES}, epoch BIGINT")


def _batching(batch_size: int, wait_us: int) -> StatefulProcessor:
    """Processor of one cluster and lane. Its class is made here so that it travels by value:
    the driver's worker, which asks it for its state, doesn't get the shipped package."""

    class Batching(StatefulProcessor):
        """Open lines of one cluster and lane."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getListState("open", "idx BIGINT, us BIGINT, text STRING")
            self.number = handle.getValueState("number", "n BIGINT")

        def _frame(self, key: tuple, closed: list[tuple[str, list[tuple]]]):
            import pandas as pd

            start = self.number.get()[0] if self.number.exists() else 0
            self.number.update((start + len(closed),))
            return pd.DataFrame({
                "cluster_id": [key[0]] * len(closed), "lane": [key[1]] * len(closed), "batch_no": [start + 1 + k for k in range(len(closed))],
                "closed_by": [by for by, _ in closed], "lines": [[dict(zip(("idx", "us", "text"), x)) for x in lines] for _, lines in closed]})

        def _keep(self, held: list[tuple]) -> None:
            """Writes the open lines back, with the one timer of the first of them."""
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:
                self.open.put(held)
                self.handle.registerTimer((held[0][1] + wait_us) // 1000 + 1)
            else:
                self.open.clear()

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
            closed = []
            new = [x for frame in rows for x in zip(frame["idx"].tolist(), frame["us"].tolist(), frame["text"].tolist())]
            for line in sorted(new, key=lambda x: x[0]):
                if held and line[1] - held[0][1] > wait_us:
                    closed.append(("time", held))
                    held = []
                held.append(line)
                if len(held) == batch_size:
                    closed.append(("size", held))
                    held = []
            self._keep(held)
            if closed:
                yield self._frame(key, closed)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
            if held and (held[0][1] + wait_us) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield self._frame(key, [("time", held)])

        def close(self) -> None:
            pass

    return Batching()


def window_batches(lines: DataFrame, batch_size: int = 16, wait: str = "6 hours", delay: str = "1 minute",
                   min_tokens: int = 3, lanes: int = 1) -> DataFrame:
    """``cluster_id, lane, batch_no, closed_by, number_of_logs, first_idx, last_idx,
    cache_key, template, lines`` of each closed batch of the stream ``lines (idx, ts, text)``.

    Null texts are empty lines. Lines more than ``delay`` behind the latest one are late and ignored.
    """
    spark = lines.sparkSession
    ship_package(spark)
    wait_us = spark.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {wait})").first()[0]
    text = F.coalesce("text", F.lit(""))
    timed = lines.select("idx", F.col("ts").cast("timestamp").alias("ts"), text.alias("text")).withWatermark("ts", delay)
    keyed = timed.select(signature(F.col("text"), min_tokens).alias("cluster_id"), F.pmod("idx", F.lit(lanes)).cast("long").alias("lane"),
                         "idx", "ts", F.unix_micros("ts").alias("us"), "text")
    closed = keyed.groupBy("cluster_id", "lane").transformWithStateInPandas(
        _batching(batch_size, wait_us), BATCHES, outputMode="append", timeMode="EventTime")
    first, texts = F.col("lines")[0], F.transform("lines", lambda x: x["text"])
    return closed.select(
        "cluster_id", "lane", "batch_no", "closed_by", F.size("lines").cast("long").alias("number_of_logs"), first["idx"].alias("first_idx"),
        F.element_at("lines", -1)["idx"].alias("last_idx"), cache_key(F.col("cluster_id"), texts).alias("cache_key"),
        fallback_template(first["text"]).alias("template"), "lines")


def write_batches(batches: DataFrame, store: ST.EpochTables, checkpoint: str):
    """Runs the stream over the input available now; each trigger's closed batches are
    its epoch's rows of ``window_batches``, replaced if the trigger is replayed.

    Keyed state with timers needs the RocksDB store: the query, which copies the
    settings when it starts, gets it whatever the session has."""
    conf, provider = batches.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(provider, None)
    conf.set(provider, DEFAULT_CONF[provider])
    try:
        query = (batches.writeStream.outputMode("append")
                 .foreachBatch(lambda batch, epoch: store.write("window_batches", batch, int(epoch)) and None)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.unset(provider) if before is None else conf.set(provider, before)
    query.awaitTermination()
    return query


def read_batches(store: ST.EpochTables) -> DataFrame:
    return store.read("window_batches", TABLE)


def stream_windows_of_events(spark: SparkSession, sf_dir: str, ends: list, root: str, batch_size: int = 16, wait: str = "6 hours",
                             min_tokens: int = 3, lanes: int = 1) -> DataFrame:
    """Batches of ``events`` in several triggers, cut at the times ``ends``, and a last one
    with a single heartbeat long after them, which closes what is open."""
    from logmold.sources.lines import events_to_log_lines
    from logmold.streaming.stream import EVENT_COLUMNS, event_stream, feed

    store = ST.EpochTables(spark, f"{root}/tables")
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    cuts = [F.lit(e).cast("timestamp") for e in ends]
    parts = [events.filter((F.lit(True) if a is None else F.col("ts") >= a) & (F.lit(True) if b is None else F.col("ts") < b))
             for a, b in zip([None, *cuts], [*cuts, None])]
    beat = events.agg(F.max("event_id").alias("e"), F.max("ts").alias("t")).select(
        (F.col("e") + 1).alias("event_id"), (F.col("t") + F.expr("INTERVAL 365 DAYS")).cast(events.schema["ts"].dataType).alias("ts"),
        F.lit(None).cast("long").alias("user_id"), F.lit("heartbeat").alias("event_type"), F.lit(None).cast("string").alias("props"))
    feed(spark, [*parts, beat.select(*EVENT_COLUMNS)], root, lambda stream: write_batches(
        window_batches(events_to_log_lines(stream), batch_size, wait, min_tokens=min_tokens, lanes=lanes), store, f"{root}/checkpoint"))
    return read_batches(store)
