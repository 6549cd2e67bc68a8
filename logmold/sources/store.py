"""Persisted state in Parquet tables partitioned by epoch.

A run (or a stream's trigger) adds its changes as rows of its own epoch, and
readers fold all epochs by a group-by. Writing an epoch again, as a replayed
trigger does, overwrites that partition only (dynamic partition overwrite).
One writer per table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmold.session import stash

CACHE_SCHEMA = "cache_key STRING, template_text STRING, created_at TIMESTAMP, updated_at TIMESTAMP, hit_count BIGINT"
STATS_SCHEMA = ("template_text STRING, usage_count BIGINT, cache_count BIGINT, slm_count BIGINT, "
                "first_seen TIMESTAMP, last_used TIMESTAMP, example_log STRING")
EXAMPLES_SCHEMA = ("template_text STRING, original_log STRING, log_level STRING, event_type STRING, "
                   "source STRING, batch_id BIGINT, created_at TIMESTAMP, "
                   "seq STRUCT<run: BIGINT, idx: BIGINT>")
TREE_SCHEMA = ("snapshot_id BIGINT, created_at TIMESTAMP, batch_id BIGINT, total_logs BIGINT, "
               "level STRING, color STRING, event_type STRING, template_rank INT, template_text STRING, "
               "tree_data STRING")


class EpochTables:
    """The tables below one folder, each Parquet partitioned by ``epoch``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """The rows of all epochs, or of those ``before`` one (a filter on the
        partition column); ``schema`` may name ``epoch``. A table that doesn't
        exist yet is empty; any other failure is raised."""
        columns = self.spark.createDataFrame([], schema).columns
        full = schema if "epoch" in columns else f"{schema}, epoch BIGINT"
        try:
            rows = self.spark.read.schema(full).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], full)
        return (rows if before is None else rows.where(F.col("epoch") < before)).select(*columns)

    def next_epoch(self, name: str) -> int:
        last = self.read(name, "epoch BIGINT").agg(F.max("epoch")).first()[0]
        return 0 if last is None else last + 1

    def write(self, name: str, df: DataFrame, epoch: int | None = None) -> int:
        """Adds ``df`` as the rows of an epoch; rows that it had are replaced."""
        epoch = self.next_epoch(name) if epoch is None else int(epoch)
        df.withColumn("epoch", F.lit(epoch).cast("long")).write.partitionBy("epoch").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{name}")
        return epoch

    def replace(self, name: str, df: DataFrame, epoch: int | None = None) -> int:
        """Makes ``df`` the whole table. ``df`` may read the table: it is
        written to the checkpoint folder first."""
        epoch = self.next_epoch(name) if epoch is None else int(epoch)
        stash(df, name).withColumn("epoch", F.lit(epoch).cast("long")).write.partitionBy("epoch").mode("overwrite").option(
            "partitionOverwriteMode", "static").parquet(f"{self.root}/{name}")
        return epoch


# --- cache (S6, J4, U1, U4, O6) -------------------------------------------------

def load_cache(store: EpochTables, before: int | None = None) -> DataFrame:
    """The whole cache as a DataFrame (never collected); one row per key."""
    rows = store.read("template_cache", CACHE_SCHEMA, before)
    return compact_cache(rows)


def compact_cache(rows: DataFrame) -> DataFrame:
    """Fold appended cache rows: last write of a key wins, hits add up.
    (A partial aggregation: a key repeated in many deltas folds map-side.)
    A hit on a key that retention has removed since then isn't an entry."""
    return rows.groupBy("cache_key").agg(
        F.max_by("template_text", "updated_at").alias("template_text"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.sum("hit_count").cast("long").alias("hit_count"),
    ).where("updated_at is not null")


def cache_get(cache: DataFrame, key: str) -> DataFrame:
    """Point lookup (pushed down to the parquet scan as a filter)."""
    return cache.filter(F.col("cache_key") == F.lit(key)).select("template_text")


def merge_cache(cache: DataFrame, new_entries: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Add the run's new keys and count the batches served by old keys."""
    old = cache.select("cache_key", "template_text", "created_at", "updated_at", "hit_count")
    if hits is None:
        hits = new_entries.sparkSession.createDataFrame([], "cache_key STRING, hits BIGINT")
    return compact_cache(old.unionByName(cache_delta(new_entries, hits)))


def retention_cutoff(run_ts, days: int):
    return F.lit(run_ts).cast("timestamp") - F.make_dt_interval(F.lit(int(days)))


def retain_cache(cache: DataFrame, run_ts, days: int = 30) -> DataFrame:
    """U4: drop entries not written within ``days`` of ``run_ts`` (typed
    timestamps; the reference compares text)."""
    return cache.filter(F.col("updated_at") >= retention_cutoff(run_ts, days))


def expired_count(cache: DataFrame, run_ts, days: int = 30) -> int:
    """U4: how many entries the retention removes."""
    return cache.filter(F.col("updated_at") < retention_cutoff(run_ts, days)).count()


def hottest_cache(cache: DataFrame) -> DataFrame:
    """Cache entries by hit_count, nulls last."""
    return cache.orderBy(F.col("hit_count").desc_nulls_last(), F.col("cache_key"))


def save_cache(store: EpochTables, cache: DataFrame, epoch: int | None = None) -> int:
    return store.replace("template_cache", cache.select("cache_key", "template_text", "created_at",
                                                        "updated_at", "hit_count"), epoch)


def cache_delta(new_entries: DataFrame, hits: DataFrame) -> DataFrame:
    """U1 as an append: new keys plus one hit row per key served from the
    cache; ``compact_cache`` folds them on read."""
    return new_entries.select("cache_key", "template_text", "created_at", "updated_at", "hit_count").unionByName(
        hits.select("cache_key", F.lit(None).cast("string").alias("template_text"),
                    F.lit(None).cast("timestamp").alias("created_at"),
                    F.lit(None).cast("timestamp").alias("updated_at"),
                    F.col("hits").cast("long").alias("hit_count")))


def append_cache(store: EpochTables, entries: DataFrame, epoch: int | None = None) -> int:
    return store.write("template_cache", entries.select("cache_key", "template_text", "created_at",
                                                        "updated_at", "hit_count"), epoch)


# --- stats (S7, U2) -------------------------------------------------------------

def load_stats(store: EpochTables, before: int | None = None) -> DataFrame:
    """The stats of all epochs merged (U3 on read)."""
    rows = store.read("template_stats", STATS_SCHEMA + ", epoch BIGINT", before)
    example_pos = F.when(F.col("example_log") != F.lit(""), F.col("epoch"))
    return rows.groupBy("template_text").agg(
        F.sum("usage_count").cast("long").alias("usage_count"),
        F.sum("cache_count").cast("long").alias("cache_count"),
        F.sum("slm_count").cast("long").alias("slm_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_used").alias("last_used"),
        F.coalesce(F.min_by("example_log", example_pos), F.lit("")).alias("example_log"),
    )


def append_stats(store: EpochTables, run_stats: DataFrame, epoch: int | None = None) -> int:
    """U2 as an append: the run's own stats; readers merge them."""
    cols = [c.split()[0] for c in STATS_SCHEMA.split(",")]
    return store.write("template_stats", run_stats.select(*cols), epoch)


def persisted_template_count(store: EpochTables) -> int:
    """Number of templates in the persisted stats."""
    return load_stats(store).count()


def save_stats(store: EpochTables, stats: DataFrame, epoch: int | None = None) -> int:
    """The merged stats as the whole table."""
    cols = [c.split()[0] for c in STATS_SCHEMA.split(",")]
    return store.replace("template_stats", stats.select(*cols), epoch)


# --- example logs (S10, O4, J5) -----------------------------------------------

def example_rows(logs: DataFrame, run_ts, run_seq: int = 0) -> DataFrame:
    """S10 rows from a run's trace; ``seq`` (run, position) orders rows written at the same time."""
    return logs.select(
        F.col("template").alias("template_text"), F.col("text").alias("original_log"),
        F.col("level").alias("log_level"), "event_type", "source", "batch_id",
        F.lit(run_ts).cast("timestamp").alias("created_at"),
        F.struct(F.lit(int(run_seq)).cast("long").alias("run"), F.col("idx").cast("long").alias("idx")).alias("seq"),
    )


def append_examples(store: EpochTables, rows: DataFrame, epoch: int | None = None) -> int:
    cols = ["template_text", "original_log", "log_level", "event_type", "source", "batch_id", "created_at", "seq"]
    return store.write("example_logs", rows.select(*cols), epoch)


def load_examples(store: EpochTables) -> DataFrame:
    return store.read("example_logs", EXAMPLES_SCHEMA)


def recent_examples(examples: DataFrame, n: int = 5, template: str | None = None) -> DataFrame:
    """Newest ``n`` examples per template (or for one template)."""
    if template is not None:
        examples = examples.filter(F.col("template_text") == F.lit(template))
    w = Window.partitionBy("template_text").orderBy(F.col("created_at").desc(), F.col("seq").desc())
    return examples.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= F.lit(int(n)))


def orphan_examples(examples: DataFrame, stats: DataFrame) -> DataFrame:
    """Example rows whose template has no stats row (declared reference)."""
    return examples.join(stats.select("template_text"), "template_text", "left_anti")


# --- tree history (S8, S9) -----------------------------------------------------

def snapshot_rows(leaf_rows: DataFrame, snapshot_id: int, created_at, latest_batch: int, total_logs: int) -> DataFrame:
    """S8 rows: one JSON leaf per row, tagged with the snapshot header."""
    return leaf_rows.select(
        F.lit(int(snapshot_id)).cast("long").alias("snapshot_id"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
        F.lit(int(latest_batch)).cast("long").alias("batch_id"),
        F.lit(int(total_logs)).cast("long").alias("total_logs"),
        "level", "color", "event_type", F.col("template_rank").cast("int").alias("template_rank"),
        "template_text", F.col("leaf_json").alias("tree_data"),
    )


def append_snapshot(store: EpochTables, rows: DataFrame, epoch: int | None = None) -> int:
    cols = [c.split()[0] for c in TREE_SCHEMA.split(",")]
    return store.write("tree_history", rows.select(*cols), epoch)


def load_tree_history(store: EpochTables) -> DataFrame:
    return store.read("tree_history", TREE_SCHEMA)


def latest_snapshot(history: DataFrame) -> DataFrame:
    """Rows of the newest snapshot; ties on created_at go to the
    larger snapshot_id. The newest header is one small aggregate."""
    newest = history.agg(F.max(F.struct("created_at", "snapshot_id")).alias("m")).select("m.snapshot_id")
    return history.join(newest, "snapshot_id", "left_semi")


def fold(store: EpochTables, target: EpochTables) -> None:
    """Copies the cache and the stats, folded, into the tables below another
    folder as their first epoch: bounds the work of later reads."""
    save_cache(target, load_cache(store), 0)
    save_stats(target, load_stats(store), 0)
