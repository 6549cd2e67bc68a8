"""Template tree.

The tree is computed at leaf grain -- one row per (level, event bucket,
template) -- which is the primary product. Instances and examples are
per-leaf top-k's: ``row_number() <= k`` lets Spark insert a partial window
group limit before the shuffle, so a leaf holding a third of all lines sends
at most k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmold.functions.text import level_color, pct, source_norm, tree_bucket, tree_level
from logmold.operators.batching import exclusive_running_sum
from logmold.session import stash

LEAF = ["level", "event_type", "template_text"]
DEFAULT_INSTANCE_LIMIT = 25
EXAMPLES_PER_LEAF = 3
RAW_OUTPUTS_PER_LEAF = 3


def latest_batch_id(logs: DataFrame) -> int:
    """Largest batch id of the run, 0 for an empty run (one scalar)."""
    row = logs.agg(F.coalesce(F.max("batch_id"), F.lit(0)).alias("m")).first()
    return int(row["m"]) if row else 0


def tree_lines(logs: DataFrame, latest: int | Column) -> DataFrame:
    """Per line: leaf key, normalised source and the current-batch flag."""
    latest_col = latest if isinstance(latest, Column) else F.lit(int(latest))
    cols = [
        tree_level(F.col("level")).alias("level"),
        tree_bucket(F.col("text"), F.col("event_type")).alias("event_type"),
        F.col("template").alias("template_text"),
        source_norm(F.col("source")).alias("source"),
        "batch_id", "idx", "text", "cluster_id", "masked",
        (F.col("batch_id") == latest_col).alias("in_current_batch"),
    ]
    if "slm_raw_output" in logs.columns:
        cols.append("slm_raw_output")
    return logs.select(*cols)


def tree_leaves(lines: DataFrame, stats: DataFrame | None, latest: int,
                show_current_batch: bool = True, instance_limit: int = DEFAULT_INSTANCE_LIMIT) -> DataFrame:
    """A6 + T1 + T3 + J3: one row per leaf with counts, ratios, the current
    batch overlay and the global stats of its template."""
    is_cache = F.col("source") == F.lit("CACHE")
    leaves = lines.groupBy(*LEAF).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(is_cache).alias("cache"),
        F.count_if(~is_cache).alias("slm"),
        F.count_if(F.col("in_current_batch")).alias("current"),
        F.min(F.struct("batch_id", "idx")).alias("first_pos"),
    )
    current = F.col("current") if show_current_batch else F.lit(0).cast("long")
    limit = int(instance_limit)
    out = leaves.select(
        *LEAF,
        "count", "cache", "slm",
        pct(F.col("cache"), F.col("count")).alias("cache_pct"),
        pct(F.col("slm"), F.col("count")).alias("slm_pct"),
        current.alias("current_batch_count"),
        (current > 0).alias("highlight_current_batch"),
        F.col("count").alias("instances_total"),
        (F.col("count") > F.lit(limit)).alias("instances_truncated"),
        F.greatest(F.col("count") - F.lit(limit), F.lit(0)).alias("omitted_instances"),
        F.col("first_pos.batch_id").alias("first_batch_id"),
        F.col("first_pos.idx").alias("first_idx"),
        F.lit(int(latest)).cast("long").alias("latest_batch_id"),
    )
    if stats is None:
        return out.select(
            "*", F.lit(0).cast("long").alias("global_count"),
            F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"),
        )
    st = stats.select(
        "template_text", F.col("usage_count").alias("global_count"),
        "first_seen", F.col("last_used").alias("last_seen"),
    )
    return out.join(st, "template_text", "left").select(
        *[c for c in out.columns],
        F.coalesce(F.col("global_count"), F.lit(0)).cast("long").alias("global_count"),
        "first_seen", "last_seen",
    )


def tree_instances(lines: DataFrame, instance_limit: int = DEFAULT_INSTANCE_LIMIT) -> DataFrame:
    """W3 + T5: the first ``instance_limit`` lines of every leaf in trace order."""
    w = Window.partitionBy(*LEAF).orderBy("batch_id", "idx")
    return (
        lines.select(*LEAF, "batch_id", "idx", "text", "source", "cluster_id", "masked", "in_current_batch")
        .withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("rank") <= F.lit(int(instance_limit)))
        .select(*LEAF, "rank", F.col("text").alias("original_log"), "source", "batch_id",
                "cluster_id", "masked", "in_current_batch")
    )


def tree_examples(lines: DataFrame, n: int = EXAMPLES_PER_LEAF) -> DataFrame:
    """The first ``n`` distinct non-empty lines of every leaf, trace order."""
    firsts = (
        lines.filter(F.col("text") != F.lit(""))
        .groupBy(*LEAF, "text")
        .agg(F.min(F.struct("batch_id", "idx")).alias("pos"))
    )
    w = Window.partitionBy(*LEAF).orderBy("pos")
    return (
        firsts.withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("rank") <= F.lit(int(n)))
        .select(*LEAF, "rank", F.col("text").alias("example_log"))
    )


def tree_debug(lines: DataFrame, n_raw: int = RAW_OUTPUTS_PER_LEAF) -> DataFrame:
    """A7 flat: distinct cluster ids of every leaf and at most ``n_raw``
    distinct non-empty raw outputs (sorted), as (leaf, kind, value) rows."""
    clusters = lines.select(*LEAF, F.lit("cluster_id").alias("kind"), F.col("cluster_id").alias("value")).distinct()
    if "slm_raw_output" not in lines.columns:
        return clusters
    raws = (
        lines.filter(F.col("slm_raw_output") != F.lit(""))
        .select(*LEAF, F.col("slm_raw_output").alias("value")).distinct()
        .withColumn("_r", F.row_number().over(Window.partitionBy(*LEAF).orderBy("value")))
        .filter(F.col("_r") <= F.lit(int(n_raw)))
        .select(*LEAF, F.lit("raw_slm_output").alias("kind"), "value")
    )
    return clusters.unionByName(raws)


def _utc_iso(ts: Column, session_tz: str) -> Column:
    """ISO-8601 text of an instant in UTC (``...+00:00``), whatever the
    session time zone: shift so the session renders the UTC wall clock."""
    shifted = F.to_utc_timestamp(ts, session_tz)
    return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def leaf_documents(leaves: DataFrame, instances: DataFrame, examples: DataFrame,
                   debug: DataFrame | None = None, cluster_ids: bool = False) -> DataFrame:
    """One JSON-ready struct per leaf. With the rows of :func:`tree_debug`
    it has at most ``RAW_OUTPUTS_PER_LEAF`` raw outputs and the number of the
    leaf's cluster ids, or with ``cluster_ids`` all of them, sorted: a general
    template may have any number. The other arrays are bounded."""
    tz = leaves.sparkSession.conf.get("spark.sql.session.timeZone")
    inst = instances.groupBy(*LEAF).agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "original_log", "source", "batch_id", "cluster_id", "masked", "in_current_batch",
        ))).alias("_inst")
    )
    ex = examples.groupBy(*LEAF).agg(F.array_sort(F.collect_list(F.struct("rank", "example_log"))).alias("_ex"))
    joined = leaves.join(inst, LEAF, "left").join(ex, LEAF, "left")
    fields = [
        "template_text", "count", "global_count",
        _utc_iso(F.col("first_seen"), tz).alias("first_seen"),
        _utc_iso(F.col("last_seen"), tz).alias("last_seen"),
        F.struct("cache", "slm", "cache_pct", "slm_pct").alias("source"),
        "current_batch_count", "highlight_current_batch",
        F.coalesce(F.transform("_inst", lambda x: x.dropFields("rank")), F.array()).alias("instances"),
        "instances_total", "instances_truncated", "omitted_instances",
        F.coalesce(F.transform("_ex", lambda x: x["example_log"]), F.array()).alias("example_logs"),
    ]
    if debug is not None:
        of_cluster = F.col("kind") == "cluster_id"
        clusters, none = ("cluster_ids", F.array()) if cluster_ids else ("cluster_count", F.lit(0))
        dbg = debug.groupBy(*LEAF).agg(
            (F.array_sort(F.collect_set(F.when(of_cluster, F.col("value")))) if cluster_ids else F.count_if(of_cluster)).alias(clusters),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "raw_slm_output", F.col("value")))).alias("raw_slm_outputs"),
        )
        joined = joined.join(dbg, LEAF, "left")
        fields.append(F.struct(
            F.coalesce(clusters, none).alias(clusters),
            F.col("cache").alias("cache_hit"), F.col("slm").alias("cache_miss"),
            F.coalesce("raw_slm_outputs", F.array()).alias("raw_slm_outputs"),
        ).alias("debug"))
    return joined.select(
        "level", "event_type", level_color(F.col("level")).alias("color"),
        "count", "first_batch_id", "first_idx",
        F.struct(*fields).alias("leaf"),
    )


def leaf_ranks(leaves: DataFrame) -> DataFrame:
    """``template_rank`` of each leaf inside its (level, event bucket):
    count desc, then first appearance.

    Two nested running sums instead of a window over a bucket: leaves with a
    larger count, then leaves of the same count first seen in an earlier
    batch. Only leaves of one batch (at most its lines) share a window.
    """
    narrow = leaves.select(*LEAF, (-F.col("count")).alias("_less"), "first_batch_id", "first_idx")
    bucket = ["level", "event_type"]
    by_count = exclusive_running_sum(
        narrow.groupBy(*bucket, "_less").agg(F.count(F.lit(1)).alias("_n")), bucket, "_less", "_n", "_above")
    by_batch = exclusive_running_sum(
        narrow.groupBy(*bucket, "_less", "first_batch_id").agg(F.count(F.lit(1)).alias("_n")),
        [*bucket, "_less"], "first_batch_id", "_n", "_before")
    w = Window.partitionBy(*bucket, "_less", "first_batch_id").orderBy("first_idx")
    return (narrow.withColumn("_own", F.row_number().over(w))
            .join(by_count.select(*bucket, "_less", "_above"), [*bucket, "_less"])
            .join(by_batch.select(*bucket, "_less", "first_batch_id", "_before"), [*bucket, "_less", "first_batch_id"])
            .select(*LEAF, (F.col("_above") + F.col("_before") + F.col("_own")).cast("long").alias("template_rank")))


def leaf_json(docs: DataFrame) -> DataFrame:
    """T2 flat: one JSON leaf per row with its path and rank (O5). The leaves are
    written once; the ranks, which need their counts several times, read that."""
    flat = stash(docs.withColumn("template_text", F.col("leaf.template_text")), "tree-leaves")
    return flat.join(leaf_ranks(flat), LEAF).select(
        "level", "color", "event_type", "template_rank", "template_text", F.to_json("leaf").alias("leaf_json"))


# Reading a tree document (a snapshot or a sample file) back.
LEAF_SCHEMA = (
    "template_text STRING, count BIGINT, global_count BIGINT, first_seen STRING, last_seen STRING, "
    "source STRUCT<cache: BIGINT, slm: BIGINT, cache_pct: DOUBLE, slm_pct: DOUBLE>, "
    "current_batch_count BIGINT, highlight_current_batch BOOLEAN, "
    "instances ARRAY<STRUCT<original_log: STRING, source: STRING, batch_id: BIGINT, cluster_id: STRING, "
    "masked: STRING, in_current_batch: BOOLEAN>>, "
    "instances_total BIGINT, instances_truncated BOOLEAN, omitted_instances BIGINT, example_logs ARRAY<STRING>, "
    "debug STRUCT<cluster_ids: ARRAY<STRING>, cluster_count: BIGINT, cache_hit: BIGINT, cache_miss: BIGINT, "
    "raw_slm_outputs: ARRAY<STRING>>"
)
TREE_DOC_SCHEMA = (
    "generated_at STRING, latest_batch_id BIGINT, show_current_batch BOOLEAN, debug_mode BOOLEAN, "
    f"total_logs BIGINT, levels MAP<STRING, STRUCT<color: STRING, event_types: MAP<STRING, "
    f"STRUCT<templates: ARRAY<STRUCT<{LEAF_SCHEMA}>>>>>>"
)


def read_tree_json(spark, path: str) -> DataFrame:
    """Tree documents from JSON files (one document per file) with an
    explicit schema -- nothing inferred."""
    return spark.read.schema(TREE_DOC_SCHEMA).option("multiLine", True).json(path)


def parse_tree_json(docs: DataFrame, col: str = "tree_data") -> DataFrame:
    """Tree documents held as JSON text (snapshot rows) -> document rows."""
    return docs.select(F.from_json(F.col(col), TREE_DOC_SCHEMA).alias("d")).select("d.*")


def tree_leaf_rows(docs: DataFrame) -> DataFrame:
    """Flatten documents to one row per leaf: level, color, event_type, rank, leaf fields."""
    lv = docs.select("latest_batch_id", "total_logs", F.explode("levels").alias("level", "lv"))
    ev = lv.select("latest_batch_id", "total_logs", "level", F.col("lv.color").alias("color"),
                   F.explode("lv.event_types").alias("event_type", "ev"))
    return ev.select("latest_batch_id", "total_logs", "level", "color", "event_type",
                     F.posexplode("ev.templates").alias("template_rank", "leaf")).select(
        "latest_batch_id", "total_logs", "level", "color", "event_type",
        (F.col("template_rank") + 1).alias("template_rank"), "leaf.*")
