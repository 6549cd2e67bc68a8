"""The composed parse (G5, G6, J1, J2, W4, P1): lines -> batches -> templates.

Shuffles of the line text: two (by (cluster, block) for the numbering, by
batch_id for the batch arrays). Everything at key grain is narrow: the cache
lookup, the first batch of every key (W4, a partial aggregation instead of a
window, so a key repeated in a third of all batches is still spread over
tasks) and the template generation of the misses only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.functions.text import event_type, log_level, mask_dynamic_parts
from logmold.operators.batching import (
    DEFAULT_BATCH_SIZE,
    DEFAULT_BLOCK,
    DEFAULT_CLUSTER_BLOCK,
    DEFAULT_MIN_TOKENS,
    collect_batches,
    plan_batches,
)
from logmold.operators.generators import FallbackGenerator, TemplateGenerator
from logmold.session import stash



@dataclass
class ParseResult:
    """Trace tables of one run.

    * ``logs``: one row per line -- idx, text, batch_id, cluster_id, template,
      source, slm_raw_output, level, event_type, masked (LogTrace + position).
    * ``batches``: one row per batch -- batch_id, cluster_id, number_of_logs,
      cache_key, source, template, slm_raw_output, used_fallback, lines.
    * ``keys``: one row per cache key of the run -- cache_key, hit (found in
      the persisted cache), first_batch_id, key_batches, template,
      raw_output, used_fallback.
    * ``clusters``: one row per cluster -- cluster_id, first_idx, n_lines,
      n_batches, batch_base.
    """

    logs: DataFrame
    batches: DataFrame
    keys: DataFrame
    clusters: DataFrame | None = None
    written: bool = False

    def over(self, batches: DataFrame) -> ParseResult:
        """The run as its batch table says, once that has been written: lines,
        keys, counts and all that is made of them read it and nothing is parsed again."""
        return ParseResult(lines_of(batches), batches, keys_of(batches), self.clusters, written=True)

    def stored(self, name: str = "run") -> ParseResult:
        """The run with its batch table written once to the shared folder."""
        return self.over(stash(self.batches, name))

    def _total(self, of_batches: Column, of_clusters: Column) -> int:
        """One number of the run: from its batch table where that is written (one
        pass over narrow columns), else from the small cluster table."""
        table, total = (self.batches, of_batches) if self.written else (self.clusters, of_clusters)
        return int(table.agg(F.coalesce(total, F.lit(0)).alias("n")).first()["n"])

    def line_count(self) -> int:
        """Lines of the run; no pass over them."""
        return self._total(F.sum("number_of_logs"), F.sum("n_lines"))

    def batch_count(self) -> int:
        """The latest batch id (ids are dense 1..N); no pass over the lines."""
        return self._total(F.count(F.lit(1)), F.sum("n_batches"))


def lookup_keys(batches: DataFrame, cache: DataFrame | None, generator: TemplateGenerator) -> DataFrame:
    """J1 + J2 + W4 + P1 at key grain."""
    # The cluster id is read here too, so that both sides need the same columns of the
    # lines and share one shuffle of their text.
    cols = [F.col("batch_id"), F.col("cache_key"), F.when(F.col("cluster_id").isNotNull(), F.col("first_text")).alias("first_text")]
    if generator.needs_lines:
        cols.append(F.transform("lines", lambda x: x["text"]).alias("texts"))
    # Numbers only in the aggregate (it hashes, and doesn't sort); the text of
    # a key's first batch is fetched by its id alone, by which the batches are
    # dealt out already: their texts stay where they are.
    firsts = batches.groupBy("cache_key").agg(
        F.min("batch_id").alias("first_batch_id"), F.count(F.lit(1)).alias("key_batches"))
    per_key = firsts.join(batches.select(*cols).withColumnRenamed("batch_id", "first_batch_id").drop("cache_key"), "first_batch_id")
    if cache is not None:
        hits = cache.select("cache_key", F.col("template_text").alias("cached_template"),
                            F.lit(True).alias("_hit"))
        per_key = per_key.join(hits, "cache_key", "left")
    else:
        per_key = per_key.withColumn("cached_template", F.lit(None).cast("string")).withColumn(
            "_hit", F.lit(None).cast("boolean"))
    per_key = per_key.withColumn("hit", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")

    inline = generator.columns(F.col("first_text"))
    if inline is not None:
        t, raw, fb = inline
        gen_t, gen_raw, gen_fb = t, raw, fb
        joined = per_key
    else:
        generated = generator.generate(per_key.filter(~F.col("hit")))
        if generator.nondeterministic:
            # One answer per key even if a task is retried: cut the lineage
            # into the shared checkpoint folder before the answer is reused.
            generated = generated.checkpoint(eager=True)
        joined = per_key.join(
            generated.select("cache_key", F.col("template").alias("_t"), F.col("raw_output").alias("_raw"),
                             F.col("used_fallback").alias("_fb")),
            "cache_key", "left",
        )
        gen_t, gen_raw, gen_fb = F.col("_t"), F.coalesce(F.col("_raw"), F.lit("")), F.col("_fb")
    hit = F.col("hit")
    return joined.select(
        "cache_key", "hit", "first_batch_id", "key_batches",
        F.when(hit, F.col("cached_template")).otherwise(gen_t).alias("template"),
        F.when(hit, F.lit("")).otherwise(gen_raw).alias("raw_output"),
        F.when(hit, F.lit(False)).otherwise(gen_fb).alias("used_fallback"),
    )


def parse_logs(
    lines: DataFrame,
    cache: DataFrame | None = None,
    generator: TemplateGenerator | None = None,
    batch_size: int = DEFAULT_BATCH_SIZE,
    min_tokens: int = DEFAULT_MIN_TOKENS,
    block: int = DEFAULT_BLOCK,
    cluster_block: int = DEFAULT_CLUSTER_BLOCK,
) -> ParseResult:
    """Parse ``lines(idx, text)`` with an optional persisted ``cache``
    (cache_key, template_text, ...)."""
    generator = generator or FallbackGenerator()
    assigned, clusters = plan_batches(lines.select("idx", "text", *[c for c in ("block",) if c in lines.columns]), batch_size, min_tokens, block, cluster_block)
    batches = collect_batches(assigned)
    keys = lookup_keys(batches, cache, generator)

    first = F.col("batch_id") == F.col("first_batch_id")
    per_batch = batches.select("batch_id", "cache_key").join(keys, "cache_key").select(
        "batch_id",
        F.when(~F.col("hit") & first, F.lit("SLM")).otherwise(F.lit("CACHE")).alias("source"),
        "template",
        F.when(~F.col("hit") & first, F.col("raw_output")).otherwise(F.lit("")).alias("slm_raw_output"),
        F.when(~F.col("hit") & first, F.col("used_fallback")).otherwise(F.lit(False)).alias("used_fallback"),
    )
    # ``batches`` is hash-partitioned by batch_id already: only the per-batch
    # side moves; the join's kind is left to the planner.
    trace_batches = batches.join(per_batch, "batch_id").select(
        "batch_id", "cluster_id", "number_of_logs", "cache_key", "source", "template",
        "slm_raw_output", "used_fallback", "lines",
    )
    return ParseResult(logs=lines_of(trace_batches), batches=trace_batches, keys=keys, clusters=clusters)


def lines_of(batches: DataFrame) -> DataFrame:
    """The ``logs`` table of a run from its ``batches``."""
    logs = batches.select(
        "batch_id", "cluster_id", "template", "source", "slm_raw_output", F.explode("lines").alias("l")
    ).select(
        F.col("l.idx").alias("idx"), F.col("l.text").alias("text"), "batch_id", "cluster_id",
        "template", "source", "slm_raw_output",
    )
    return logs.select(
        "*",
        log_level(F.col("text")).alias("level"),
        event_type(F.col("text")).alias("event_type"),
        mask_dynamic_parts(F.col("text")).alias("masked"),
    )


def keys_of(batches: DataFrame) -> DataFrame:
    """The ``keys`` table of a run from its ``batches``: a key that missed has
    one generated batch, its first."""
    per_key = batches.groupBy("cache_key").agg(
        F.count_if(F.col("source") == "SLM").alias("generated"),
        F.min("batch_id").alias("first_batch_id"), F.count(F.lit(1)).alias("key_batches"))
    first = batches.select(F.col("batch_id").alias("first_batch_id"), "template", F.col("slm_raw_output").alias("raw_output"), "used_fallback")
    return per_key.join(first, "first_batch_id").select(
        "cache_key", (F.col("generated") == 0).alias("hit"), "first_batch_id", "key_batches", "template", "raw_output", "used_fallback")


def parse_templates(lines: DataFrame, **kwargs) -> DataFrame:
    """One template per input line (idx, template); order by idx to print."""
    return parse_logs(lines, **kwargs).logs.select("idx", "template")


def new_cache_entries(result: ParseResult, run_ts) -> DataFrame:
    """Cache rows written by a run (U1 input): every key that missed.

    ``hit_count`` counts batches served from the cache (later batches of the
    same key in this run).
    """
    ts = F.lit(run_ts).cast("timestamp") if not hasattr(run_ts, "_jc") else run_ts
    return result.keys.filter(~F.col("hit")).select(
        "cache_key",
        F.col("template").alias("template_text"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
        (F.col("key_batches") - F.lit(1)).cast("long").alias("hit_count"),
    )


def cache_hits(result: ParseResult) -> DataFrame:
    """Keys served from the persisted cache in this run: cache_key, hits."""
    return result.keys.filter(F.col("hit")).select("cache_key", F.col("key_batches").cast("long").alias("hits"))
