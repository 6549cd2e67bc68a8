"""Clustering and batching.

Semantics: lines are grouped by signature (the cluster id); clusters are
ordered by their first line; each cluster is cut into consecutive runs of
``batch_size`` lines in input order; batches are numbered 1..N over clusters
in that order.

Plan shape (no window partition grows with the data: every running sum is
split into nested ranges, see ``exclusive_running_sum``):

1. ``blocks``: count lines per (cluster, idx block), ``block = idx div B``
   (partial aggregation, so one hot cluster costs one row per block).
2. ``clusters``: first idx and size per cluster, from ``blocks``.
3. Global batch base per cluster: a running sum of batch counts in
   first-appearance order, over nested ranges of first_idx.
4. Offset of each (cluster, block) inside its cluster: a running sum over
   the blocks of one cluster, over nested ranges of blocks.
5. Lines: ``row_number`` inside (cluster, block) -- at most B rows per window
   partition -- plus the offsets from 3 and 4 give the batch id. The join back
   is on (cluster, block), the same keys the window shuffled on, so the line
   side is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmold.functions.text import cache_key, signature
from logmold.session import ensure_checkpoint_dir

DEFAULT_BATCH_SIZE = 16
DEFAULT_MIN_TOKENS = 3
# idx values per block. Bounds the rows of one window partition over lines.
DEFAULT_BLOCK = 1 << 20
# first_idx values per block of clusters (level 1 of the global prefix sum).
DEFAULT_CLUSTER_BLOCK = 1 << 20
# Width (bits) of one level of the nested running sums.
DEFAULT_RANGE_BITS = 20


def _idiv(col: str, n: int):
    """Exact integer division of a BIGINT column (no double rounding)."""
    return F.expr(f"`{col}` div {int(n)}")


def _idiv_expr(expr: str, n: int):
    return F.expr(f"({expr}) div {int(n)}")


def _check_batch_size(batch_size: int) -> None:
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")


def with_signature(lines: DataFrame, min_tokens: int = DEFAULT_MIN_TOKENS) -> DataFrame:
    """F1/F2 as a column ``cluster_id``."""
    return lines.withColumn("cluster_id", signature(F.col("text"), min_tokens))


def cluster_blocks(signed: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """(cluster_id, block, cnt, block_first_idx): partial-aggregated line counts."""
    return (
        signed.select("cluster_id", "block" if "block" in signed.columns else _idiv("idx", block).alias("block"), "idx")
        .groupBy("cluster_id", "block")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("idx").alias("block_first_idx"))
    )


def exclusive_running_sum(df: DataFrame, keys: list[str], order: str, weight: str, out: str,
                          bits: tuple[int, ...] = (20, 40)) -> DataFrame:
    """``out`` = sum of ``weight`` over the rows with the same ``keys`` and a
    smaller ``order`` (unique within ``keys``), without a window over all rows.

    ``order`` is cut into nested ranges of ``2**bits[i]`` values; sums per range
    are partial aggregates, each level is a running sum inside its parent
    range, and the levels are added back top-down. Every window partition then
    holds at most ``2**(bits[i+1]-bits[i])`` rows (``2**bits[0]`` for the
    rows themselves, ``2**(63-bits[-1])`` per key at the top), however sparse
    or skewed the values are.
    """
    names = [f"_r{i}" for i in range(len(bits))]
    d = df
    for n, b in zip(names, bits):
        d = d.withColumn(n, _idiv(order, 1 << b))
    unb = Window.unboundedPreceding
    top = d.groupBy(*keys, names[-1]).agg(F.sum(weight).alias("_s"))
    w = Window.partitionBy(*keys).orderBy(names[-1]).rowsBetween(unb, -1) if keys else \
        Window.orderBy(names[-1]).rowsBetween(unb, -1)
    prev = top.select(*keys, names[-1], F.coalesce(F.sum("_s").over(w), F.lit(0)).cast("long").alias("_base"))
    for i in range(len(names) - 2, -1, -1):
        lvl = d.groupBy(*keys, *names[i:]).agg(F.sum(weight).alias("_s"))
        w = Window.partitionBy(*keys, names[i + 1]).orderBy(names[i]).rowsBetween(unb, -1)
        lvl = lvl.withColumn("_within", F.coalesce(F.sum("_s").over(w), F.lit(0)))
        prev = lvl.join(prev, [*keys, *names[i + 1:]]).select(
            *keys, *names[i:], (F.col("_base") + F.col("_within")).cast("long").alias("_base"))
    w = Window.partitionBy(*keys, names[0]).orderBy(order).rowsBetween(unb, -1)
    rows = d.withColumn("_within", F.coalesce(F.sum(weight).over(w), F.lit(0)))
    return rows.join(prev, [*keys, *names]).withColumn(
        out, (F.col("_base") + F.col("_within")).cast("long")).drop(*names, "_within", "_base")


def clusters_from_blocks(blocks: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE,
                         cluster_block: int = DEFAULT_CLUSTER_BLOCK,
                         range_bits: int = DEFAULT_RANGE_BITS) -> DataFrame:
    """G1 + G3: one row per cluster with first_idx, n_lines, n_batches and the
    number of batches of all earlier clusters (``batch_base``), clusters in
    first-appearance order. ``cluster_block`` sets the finest range of the
    running sum (a power of two)."""
    _check_batch_size(batch_size)
    clusters = (
        blocks.groupBy("cluster_id")
        .agg(F.min("block_first_idx").alias("first_idx"), F.sum("cnt").alias("n_lines"))
        .withColumn("n_batches", F.expr(f"(n_lines + {batch_size - 1}) div {batch_size}"))
    )
    fine = max(1, int(cluster_block).bit_length() - 1)
    return exclusive_running_sum(clusters, [], "first_idx", "n_batches", "batch_base", (fine, fine + range_bits))


def assign_batches(lines: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE,
                   min_tokens: int = DEFAULT_MIN_TOKENS, block: int = DEFAULT_BLOCK,
                   cluster_block: int = DEFAULT_CLUSTER_BLOCK, range_bits: int = DEFAULT_RANGE_BITS) -> DataFrame:
    """Lines with cluster_id, cluster_pos and batch_id (see ``plan_batches``)."""
    return plan_batches(lines, batch_size, min_tokens, block, cluster_block, range_bits)[0]


def plan_batches(lines: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE,
                 min_tokens: int = DEFAULT_MIN_TOKENS, block: int = DEFAULT_BLOCK,
                 cluster_block: int = DEFAULT_CLUSTER_BLOCK,
                 range_bits: int = DEFAULT_RANGE_BITS) -> tuple[DataFrame, DataFrame]:
    """Every line with cluster_id, position in cluster and batch_id,
    plus the cluster table (cluster_id, first_idx, n_lines, n_batches,
    batch_base), which is small and read from the checkpointed block table.

    Input: ``(idx, text, ...)`` with unique ``idx``; a source whose ``idx`` has
    gaps gives a ``block`` column (not falling as idx rises) that cuts it into
    about as many lines as ``block`` says. Output adds
    ``cluster_id, cluster_pos (1-based), batch_id (1-based)``.

    The line text is shuffled once, by (cluster_id, block); the row numbers
    and the join with the offsets run on that exchange. The block counts are
    a partial aggregation of the same scan.
    """
    _check_batch_size(batch_size)
    # A line without a position cannot be batched: fail instead of dropping
    # it. The explicit not-null filters are then always true; stating them
    # keeps the join-inferred ones from making the branches below the shared
    # exchange differ (which would stop Spark from reusing it).
    idx = F.when(F.col("idx").isNull(), F.raise_error(F.lit("idx must not be null"))).otherwise(F.col("idx"))
    own_block = F.col("block") if "block" in lines.columns else _idiv("idx", block)
    checked = lines.select(idx.cast("long").alias("idx"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                           own_block.alias("block"))
    signed = with_signature(checked, min_tokens)
    signed = signed.filter(F.col("block").isNotNull() & F.col("cluster_id").isNotNull() & F.col("idx").isNotNull())
    # Block counts aggregate map-side straight from the scan (one row per
    # (cluster, block) per task crosses the network); only the line branch
    # moves the text, through the explicit (cluster, block) exchange. The
    # block table feeds two branches (cluster order and block offsets), so
    # it is written once to the shared checkpoint folder: the scan and the
    # signature regexes then run twice in all, not three times, and a lost
    # executor does not lose it.
    ensure_checkpoint_dir(lines.sparkSession)
    blocks = cluster_blocks(signed, block).checkpoint(eager=True)
    by_block = signed.repartition("cluster_id", "block")
    clusters = clusters_from_blocks(blocks, batch_size, cluster_block, range_bits)
    # Offset of each block inside its cluster: a running sum over the blocks
    # of one cluster, itself in ranges of 2**range_bits blocks (a cluster holding
    # every line still gives bounded window partitions).
    offsets = (
        exclusive_running_sum(blocks, ["cluster_id"], "block", "cnt", "line_base", (range_bits,))
        .join(clusters.select("cluster_id", "batch_base"), "cluster_id")
        .select("cluster_id", "block", "line_base", "batch_base")
    )
    rn = F.row_number().over(Window.partitionBy("cluster_id", "block").orderBy("idx"))
    numbered = by_block.withColumn("_rn", rn)
    out = numbered.join(offsets, ["cluster_id", "block"])
    out = out.withColumn("cluster_pos", (F.col("line_base") + F.col("_rn")).cast("long"))
    assigned = out.withColumn(
        "batch_id", F.col("batch_base") + _idiv_expr("cluster_pos - 1", batch_size) + F.lit(1)
    ).drop("_rn", "line_base", "batch_base", "block")
    return assigned, clusters


def collect_batches(assigned: DataFrame) -> DataFrame:
    """G4 + F11: one row per batch with its ordered lines and cache key.

    A batch holds at most ``batch_size`` lines, so the collected array is
    bounded. Output: batch_id, cluster_id, number_of_logs, lines
    (array<struct<idx, text>> in input order), first_idx, first_text, cache_key.
    """
    # Explicit exchange: every consumer of the batch table shares this one
    # shuffle of the line text (the aggregation above it is cheap to repeat).
    # Batch ids are never null; stated here, the filters that joins infer don't
    # make the branches below the exchange differ.
    by_batch = assigned.select("batch_id", "cluster_id", "idx", "text").where(F.col("batch_id").isNotNull()).repartition("batch_id")
    grouped = by_batch.groupBy("batch_id").agg(
        F.min("cluster_id").alias("cluster_id"),
        F.count(F.lit(1)).alias("number_of_logs"),
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("lines"),
    )
    texts = F.transform("lines", lambda x: x["text"])
    return grouped.select(
        "batch_id", "cluster_id", "number_of_logs", "lines",
        F.col("lines")[0]["idx"].alias("first_idx"),
        F.col("lines")[0]["text"].alias("first_text"),
        cache_key(F.col("cluster_id"), texts).alias("cache_key"),
    )


def naive_batches(lines: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE,
                  min_tokens: int = DEFAULT_MIN_TOKENS) -> DataFrame:
    """Reference form with plain windows (tests only: one task per cluster and
    one task for the global numbering)."""
    signed = with_signature(lines, min_tokens)
    w = Window.partitionBy("cluster_id").orderBy("idx")
    pos = signed.withColumn("cluster_pos", F.row_number().over(w)).withColumn(
        "first_idx", F.min("idx").over(Window.partitionBy("cluster_id"))
    ).withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy("cluster_id")))
    clusters = pos.select("cluster_id", "first_idx", "n_lines").distinct().withColumn(
        "n_batches", F.floor((F.col("n_lines") + batch_size - 1) / batch_size)
    ).withColumn(
        "batch_base",
        F.coalesce(F.sum("n_batches").over(Window.orderBy("first_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    return pos.join(clusters.select("cluster_id", "batch_base"), "cluster_id").withColumn(
        "batch_id", (F.col("batch_base") + F.floor((F.col("cluster_pos") - 1) / batch_size) + 1).cast("long")
    ).select("idx", "text", "cluster_id", F.col("cluster_pos").cast("long"), "batch_id")
