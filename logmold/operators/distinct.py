"""Distinct counts over runs (A1 with U3): theta sketches as mergeable state.

Sums of runs add up, distinct counts don't: a template of two runs is one
template. Each run leaves sketches of hashes as rows of its epoch, and readers
merge them by a group-by, without the lines: of all runs, of the runs before
one, what a run has in common with them, and what is new in it.

A sketch is exact up to ``2 ** LOG_ENTRIES`` distinct values. Beyond that it
keeps about so many hashes (8 bytes each, at most twice as many), and its
standard error is ``1 / sqrt(2 ** LOG_ENTRIES)`` of the number counted; for what
two sides share, or one has alone, of the number that both have together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.session import stash
from logmold.sources.store import EpochTables

LOG_ENTRIES = 14
#: Sketches of a hot template, or of all templates, are merged in so many
#: pieces first: one from each group of tasks, then one of the pieces.
PIECES = 256
SKETCHES_SCHEMA = "scope STRING, name STRING, sketch BINARY"
TABLE = "distinct_sketches"


def _hashed(col: Column) -> Column:
    """64 bits of a value; null stays null, which sketches leave out. (A sketch
    of text would leave out empty text, too.)"""
    return F.when(col.isNotNull(), F.xxhash64(col))


def _counted(col: Column) -> Column:
    return F.theta_sketch_agg(_hashed(col), F.lit(LOG_ENTRIES))


def _merged(name: str) -> Column:
    return F.theta_union_agg(name, F.lit(LOG_ENTRIES))


def run_sketches(logs: DataFrame) -> DataFrame:
    """``scope, name, sketch`` of a run's ``logs (template, text, cluster_id)``:
    the ``lines`` of each template (scope ``template``, name: the template), and
    the ``templates``, ``clusters`` and ``lines`` of the run (scope ``run``).

    Lines that are equal are one. Null templates, texts and clusters aren't
    counted; empty ones are. An empty run has the three sketches of the run,
    each of nothing.
    """
    pieces = (logs.withColumn("_piece", F.pmod(F.spark_partition_id(), F.lit(PIECES)))
              .groupBy("template", "_piece").agg(_counted(F.col("text")).alias("lines"), _counted(F.col("cluster_id")).alias("clusters")))
    each = stash(pieces.groupBy("template").agg(_merged("lines").alias("lines"), _merged("clusters").alias("clusters")), "template-sketches")
    measures = ["templates", "clusters", "lines"]
    whole = (each.groupBy(F.pmod(F.xxhash64("template"), F.lit(PIECES)).alias("_piece"))
             .agg(_counted(F.col("template")).alias("templates"), _merged("clusters").alias("clusters"), _merged("lines").alias("lines"))
             .agg(*[_merged(m).alias(m) for m in measures]))
    of_run = whole.select(F.inline(F.array(*[
        F.struct(F.lit("run").alias("scope"), F.lit(m).alias("name"), F.col(m).alias("sketch")) for m in measures])))
    of_template = each.where("template is not null").select(
        F.lit("template").alias("scope"), F.col("template").alias("name"), F.col("lines").alias("sketch"))
    return of_run.unionByName(of_template)


def append_sketches(store: EpochTables, sketches: DataFrame, epoch: int | None = None) -> int:
    """Adds a run's sketches as an epoch; a replayed epoch replaces its own."""
    return store.write(TABLE, sketches.select("scope", "name", "sketch"), epoch)


def load_sketches(store: EpochTables, before: int | None = None) -> DataFrame:
    """One merged sketch for each ``(scope, name)`` over all epochs, or those ``before`` one."""
    return store.read(TABLE, SKETCHES_SCHEMA, before).groupBy("scope", "name").agg(_merged("sketch").alias("sketch"))


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """``scope, name, n``."""
    return sketches.select("scope", "name", F.theta_sketch_estimate("sketch").alias("n"))


def distinct_over_runs(store: EpochTables, epoch: int) -> DataFrame:
    """``scope, name, n_total, n_before, n_latest, n_both, n_new`` for the run of
    ``epoch`` and all runs before it: distinct values of all of them, of the
    earlier ones, of the latest, in both, and in the latest alone. A name that
    only one side has counts 0 on the other."""
    rows = store.read(TABLE, SKETCHES_SCHEMA + ", epoch BIGINT").where(F.col("epoch") <= epoch)
    latest = F.col("epoch") == epoch
    sides = rows.groupBy("scope", "name").agg(
        F.theta_union_agg(F.when(~latest, F.col("sketch")), F.lit(LOG_ENTRIES)).alias("before"),
        F.theta_union_agg(F.when(latest, F.col("sketch")), F.lit(LOG_ENTRIES)).alias("latest"))
    n = F.theta_sketch_estimate
    return sides.select("scope", "name", n(F.theta_union("before", "latest", LOG_ENTRIES)).alias("n_total"), n("before").alias("n_before"),
                        n("latest").alias("n_latest"), n(F.theta_intersection("before", "latest")).alias("n_both"),
                        n(F.theta_difference("latest", "before")).alias("n_new"))
