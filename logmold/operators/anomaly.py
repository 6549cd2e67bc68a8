"""Anomaly labels and early warning over a parsed run.

* Counts: lines per template and hour, with the empty hours between filled in;
  a z-score against the hours before, and the slope of a moving frame.
* Sequence: how often one template follows another in a user's lines, smoothed,
  and the probability of each step.

Only counts reach a window by template: its rows are hours, however many lines
the template has. A user's lines are cut into ranges of time, so no user is a
single window either; a range's first line takes its predecessor from the
table of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours that a count is compared with, least number of them, and standard
#: deviations beyond which it is anomalous; deviations below FLOOR count as it.
HISTORY_HOURS, LEAST_HOURS, Z_LIMIT, FLOOR = 24, 6, 3.0, 0.5
#: Hours of the slope's frame, and the growth in lines an hour that raises the alert.
SLOPE_HOURS, SLOPE_LIMIT = 6, 0.5
#: Seconds in one range of a user's lines; steps below this probability are rare.
RANGE_SECONDS, RARE = 86_400, 0.02


def hourly_counts(lines: DataFrame) -> DataFrame:
    """``template, hour, n`` of ``lines (template, ts)``: hours since 1970, as a number."""
    return lines.groupBy("template", F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("hour")).agg(F.count("*").alias("n"))


def with_empty_hours(counts: DataFrame, tail: int = HISTORY_HOURS) -> DataFrame:
    """The counts of each hour from a template's first to ``tail`` hours after its last,
    as far as the run goes; hours without lines have 0."""
    end = counts.agg(F.max("hour")).first()[0]
    spans = counts.groupBy("template").agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    hours = spans.select("template", "first", F.explode(F.sequence("first", F.least(F.col("last") + tail, F.lit(end).cast("long")))).alias("hour"))
    return hours.join(counts, ["template", "hour"], "left").select("template", "first", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_anomalies(counts: DataFrame) -> DataFrame:
    """``template, hour, n, history_hours, mean, z, anomaly`` of every hour.

    ``z`` compares the hour with the up to ``HISTORY_HOURS`` before it (null with
    none); an hour is anomalous from ``Z_LIMIT`` on and ``LEAST_HOURS`` of history.
    Sums are of integers, so the result doesn't depend on their order.
    """
    before = Window.partitionBy("template").orderBy("hour").rangeBetween(-HISTORY_HOURS, -1)
    k, s, q = F.count("n").over(before), F.coalesce(F.sum("n").over(before), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n")).over(before), F.lit(0))
    framed = with_empty_hours(counts).withColumns({"k": k, "s": s, "q": q})
    mean = F.when(F.col("k") > 0, F.col("s").cast("double") / F.col("k"))
    spread = F.sqrt((F.col("k") * F.col("q") - F.col("s") * F.col("s")).cast("double")) / F.col("k")
    scored = framed.withColumn("mean", mean).withColumn("z", F.when(F.col("k") > 0, (F.col("n") - F.col("mean")) / F.greatest(spread, F.lit(FLOOR))))
    return scored.select("template", "hour", "n", F.col("k").alias("history_hours"), "mean", "z",
                         F.coalesce((F.col("k") >= LEAST_HOURS) & (F.col("z") >= Z_LIMIT), F.lit(False)).alias("anomaly"))


def early_warnings(counts: DataFrame) -> DataFrame:
    """``template, hour, n, slope, alert``: growth of the hourly count, in lines an hour, by
    least squares over the hour and those before it, ``SLOPE_HOURS`` in all; null in
    a template's first hour. An alert needs a whole frame."""
    frame = Window.partitionBy("template").orderBy("hour").rangeBetween(1 - SLOPE_HOURS, 0)
    rows = with_empty_hours(counts).withColumn("x", F.col("hour") - F.col("first"))
    total = lambda c: F.sum(c).over(frame)
    sums = rows.withColumns({"k": F.count("*").over(frame), "sx": total(F.col("x")), "sy": total(F.col("n")), "sxx": total(F.col("x") * F.col("x")),
                             "sxy": total(F.col("x") * F.col("n"))})
    down = F.col("k") * F.col("sxx") - F.col("sx") * F.col("sx")
    up = F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy")
    sloped = sums.withColumn("slope", F.when(down > 0, up.cast("double") / down))
    return sloped.select("template", "hour", "n", "slope", F.coalesce((F.col("k") == SLOPE_HOURS) & (F.col("slope") >= SLOPE_LIMIT), F.lit(False)).alias("alert"))


def user_steps(lines: DataFrame, range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """``idx, user_id, template, previous`` of ``lines (idx, ts, user_id, template)``: the template of the
    user's line before, by time and idx; null for the first. Lines without a user are left out."""
    at = F.struct(F.col("ts"), F.col("idx"))
    ranged = lines.where("user_id is not null").withColumn("r", F.expr(f"unix_seconds(cast(ts as timestamp)) div {int(range_seconds)}"))
    inside = F.lag("template").over(Window.partitionBy("user_id", "r").orderBy("ts", "idx"))
    ends = ranged.groupBy("user_id", "r").agg(F.max_by("template", at).alias("end"))
    before = ends.select("user_id", "r", F.lag("end").over(Window.partitionBy("user_id").orderBy("r")).alias("before"))
    return ranged.withColumn("inside", inside).join(before, ["user_id", "r"]).select(
        "idx", "user_id", "template", F.coalesce("inside", "before").alias("previous"))


def transition_counts(steps: DataFrame) -> DataFrame:
    """``previous, template, n``: the model, as state that adds up over runs."""
    return steps.where("previous is not null").groupBy("previous", "template").agg(F.count("*").alias("n"))


def sequence_anomalies(steps: DataFrame, model: DataFrame, templates: int) -> DataFrame:
    """``idx, user_id, previous, template, seen, probability, rare`` of each step: (seen + 1) / (all steps from
    ``previous`` + ``templates``). A step that the model lacks was seen 0 times;
    a user's first line has no probability and isn't rare."""
    totals = model.groupBy("previous").agg(F.sum("n").alias("total"))
    known = steps.join(model.withColumnRenamed("n", "seen"), ["previous", "template"], "left").join(totals, "previous", "left")
    seen, total = F.coalesce("seen", F.lit(0)), F.coalesce("total", F.lit(0))
    p: Column = F.when(F.col("previous").isNotNull(), (seen + 1).cast("double") / (total + templates))
    return known.select("idx", "user_id", "previous", "template", F.when(F.col("previous").isNotNull(), seen).cast("long").alias("seen"),
                        p.alias("probability"), F.coalesce(p < RARE, F.lit(False)).alias("rare"))
