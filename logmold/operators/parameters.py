"""Line parameters: what stands in a line at the placeholders of its template.

The template belongs to the batch (it is made of its first line), so a line of
the batch need not fit it; the result says so. JVM expressions only: the
template becomes a pattern whose placeholders are groups, compiled once for
a run of lines with the same template, as the lines of a batch are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.functions.text import PLACEHOLDER, collapse_whitespace

SPECIAL = r"([\\\[\](){}.*+?^$|])"
SLOT = " *(.*?) *"


def template_pattern(template: Column) -> Column:
    """A pattern that whole lines of the template match: text as it is, a group for each placeholder. Spaces
    beside a placeholder are optional, since templates are written without those of masked runs."""
    literal = F.regexp_replace(template, SPECIAL, r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(literal, r" *<\\\*> *", SLOT), F.lit("$"))


def slot_count(template: Column) -> Column:
    return ((F.length(template) - F.length(F.replace(template, F.lit(PLACEHOLDER), F.lit("")))) / len(PLACEHOLDER)).cast("int")


def line_parameters(logs: DataFrame) -> DataFrame:
    """``idx, batch_id, template, fits, slot, value`` of ``logs (idx, text, batch_id, template)``: a
    row for each placeholder of the line's template, numbered from 1.

    White space in lines counts as one space, as in templates. A line that doesn't
    fit, and one whose template has no placeholder, has one row with null slot and
    value. A null text or template doesn't fit.
    """
    template = F.col("template")
    fitted = logs.select("idx", "batch_id", "template", collapse_whitespace("text").alias("_line"), template_pattern(template).alias("_pattern"),
                         slot_count(template).alias("_n")).withColumn("fits", F.coalesce(F.rlike("_line", F.col("_pattern")), F.lit(False)))
    values = F.expr("transform(sequence(1, _n), i -> named_struct('slot', i, 'value', regexp_extract(_line, _pattern, i)))")
    return fitted.select("idx", "batch_id", "template", "fits", F.explode_outer(F.when(F.col("fits") & (F.col("_n") > 0), values)).alias("_s")).select(
        "idx", "batch_id", "template", "fits", "_s.slot", "_s.value")
