"""Snapshots as VARIANT documents (S9): JSON text parsed once, read by path.

``parse_tree_json`` of ``operators.tree`` reads trees by a fixed schema. Here a
document keeps whatever shape it was written in, so snapshots of earlier and
later versions lie in one table, and a path that a document lacks, or whose
value doesn't fit the type that is asked for, is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.sources.store import EpochTables

DOCUMENTS_SCHEMA = ("snapshot_id BIGINT, created_at TIMESTAMP, batch_id BIGINT, total_logs BIGINT, level STRING, "
                    "event_type STRING, template_rank INT, document VARIANT")
TABLE = "tree_documents"


def documents(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows with their JSON text as a VARIANT ``document``: null where
    the text is null or no JSON."""
    names = [c.split()[0] for c in DOCUMENTS_SCHEMA.split(", ")[:-1]]
    return snapshot.select(*names, F.try_parse_json("tree_data").alias("document"))


def append_documents(store: EpochTables, rows: DataFrame, epoch: int | None = None) -> int:
    return store.write(TABLE, rows, epoch)


def load_documents(store: EpochTables) -> DataFrame:
    return store.read(TABLE, DOCUMENTS_SCHEMA)


def values(rows: DataFrame, paths: dict[str, tuple[str, str]], column: str = "document") -> DataFrame:
    """``rows`` without the document, and ``paths`` ``{name: (path, type)}`` as columns."""
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, *[F.try_variant_get(column, path, kind).alias(name) for name, (path, kind) in paths.items()])


def _entries(rows: DataFrame, value: Column, name: str, key: str) -> DataFrame:
    """A row for each entry of an object or array: its ``key`` or ``pos``, and
    its value ``name``; none where ``value`` is null or neither of the two."""
    inside = rows.sparkSession.tvf.variant_explode(value.outer())
    return rows.lateralJoin(inside.select(F.col("pos"), F.col("key").alias(key), F.col("value").alias(name)))


def shapes(rows: DataFrame, *by: str, column: str = "document") -> DataFrame:
    """What the documents are made of: ``by``, ``key`` of the top level,
    ``kind`` of its values (``BIGINT``, ``STRING``, ``OBJECT``, ``ARRAY`` ...) and the
    number ``n`` of values. An array's values have a null key; documents that
    are neither object nor array have no rows."""
    found = _entries(rows.select(*by, F.col(column).alias("_document")), F.col("_document"), "_value", "key")
    kind = F.regexp_extract(F.schema_of_variant("_value"), "^[A-Z]+", 0)
    return found.groupBy(*by, "key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def tree_leaves(rows: DataFrame, column: str = "document") -> DataFrame:
    """The leaves of nested tree documents (levels, then event types, then
    templates), whatever a leaf holds: ``rows`` without the document, ``level,
    color, event_type, template_rank`` and ``leaf`` (VARIANT)."""
    others = [c for c in rows.columns if c != column]
    found = _entries(rows.withColumn("_levels", F.try_variant_get(column, "$.levels", "variant")), F.col("_levels"), "_level", "level").drop("pos")
    found = found.withColumns({"color": F.try_variant_get("_level", "$.color", "string"),
                               "_types": F.try_variant_get("_level", "$.event_types", "variant")})
    found = _entries(found, F.col("_types"), "_type", "event_type").drop("pos")
    found = _entries(found.withColumn("_templates", F.try_variant_get("_type", "$.templates", "variant")), F.col("_templates"), "leaf", "_key")
    return found.select(*others, "level", "color", "event_type", (F.col("pos") + 1).alias("template_rank"), "leaf")
