"""Snapshots as VARIANT documents: two shapes in one table, read by path."""

from __future__ import annotations

import json

from logmold.sources import store as ST
from logmold.sources import variants as V

LEAVES = "level STRING, color STRING, event_type STRING, template_rank INT, template_text STRING, leaf_json STRING"


def _snapshot(spark, sid, texts):
    leaves = spark.createDataFrame([("INFO", "green", "login", k + 1, f"t{k}", t) for k, t in enumerate(texts)], LEAVES)
    return ST.snapshot_rows(leaves, sid, "2024-01-01 00:00:00", 3, 10)


OLD = [json.dumps({"count": 3, "source": {"cache": 1}}), json.dumps({"count": "many"}), None, "{no json"]
NEW = [json.dumps({"count": 4, "source": {"cache": 2, "pct": 50.5}, "debug": {"hit": 2}, "logs": ["a", "b"], "on": True, "off": None}),
       json.dumps([7, "x"]), json.dumps(5), ""]
PATHS = {"n": ("$.count", "bigint"), "cache": ("$.source.cache", "bigint"), "pct": ("$.source.pct", "double"),
         "hit": ("$.debug.hit", "bigint"), "second": ("$.logs[1]", "string"), "first": ("$[0]", "bigint")}


def _stored(spark, root):
    s = ST.EpochTables(spark, root)
    assert V.load_documents(s).count() == 0
    for sid, texts in ((1, OLD), (2, NEW)):
        V.append_documents(s, V.documents(_snapshot(spark, sid, texts)))
    return V.load_documents(s)


def test_values_by_path(spark, tmp_root):
    got = V.values(_stored(spark, tmp_root), PATHS)
    assert got.columns == [c.split()[0] for c in V.DOCUMENTS_SCHEMA.split(", ")][:-1] + list(PATHS)
    none = (None,) * 6
    want = {(1, 1): (3, 1, None, None, None, None), (1, 2): none, (1, 3): none, (1, 4): none,
            (2, 1): (4, 2, 50.5, 2, "b", None), (2, 2): (None,) * 5 + (7,), (2, 3): none, (2, 4): none}
    assert {(r["snapshot_id"], r["template_rank"]): tuple(r[c] for c in PATHS) for r in got.collect()} == want


def test_paths_are_read_from_the_file(spark, tmp_root):
    """Only the paths that are asked for leave the scan."""
    plan = V.values(_stored(spark, tmp_root).select("document"), {"n": PATHS["n"]})._jdf.queryExecution().executedPlan().toString()
    assert "variant_get" not in plan and "document:struct<0:bigint" in plan


def test_shapes(spark, tmp_root):
    got = {(r["snapshot_id"], r["key"], r["kind"]): r["n"] for r in V.shapes(_stored(spark, tmp_root), "snapshot_id").collect()}
    assert got == {(1, "count", "BIGINT"): 1, (1, "count", "STRING"): 1, (1, "source", "OBJECT"): 1,
                   (2, "count", "BIGINT"): 1, (2, "source", "OBJECT"): 1, (2, "debug", "OBJECT"): 1, (2, "logs", "ARRAY"): 1,
                   (2, "on", "BOOLEAN"): 1, (2, "off", "VOID"): 1, (2, None, "BIGINT"): 1, (2, None, "STRING"): 1}


def test_nested_trees_of_any_shape(spark):
    tree = {"levels": {"INFO": {"color": "green", "event_types": {"login": {"templates": [{"count": 2}, {"count": 1, "more": [1]}]},
                                                                  "empty": {"templates": []}, "none": {}}},
                       "WARN": {"event_types": {"disk": {"templates": ["old form"]}}}, "ERROR": None}}
    rows = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps({"levels": []})), (3, "{}"), (4, None)], "id INT, tree_data STRING")
    found = V.tree_leaves(rows.selectExpr("id", "try_parse_json(tree_data) AS document"))
    got = {tuple(r) for r in V.values(found, {"n": ("$.count", "bigint"), "text": ("$", "string")}, "leaf").select(
        "id", "level", "color", "event_type", "template_rank", "n", "text").collect()}
    assert {(*g[:6], g[6] if g[5] is None else None) for g in got} == {
        (1, "INFO", "green", "login", 1, 2, None), (1, "INFO", "green", "login", 2, 1, None), (1, "WARN", None, "disk", 1, None, "old form")}
