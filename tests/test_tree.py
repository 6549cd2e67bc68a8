"""Template tree: leaf counts, overlays, limits, JSON shape."""

from __future__ import annotations

import json

from conftest import lines_df
from logmold.operators import tree as TR
from logmold.operators.parse import parse_logs
from logmold.operators.stats import template_stats

LEAF_KEYS = {"template_text", "count", "global_count", "first_seen", "last_seen", "source", "current_batch_count",
             "highlight_current_batch", "instances", "instances_total", "instances_truncated", "omitted_instances",
             "example_logs"}
INSTANCE_KEYS = {"original_log", "source", "batch_id", "cluster_id", "masked", "in_current_batch"}


def _tree(spark, texts, limit=2, show=True, debug=True):
    r = parse_logs(lines_df(spark, texts))
    latest = r.batch_count()
    assert latest == TR.latest_batch_id(r.logs)
    lines = TR.tree_lines(r.logs, latest)
    stats = template_stats(r.logs, "2024-01-01 00:00:00")
    leaves = TR.tree_leaves(lines, stats, latest, show, limit)
    docs = TR.leaf_documents(leaves, TR.tree_instances(lines, limit), TR.tree_examples(lines),
                             TR.tree_debug(lines) if debug else None)
    return r, latest, leaves, docs


TEXTS = [f"User {i} logged in from 10.0.0.{i}" for i in range(5)] + ["Disk error on node 1", "Disk error on node 1"]


def test_leaves_and_limits(spark):
    r, latest, leaves, docs = _tree(spark, TEXTS)
    assert latest == 2
    got = {x["template_text"]: x for x in leaves.collect()}
    user = got["User <*> logged in from <*>"]
    assert (user["level"], user["event_type"], user["count"]) == ("INFO", "login", 5)
    assert (user["instances_truncated"], user["omitted_instances"], user["global_count"]) == (True, 3, 5)
    assert (user["current_batch_count"], user["highlight_current_batch"]) == (0, False)
    disk = got["Disk error on node <*>"]
    assert (disk["level"], disk["event_type"], disk["current_batch_count"]) == ("ERROR", "system", 2)
    leaf = json.loads(TR.leaf_json(docs).filter("template_text like 'User%'").first()["leaf_json"])
    assert LEAF_KEYS | {"debug"} == set(leaf)
    assert len(leaf["instances"]) == 2 and set(leaf["instances"][0]) == INSTANCE_KEYS
    assert leaf["example_logs"] == ["User 0 logged in from 10.0.0.0", "User 1 logged in from 10.0.0.1",
                                    "User 2 logged in from 10.0.0.2"]
    assert leaf["debug"] == {"cluster_count": 1, "cache_hit": 0, "cache_miss": 5, "raw_slm_outputs": []}
    assert leaf["source"] == {"cache": 0, "slm": 5, "cache_pct": 0.0, "slm_pct": 100.0}


def test_current_batch_off(spark):
    _, _, leaves, _ = _tree(spark, TEXTS, show=False)
    assert {(x["current_batch_count"], x["highlight_current_batch"]) for x in leaves.collect()} == {(0, False)}


def test_no_debug_and_empty(spark):
    _, _, _, docs = _tree(spark, TEXTS, debug=False)
    assert all("debug" not in json.loads(r["leaf_json"]) for r in TR.leaf_json(docs).collect())
    _, latest, _, docs = _tree(spark, [], debug=False)
    assert latest == 0 and TR.leaf_json(docs).count() == 0


def test_template_order_in_bucket(spark):
    texts = ["login a 1"] + ["login b 2", "login b 3"] + ["login c 4"]
    _, _, _, docs = _tree(spark, texts)
    ranks = {r["template_text"]: r["template_rank"] for r in TR.leaf_json(docs).collect()}
    # count desc, ties in first-appearance order
    assert ranks == {"login b <*>": 1, "login a <*>": 2, "login c <*>": 3}


def test_ranks_in_ranges(spark):
    """Many leaves of one bucket: the nested sums rank as one window would."""
    rows = [("INFO", "login", f"t{i}", 1 + (i * 7) % 5, 1 + (i * 13) % 40, i) for i in range(200)]
    leaves = spark.createDataFrame(rows, "level STRING, event_type STRING, template_text STRING, count BIGINT, "
                                         "first_batch_id BIGINT, first_idx BIGINT")
    got = {r["template_text"]: r["template_rank"] for r in TR.leaf_ranks(leaves).collect()}
    order = sorted(rows, key=lambda r: (-r[3], r[4], r[5]))
    assert got == {r[2]: k + 1 for k, r in enumerate(order)}


def test_tree_document_reader(spark, tmp_root):
    """A nested document as the file format has it."""
    _, latest, leaves, docs = _tree(spark, TEXTS)
    rows = TR.leaf_json(docs).collect()
    doc: dict = {"generated_at": "", "latest_batch_id": latest, "show_current_batch": True, "debug_mode": True,
                 "total_logs": len(TEXTS), "levels": {}}
    for r in sorted(rows, key=lambda r: r["template_rank"]):
        level = doc["levels"].setdefault(r["level"], {"color": r["color"], "event_types": {}})
        level["event_types"].setdefault(r["event_type"], {"templates": []})["templates"].append(json.loads(r["leaf_json"]))
    with open(f"{tmp_root}/tree.json", "w") as f:
        f.write(json.dumps(doc, indent=2))
    read = TR.tree_leaf_rows(TR.read_tree_json(spark, f"{tmp_root}/tree.json")).collect()
    got = {(r["level"], r["event_type"], r["template_text"]): (r["count"], r["template_rank"]) for r in read}
    want = {(r["level"], r["event_type"], r["template_text"]): (r["count"], 1) for r in leaves.collect()}
    assert got == want
    back = TR.tree_leaf_rows(TR.parse_tree_json(spark.createDataFrame([(json.dumps(doc),)], "tree_data STRING"))).count()
    assert back == len(want)


def test_tree_json_lists_all_cluster_ids(spark, tmp_root):
    """Two clusters of one leaf: the query's document names both, as its SQL does."""
    import datetime as dt

    from oracle_compare import canon, duck

    from logmold.plans.catalog import QUERIES
    from logmold.plans.oracle import ORACLE_SQL

    rows = [(k, dt.datetime(2024, 1, 1, 0, k), 7, kind, f'{{"k": {k}}}') for k, kind in enumerate(["view", "error", "signup"] * 9, 1)]
    spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, props STRING").coalesce(1).write.parquet(f"{tmp_root}/events.parquet")
    found = QUERIES["tree_json"](spark, tmp_root)
    got = [tuple(r) for r in found.collect()]
    ids = [json.loads(r[found.columns.index("leaf_json")])["debug"]["cluster_ids"] for r in got]
    assert all(ids) and ids == [sorted(set(x)) for x in ids]
    con = duck("/nowhere")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_root}/events.parquet/*.parquet')")
    res = con.execute(ORACLE_SQL["tree_json"])
    assert canon(got, found.columns) == canon(res.fetchall(), [d[0] for d in res.description])
