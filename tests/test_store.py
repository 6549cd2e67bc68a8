"""Tables by epoch, cache / stats merges, retention, snapshots, examples."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from logmold.operators.stats import merge_stats, stats_view, template_stats, top_templates
from logmold.sources import store as ST

TS = dt.datetime


def _entry(spark, key, text="t", day=1, hits=0):
    return spark.createDataFrame([(key, text, TS(2024, 1, day), TS(2024, 1, day), hits)], ST.CACHE_SCHEMA)


def _keys(store, before=None):
    return sorted(r["cache_key"] for r in ST.load_cache(store, before).collect())


def test_epochs_add_up_and_replays_replace(spark, tmp_root):
    s = ST.EpochTables(spark, tmp_root)
    assert s.read("template_cache", ST.CACHE_SCHEMA).count() == 0 and s.next_epoch("template_cache") == 0
    assert ST.append_cache(s, _entry(spark, "k1")) == 0
    assert ST.append_cache(s, _entry(spark, "k2", day=2)) == 1
    assert _keys(s) == ["k1", "k2"] and _keys(s, before=1) == ["k1"]
    # an epoch written again replaces its own rows only
    ST.append_cache(s, _entry(spark, "k4"), epoch=4)
    ST.append_cache(s, _entry(spark, "k5"), epoch=4)
    assert _keys(s) == ["k1", "k2", "k5"] and s.next_epoch("template_cache") == 5
    # the whole table may be replaced by what is made of it
    ST.save_cache(s, ST.load_cache(s).where("cache_key <> 'k2'"))
    assert _keys(s) == ["k1", "k5"]
    # an empty-string template is still an entry (a hit)
    ST.append_cache(s, _entry(spark, "k3", ""))
    assert ST.cache_get(ST.load_cache(s), "k3").count() == 1


def test_only_a_missing_table_is_empty(spark, tmp_root):
    import os

    import pytest

    s = ST.EpochTables(spark, tmp_root)
    os.makedirs(f"{tmp_root}/template_cache/epoch=0")
    with open(f"{tmp_root}/template_cache/epoch=0/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        ST.load_cache(s).collect()


def test_fold_keeps_what_readers_see(spark, tmp_root):
    s, folded = ST.EpochTables(spark, f"{tmp_root}/a"), ST.EpochTables(spark, f"{tmp_root}/b")
    stats = spark.createDataFrame([("A", 5, 1, 4, TS(2024, 1, 1), TS(2024, 1, 1), "x")], ST.STATS_SCHEMA)
    for key, day in (("a", 1), ("b", 2), ("a", 3)):
        ST.append_cache(s, _entry(spark, key, f"t{day}", day, 1))
        ST.append_stats(s, stats)
    ST.fold(s, folded)
    for load in (ST.load_cache, ST.load_stats):
        assert sorted(map(tuple, load(s).collect())) == sorted(map(tuple, load(folded).collect()))
    assert folded.next_epoch("template_cache") == 1 and ST.load_stats(s).first()["usage_count"] == 15


def test_hit_on_a_removed_key_is_no_entry(spark, tmp_root):
    s = ST.EpochTables(spark, tmp_root)
    rows = [("old", "a", TS(2024, 1, 1), TS(2024, 1, 1), 0), ("new", "b", TS(2024, 3, 1), TS(2024, 3, 1), 0)]
    ST.save_cache(s, ST.retain_cache(spark.createDataFrame(rows, ST.CACHE_SCHEMA), "2024-03-02 00:00:00", 30))
    hits = spark.createDataFrame([("old", 2), ("new", 3)], "cache_key STRING, hits BIGINT")
    ST.append_cache(s, ST.cache_delta(spark.createDataFrame([], ST.CACHE_SCHEMA), hits))
    assert [(r["cache_key"], r["template_text"], r["hit_count"]) for r in ST.load_cache(s).collect()] == [("new", "b", 3)]


def test_retention_boundary(spark):
    run = "2024-03-01 00:00:00"
    rows = [("old", "a", TS(2024, 1, 1), TS(2024, 1, 30, 23, 59, 59), 0),
            ("edge", "b", TS(2024, 1, 1), TS(2024, 1, 31), 0),
            ("new", "c", TS(2024, 2, 1), TS(2024, 2, 20), None)]
    cache = spark.createDataFrame(rows, ST.CACHE_SCHEMA)
    kept = sorted(r["cache_key"] for r in ST.retain_cache(cache, run, 30).collect())
    assert kept == ["edge", "new"]
    assert ST.expired_count(cache, run, 30) == 1
    assert [r["cache_key"] for r in ST.hottest_cache(cache).collect()][-1] == "new"  # null hit_count last


def _logs(spark, rows):
    return spark.createDataFrame(rows, "idx BIGINT, text STRING, batch_id BIGINT, template STRING, source STRING")


def test_stats_and_merge(spark):
    run1 = _logs(spark, [(0, "", 1, "A", "SLM"), (1, "a1", 1, "A", "SLM"), (2, "a2", 2, "A", "CACHE"),
                         (3, "b1", 3, "B", "SLM")])
    st1 = template_stats(run1, "2024-01-01 00:00:00")
    got = {r["template_text"]: r for r in stats_view(st1).collect()}
    assert (got["A"]["usage_count"], got["A"]["cache_count"], got["A"]["slm_count"]) == (3, 1, 2)
    assert got["A"]["example_log"] == "a1"  # the first non-empty line
    assert (got["A"]["cache_pct"], got["A"]["slm_pct"]) == (33.33, 66.67)
    run2 = _logs(spark, [(0, "c1", 1, "C", "SLM"), (1, "a9", 2, "A", "CACHE")])
    st2 = template_stats(run2, "2024-01-02 00:00:00")
    m = {r["template_text"]: r for r in merge_stats(st1, st2).collect()}
    assert m["A"]["usage_count"] == 4 and m["A"]["cache_count"] == 2
    assert m["A"]["first_seen"] == TS(2024, 1, 1) and m["A"]["last_used"] == TS(2024, 1, 2)
    assert m["A"]["example_log"] == "a1"
    assert m["B"]["last_used"] == TS(2024, 1, 1)  # only in history
    assert m["C"]["first_seen"] == TS(2024, 1, 2)  # only in the run
    top = [r["template_text"] for r in top_templates(merge_stats(st1, st2), 2).collect()]
    assert top == ["A", "B"]


def test_history_without_examples_gets_run_example(spark):
    hist = spark.createDataFrame([("A", 5, 0, 5, TS(2024, 1, 1), TS(2024, 1, 1), "")], ST.STATS_SCHEMA)
    run = template_stats(_logs(spark, [(0, "a", 1, "A", "CACHE")]), "2024-01-02 00:00:00")
    m = merge_stats(hist, run).first()
    assert m["example_log"] == "a" and m["usage_count"] == 6


def test_examples_and_snapshots(spark, tmp_root):
    s = ST.EpochTables(spark, tmp_root)
    logs = spark.createDataFrame(
        [(i, f"t{i}", 1, "A", "SLM", "INFO", "GENERIC") for i in range(7)] + [(9, "x", 2, "Z", "SLM", "INFO", "GENERIC")],
        "idx BIGINT, text STRING, batch_id BIGINT, template STRING, source STRING, level STRING, event_type STRING")
    ST.append_examples(s, ST.example_rows(logs, "2024-01-01 00:00:00", 0))
    ex = ST.load_examples(s)
    recent = ST.recent_examples(ex, 5, "A").collect()
    assert [r["original_log"] for r in recent] == ["t6", "t5", "t4", "t3", "t2"]
    stats = spark.createDataFrame([("A", 1, 0, 1, TS(2024, 1, 1), TS(2024, 1, 1), "")], ST.STATS_SCHEMA)
    assert [r["template_text"] for r in ST.orphan_examples(ex, stats).collect()] == ["Z"]

    leaf = spark.createDataFrame([("INFO", "blue", "login", 1, "A", "{}")],
                                 "level STRING, color STRING, event_type STRING, template_rank INT, template_text STRING, leaf_json STRING")
    for sid in (1, 2):  # equal created_at: the larger snapshot id is the latest
        ST.append_snapshot(s, ST.snapshot_rows(leaf, sid, "2024-01-01 00:00:00", 3, 10))
    latest = ST.latest_snapshot(ST.load_tree_history(s)).collect()
    assert {r["snapshot_id"] for r in latest} == {2}


def test_written_tables_leave_no_shuffles(spark):
    from logmold.session import DROP_SHUFFLES, stash

    shuffles = lambda: {s for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if s.isShuffle()}
    before, held = {str(s) for s in shuffles()}, spark.conf.get(DROP_SHUFFLES, None)
    table = stash(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 5).alias("k")).count(), "counts")
    for _ in range(50):  # they go in the background
        if not {str(s) for s in shuffles()} - before:
            break
        time.sleep(0.2)
    assert not {str(s) for s in shuffles()} - before
    assert table.count() == 5 and spark.conf.get(DROP_SHUFFLES, None) == held
