"""Batching: skew-safe numbering equals the plain window form; batch laws."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from conftest import SF001, lines_df
from logmold.operators.batching import assign_batches, collect_batches, naive_batches


def _skewed_texts(n, hot_share=0.9, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if rnd.random() < hot_share:
            out.append(f"GET /api/item/{rnd.randint(0, 99)} status {rnd.randint(200, 599)}")
        else:
            out.append(f"{rnd.choice(['disk', 'auth', 'db', 'net'])} event {rnd.randint(0, 3)} x{i % 5}")
    return out


def test_skewed_cluster_matches_plain_windows(spark):
    texts = _skewed_texts(3000)
    # Sparse, irregular ids (like monotonically_increasing_id across partitions).
    rows = []
    idx = 0
    rnd = random.Random(3)
    for t in texts:
        idx += rnd.choice([1, 1, 2, 7, 1000])
        rows.append((idx, t))
    df = spark.createDataFrame(rows, "idx BIGINT, text STRING")
    fast = assign_batches(df, batch_size=16, block=64, cluster_block=8, range_bits=3).select(
        "idx", "cluster_id", "cluster_pos", "batch_id")
    slow = naive_batches(df, batch_size=16).select("idx", "cluster_id", "cluster_pos", "batch_id")
    a = sorted(tuple(r) for r in fast.collect())
    b = sorted(tuple(r) for r in slow.collect())
    assert a == b
    hot = fast.groupBy("cluster_id").count().orderBy(F.desc("count")).first()["count"]
    assert hot > 0.85 * len(texts)


def test_batch_laws(spark):
    texts = _skewed_texts(500, 0.5, seed=11)
    df = lines_df(spark, texts)
    for bs in (1, 5, 16):
        b = collect_batches(assign_batches(df, batch_size=bs, block=32, cluster_block=4, range_bits=2))
        rows = b.collect()
        ids = sorted(r["batch_id"] for r in rows)
        assert ids == list(range(1, len(ids) + 1))
        assert all(1 <= r["number_of_logs"] <= bs for r in rows)
        assert sum(r["number_of_logs"] for r in rows) == len(texts)
        # lines of a batch are consecutive members of one cluster, in order
        for r in rows:
            idxs = [x["idx"] for x in r["lines"]]
            assert idxs == sorted(idxs)


def test_batch_size_must_be_positive(spark):
    import pytest

    with pytest.raises(ValueError):
        assign_batches(lines_df(spark, ["a"]), batch_size=0)


def test_fixture_numbers_sf001(spark):
    """FIXTURES.md section 1: 8 clusters, 630 batches, 608 keys, 22 CACHE batches / 352 lines."""
    from logmold.operators.parse import parse_logs
    from logmold.sources.lines import log_lines

    r = parse_logs(log_lines(spark, SF001))
    b = r.batches
    assert b.count() == 630
    assert r.keys.count() == 608
    cache = b.filter(F.col("source") == "CACHE").agg(F.count(F.lit(1)), F.sum("number_of_logs")).first()
    assert tuple(cache) == (22, 352)
    first = {row["cluster_id"]: row["fb"] for row in b.groupBy("cluster_id").agg(F.min("batch_id").alias("fb")).collect()}
    assert first == {"disk error on": 1, "warning: connection retry": 42, "get /api/page/<num> http": 164,
                     "info user <num>": 283, "transaction <guid> committed": 404, "login failed for": 524,
                     "service latency timed": 567, "heartbeat ok": 607}


def test_exclusive_running_sum_levels(spark):
    from logmold.operators.batching import exclusive_running_sum

    rnd = random.Random(5)
    rows = [(k, o, rnd.randint(0, 9)) for k in ("a", "b") for o in rnd.sample(range(-5000, 10 ** 6), 300)]
    df = spark.createDataFrame(rows, "k STRING, o BIGINT, w BIGINT")
    got = {(r["k"], r["o"]): r["s"] for r in exclusive_running_sum(df, ["k"], "o", "w", "s", (3, 7, 11)).collect()}
    for k in ("a", "b"):
        acc = 0
        for _, o, w in sorted(x for x in rows if x[0] == k):
            assert got[(k, o)] == acc
            acc += w
    flat = {r["o"]: r["s"] for r in exclusive_running_sum(df.filter("k = 'a'"), [], "o", "w", "s", (4, 9)).collect()}
    acc = 0
    for _, o, w in sorted(x for x in rows if x[0] == "a"):
        assert flat[o] == acc
        acc += w


def test_text_of_batches_is_shuffled_once(spark):
    """All branches over the batches share the shuffle that gathers their lines."""
    from logmold.operators.parse import parse_logs

    result = parse_logs(lines_df(spark, [f"kind{i % 7} said {i}" for i in range(200)]))
    for df in (result.keys.select("template"), result.batches):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        made = [x for x in plan.split("\n") if "Exchange hashpartitioning(batch_id" in x and "REPARTITION_BY_COL" in x]
        assert len([x for x in made if "ReusedExchange" not in x]) == 1 < len(made)
