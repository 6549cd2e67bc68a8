"""Batches that span triggers, against one pass over all lines."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from logmold.sources import store as ST
from logmold.streaming import microbatch
from logmold.streaming.microbatch import read_batches, window_batches, write_batches

T0 = dt.datetime(2024, 1, 1)


def lines_of():
    """(idx, ts, text): three clusters; long gaps now and then, and a null text."""
    out, t = [], T0
    for i in range(120):
        t += dt.timedelta(minutes=3 if i % 23 else 200, microseconds=17 * i)
        out.append((i, t, None if i == 50 else f"service {['up', 'down', 'slow'][i * 7 % 10 % 3]} again {i}"))
    return out


def cut(lines, size, wait, lanes):
    """One pass: (cluster, lane, number, closed by, ids)."""
    open_, number, out = {}, {}, []

    def close(key, by):
        number[key] = number.get(key, 0) + 1
        out.append((*key, number[key], by, tuple(i for i, _ in open_.pop(key))))

    for i, t, text in lines:
        key = (" ".join((text or "").split()[:3]), i % lanes)
        if key in open_ and t - open_[key][0][1] > wait:
            close(key, "time")
        open_.setdefault(key, []).append((i, t))
        if len(open_[key]) == size:
            close(key, "size")
    for key in list(open_):
        close(key, "time")
    return sorted(out)


def run(spark, root, parts, lanes=1):
    store = ST.EpochTables(spark, f"{root}/tables")
    schema = "idx BIGINT, ts TIMESTAMP, text STRING"
    for part in parts:
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        write_batches(window_batches(stream, 4, "1 hour", lanes=lanes), store, f"{root}/ckpt")
    return sorted((r["cluster_id"], r["lane"], r["batch_no"], r["closed_by"], tuple(x["idx"] for x in r["lines"])) for r in read_batches(store).collect())


@pytest.mark.parametrize("cuts,lanes", [([], 1), ([41, 42, 97], 1), ([60], 2)])
def test_triggers_make_no_difference(spark, tmp_root, cuts, lanes):
    lines = lines_of()
    beat = [(10_000, lines[-1][1] + dt.timedelta(days=30), "beat")]
    parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)])]
    got = run(spark, tmp_root, [*parts, beat], lanes)
    assert got == cut(lines, 4, dt.timedelta(hours=1), lanes)


def test_timer_closes_a_quiet_cluster_and_replay_changes_nothing(spark, tmp_root):
    """No further line of the first cluster comes: the clock of the others closes its batch."""
    quiet = [(0, T0, "first kind of line"), (1, T0 + dt.timedelta(minutes=1), "first kind of line")]
    others = [(10 + k, T0 + dt.timedelta(minutes=50 * k), f"another sort here {k}") for k in range(1, 5)]
    got = run(spark, tmp_root, [quiet, others])
    assert ("first kind of", 0, 1, "time", (0, 1)) in got
    assert len([x for x in got if x[0] == "first kind of"]) == 1
    last = max(int(f) for f in os.listdir(f"{tmp_root}/ckpt/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{tmp_root}/ckpt/commits/{name}")
    assert run(spark, tmp_root, [[]]) == got


def test_templates_are_of_first_lines(spark, tmp_root):
    lines = [(k, T0, f"user {k} signed in") for k in range(4)]
    run(spark, tmp_root, [lines])
    row = read_batches(ST.EpochTables(spark, f"{tmp_root}/tables")).select("template", "number_of_logs", "first_idx", "last_idx", F.length("cache_key").alias("key")).collect()
    assert [tuple(r) for r in row] == [("user <*> signed in", 4, 0, 3, 64)]


def test_plain_session_and_workers_without_the_package(spark, tmp_root):
    """A session that names no state store; the processor loads where ``logmold`` can't be imported."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.unset(provider)
    try:
        plain = spark.conf.get(provider, None)
        lines = [(k, T0, f"user {k} signed in") for k in range(4)]
        assert [x[3:] for x in run(spark, tmp_root, [lines])] == [("size", (0, 1, 2, 3))]
        assert spark.conf.get(provider, None) == plain
    finally:
        spark.conf.set(provider, before)
    with open(f"{tmp_root}/processor", "wb") as f:
        f.write(cloudpickle.dumps(microbatch._batching(4, 1)))
    code = f"import pickle; print(type(pickle.load(open({tmp_root + '/processor'!r}, 'rb'))).__name__)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_root, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "Batching", done.stderr
