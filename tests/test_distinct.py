"""Distinct counts over runs: sketches as state, against exact sets."""

from __future__ import annotations

import pytest

from logmold.operators import distinct as D
from logmold.sources.store import EpochTables

LOGS = "template STRING, text STRING, cluster_id STRING"


def _rows(df):
    return {(r["scope"], r["name"]): tuple(r)[2:] for r in df.collect()}


def _exact(runs, epoch):
    """As ``distinct_over_runs`` by sets."""
    def sets(rows):
        out = {("run", m): {r[i] for r in rows if r[i] is not None} for m, i in (("templates", 0), ("lines", 1), ("clusters", 2))}
        for t in {r[0] for r in rows if r[0] is not None}:
            out["template", t] = {r[1] for r in rows if r[0] == t and r[1] is not None}
        return out

    before, latest = sets([r for run in runs[:epoch] for r in run]), sets(runs[epoch])
    want = {}
    for key in before.keys() | latest.keys():
        a, b = before.get(key, set()), latest.get(key, set())
        want[key] = (len(a | b), len(a), len(b), len(a & b), len(b - a))
    return want


RUNS = [
    [("t <*>", f"t {i % 40}", "t <num>") for i in range(200)] + [("u", "u", "u"), ("u", "u", "u")],
    [("t <*>", f"t {i}", "t <num>") for i in range(30, 60)] + [("", "", ""), (None, "x", "x"), ("v", None, None)],
    [],
    [("u", "u", "u"), ("v", "v", "v")],
]


def test_small_counts_are_exact(spark, tmp_root):
    s = EpochTables(spark, tmp_root)
    for epoch, run in enumerate(RUNS):
        assert D.append_sketches(s, D.run_sketches(spark.createDataFrame(run, LOGS))) == epoch
        assert _rows(D.distinct_over_runs(s, epoch)) == _exact(RUNS, epoch)
    total = {k: v[0] for k, v in _exact(RUNS, 3).items()}
    assert {k: v[0] for k, v in _rows(D.distinct_counts(D.load_sketches(s))).items()} == total
    assert _rows(D.distinct_counts(D.load_sketches(s, before=1)))["run", "lines"] == (41,)
    # an epoch written again replaces its own sketches
    D.append_sketches(s, D.run_sketches(spark.createDataFrame(RUNS[3], LOGS)), 3)
    assert _rows(D.distinct_over_runs(s, 3)) == _exact(RUNS, 3)


@pytest.mark.parametrize("pieces", [D.PIECES, 1])
def test_large_counts_within_the_stated_error(spark, tmp_root, monkeypatch, pieces):
    """One template has nearly all lines; the runs share a third of theirs."""
    monkeypatch.setattr(D, "PIECES", pieces)
    s = EpochTables(spark, tmp_root)
    for a, b in ((0, 90_000), (60_000, 150_000)):
        lines = spark.range(a, b, 1, 16).selectExpr("if(id % 100 = 0, 'rare', 'hot') AS template", "concat('line ', id) AS text",
                                                    "cast(id % 7 AS string) AS cluster_id")
        D.append_sketches(s, D.run_sketches(lines.unionByName(lines)))
    got = _rows(D.distinct_over_runs(s, 1))
    assert got["run", "templates"] == (2, 2, 2, 2, 0) and got["run", "clusters"] == (7, 7, 7, 7, 0)
    assert got["template", "rare"] == (1500, 900, 900, 300, 600)
    for key, share in ((("run", "lines"), 1.0), (("template", "hot"), 0.99)):
        want = [share * n for n in (150_000, 90_000, 90_000, 30_000, 60_000)]
        error = 4 * want[0] / 2 ** (D.LOG_ENTRIES / 2)
        assert all(abs(g - w) <= error for g, w in zip(got[key], want)), (key, got[key])
