"""Line parameters, anomalies, incidents and similar sets against plain loops."""

from __future__ import annotations

import collections
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logmold.operators import anomaly as AN
from logmold.operators import incidents as IN
from logmold.operators.parameters import line_parameters

T0 = dt.datetime(2024, 1, 1)


def test_line_parameters(spark):
    rows = [(0, "user 7 in 10.0.0.1", 1, "user <*> in <*>"), (1, "user  9   in x", 1, "user <*> in <*>"), (2, "other", 1, "user <*> in <*>"),
            (3, "plain", 2, "plain"), (4, "a 1 2: b", 3, "a <*> : b"), (5, "cost (5.0)* [x] $2 | a\\b", 4, "cost (<*>)* [x] $<*> | a\\b"),
            (6, None, 5, "t <*>"), (7, "t 1", 5, None), (8, "", 6, ""), (9, "x y", 7, "<*>"), (10, "pre 5 post 6 post", 8, "pre <*> post")]
    got = line_parameters(spark.createDataFrame(rows, "idx BIGINT, text STRING, batch_id BIGINT, template STRING")).collect()
    values = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["idx"], r["slot"] or 0)):
        values[r["idx"]].append((r["fits"], r["slot"], r["value"]))
    none = (None, None)
    assert values == {0: [(True, 1, "7"), (True, 2, "10.0.0.1")], 1: [(True, 1, "9"), (True, 2, "x")], 2: [(False, *none)], 3: [(True, *none)],
                      4: [(True, 1, "1 2")], 5: [(True, 1, "5.0"), (True, 2, "2")], 6: [(False, *none)], 7: [(False, *none)], 8: [(True, *none)],
                      9: [(True, 1, "x y")], 10: [(True, 1, "5 post 6")]}


def hourly(rng, hours=80):
    return {("a", h): int(rng.integers(0, 9)) for h in range(hours)} | {("b", h): 3 for h in (5, 6, 40)} | {("a", 60): 200}


def test_counts_fill_empty_hours(spark):
    rng = np.random.default_rng(1)
    counts = {k: n for k, n in hourly(rng).items() if n}
    lines = [(t, T0 + dt.timedelta(hours=h, minutes=int(rng.integers(0, 60)))) for (t, h), n in counts.items() for _ in range(n)]
    table = AN.hourly_counts(spark.createDataFrame(lines, "template STRING, ts TIMESTAMP"))
    base = min(h for (_, h) in counts) + int(T0.replace(tzinfo=dt.timezone.utc).timestamp() // 3600)
    end = max(h for _, h in counts)
    got = {(r["template"], r["hour"] - base): r for r in AN.count_anomalies(table).collect()}
    slopes = {(r["template"], r["hour"] - base): r for r in AN.early_warnings(table).collect()}
    want = set()
    for t in "ab":
        own = [h for x, h in counts if x == t]
        want |= {(t, h) for h in range(min(own), min(max(own) + AN.HISTORY_HOURS, end) + 1)}
    assert set(got) == want == set(slopes)
    for (t, h), r in got.items():
        past = [counts.get((t, x), 0) for x in range(h - AN.HISTORY_HOURS, h) if (t, x) in want]
        assert r["n"] == counts.get((t, h), 0) and r["history_hours"] == len(past)
        z = (r["n"] - np.mean(past)) / max(np.std(past), AN.FLOOR) if past else None
        assert (r["z"] is None) == (z is None) and (z is None or math.isclose(r["z"], z, rel_tol=1e-9, abs_tol=1e-9))
        assert r["anomaly"] == (len(past) >= AN.LEAST_HOURS and z >= AN.Z_LIMIT)
        frame = [(x, counts.get((t, x), 0)) for x in range(h - AN.SLOPE_HOURS + 1, h + 1) if (t, x) in want]
        slope = np.polyfit(*zip(*frame), 1)[0] if len(frame) > 1 else None
        s = slopes[t, h]
        assert (s["slope"] is None) == (slope is None) and (slope is None or math.isclose(s["slope"], slope, rel_tol=1e-6, abs_tol=1e-6))
        assert s["alert"] == (len(frame) == AN.SLOPE_HOURS and s["slope"] >= AN.SLOPE_LIMIT)
    assert got["a", 60]["anomaly"] and got["b", 20]["n"] == 0


def test_steps_across_ranges_and_model(spark):
    rng = np.random.default_rng(2)
    rows = [(i, T0 + dt.timedelta(hours=int(rng.integers(0, 400))), 1 if i % 3 else i % 5 or None, f"t{rng.integers(0, 4)}") for i in range(300)]
    df = spark.createDataFrame(rows, "idx BIGINT, ts TIMESTAMP, user_id BIGINT, template STRING")
    got = AN.user_steps(df.repartition(3), 7200)
    last, want = {}, {}
    for i, _, u, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[1], r[0])):
        want[i] = last.get(u)
        last[u] = t
    assert {r["idx"]: r["previous"] for r in got.collect()} == want
    model = AN.transition_counts(got)
    seen = collections.Counter((want[i], rows[i][3]) for i in want if want[i])
    assert {(r["previous"], r["template"]): r["n"] for r in model.collect()} == dict(seen)
    # scores of new steps by a model kept from before: a pair that it lacks was seen 0 times
    fresh = spark.createDataFrame([(1, 9, "t1", "t0"), (2, 9, "never", "t1"), (3, 9, "t0", "never"), (4, 9, "t0", None)],
                                  "idx BIGINT, user_id BIGINT, template STRING, previous STRING")
    out = {r["idx"]: r for r in AN.sequence_anomalies(fresh, model, 4).collect()}
    total = sum(n for (p, _), n in seen.items() if p == "t1")
    assert out[2]["seen"] == 0 and out[2]["probability"] == 1 / (total + 4) and out[3]["probability"] == 1 / 4
    assert out[1]["probability"] == (seen["t0", "t1"] + 1) / (sum(n for (p, _), n in seen.items() if p == "t0") + 4)
    assert out[4]["probability"] is None and not out[4]["rare"]


def test_incidents_and_context(spark):
    rng = np.random.default_rng(3)
    rows = [(T0 + dt.timedelta(seconds=int(s)), ["ERROR", "INFO", "WARN"][int(rng.integers(0, 3))], ["DB", "AUTH"][int(rng.integers(0, 2))], f"t{rng.integers(0, 3)}")
            for s in np.cumsum(rng.choice([1, 30, 200, 4000, 20_000], 400))]
    df = spark.createDataFrame(rows + [(None, "ERROR", "DB", "t0")], "ts TIMESTAMP, level STRING, event_type STRING, template STRING")
    us = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    want = []
    for kind in ("DB", "AUTH"):
        now = []
        for t in [us(t) for t, level, e, _ in rows if level == "ERROR" and e == kind]:
            if now and t - now[-1] > 3600 * 1_000_000:
                want.append((kind, now[0], now[-1], len(now)))
                now = []
            now.append(t)
        want.append((kind, now[0], now[-1], len(now)))
    found = IN.incidents(df)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    around = collections.Counter((k, a, x) for k, a, b, _ in want for t, _, _, x in rows if a - 900 * 1_000_000 <= us(t) <= b)
    got = {(r["event_type"], r["started"], r["template"]): r["n"] for r in IN.incident_templates(df, found).collect()}
    assert got == dict(around)
    with pytest.raises(ValueError):
        IN.incidents(df, 30)


@pytest.mark.parametrize("least", [20, 50, 80, 100])
def test_similar_sets_are_exact(spark, least):
    rng = np.random.default_rng(least)
    sets = {i: frozenset(f"w{min(int(x), 25)}" for x in rng.exponential(6, rng.integers(1, 9))) for i in range(150)}
    sets |= {200 + i: frozenset(["w1", "w2", "w3"]) for i in range(9)}  # more equal sets than are reported
    rows = [(i, w) for i, s in sets.items() for w in s] + [(0, w) for w in sets[0]] + [(None, "w1"), (300, None)]
    got = IN.similar_sets(spark.createDataFrame(rows, "id BIGINT, token STRING").repartition(4), 3, least)
    want = []
    for i, s in sets.items():
        near = sorted((-len(s & t) / len(s | t), j, len(s & t)) for j, t in sets.items() if j != i and 100 * len(s & t) >= least * len(s | t))
        want += [(i, k + 1, j, shared, -sim) for k, (sim, j, shared) in enumerate(near[:3])]
    assert sorted((r["id"], r["rank"], r["other"], r["shared"], r["similarity"]) for r in got.collect()) == sorted(want)


def test_template_vectors_by_kept_frequencies(spark):
    df = spark.createDataFrame([("Disk <*> error error",), ("disk ok",), ("!!",)], "template STRING")
    tokens = IN.template_tokens(df)
    fitted = IN.document_frequencies(tokens).where(F.col("token") != "ok")
    got = {(r["template"], r["token"]): (r["tf"], r["df"], r["weight"]) for r in IN.template_vectors(tokens, fitted, 3).collect()}
    w = lambda tf, n: round(tf * (1 + math.log(4 / (1 + n))), 6)
    first = "Disk <*> error error"
    assert got == {(first, "disk"): (1, 2, w(1, 2)), (first, "<*>"): (1, 1, w(1, 1)), (first, "error"): (2, 1, w(2, 1)),
                   ("disk ok", "disk"): (1, 2, w(1, 2)), ("disk ok", "ok"): (1, 0, w(1, 0))}


def test_empty_tables(spark):
    lines = spark.createDataFrame([], "idx BIGINT, ts TIMESTAMP, user_id BIGINT, text STRING, template STRING, batch_id BIGINT, level STRING, event_type STRING")
    counts = AN.hourly_counts(lines)
    found = IN.incidents(lines)
    steps = AN.user_steps(lines)
    for df in (line_parameters(lines), AN.count_anomalies(counts), AN.early_warnings(counts), AN.sequence_anomalies(steps, AN.transition_counts(steps), 0),
               found, IN.incident_templates(lines, found), IN.similar_sets(IN.template_tokens(lines).select(F.col("template").alias("id"), "token"))):
        assert df.count() == 0


def test_common_tokens_are_the_most_frequent(spark):
    df = spark.createDataFrame([(f"t{k}", k) for k in range(1, 101)], "token STRING, df BIGINT")
    assert sorted(r["df"] for r in IN.common_tokens(df, 10).collect()) == list(range(91, 101))
    assert IN.common_tokens(df, 1000).count() == 100 and IN.common_tokens(df, 0).count() == 0


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_pairs_of_sets_meet_without_their_ids(spark, monkeypatch, common):
    """Any table of common tokens gives the same rows; the links are numbers, not ids."""
    rows = [(f"set {i}", f"t{t}") for i in range(60) for t in {i % 7, i % 11, (i * i) % 13, i // 9, 50 + i % 3}]
    sets = {i: frozenset(t for j, t in rows if j == i) for i, _ in rows}
    want = {}
    for i, x in sets.items():
        near = sorted((-len(x & y) / len(x | y), j) for j, y in sets.items() if j != i and 100 * len(x & y) >= 50 * len(x | y))
        want.update({(i, k): j for k, (_, j) in enumerate(near[:3], 1)})
    kept, stash = {}, IN.stash
    monkeypatch.setattr(IN, "stash", lambda df, name: kept.setdefault(name, stash(df, name)))
    monkeypatch.setattr(IN, "common_tokens", lambda df, most=common, f=IN.common_tokens: f(df, most))
    got = IN.similar_sets(spark.createDataFrame(rows, "id STRING, token STRING"))
    assert {(r["id"], r["rank"]): r["other"] for r in got.collect()} == want
    assert dict(kept["set-links"].dtypes)["c1"] == "bigint"


def test_rows_meet_frequencies_without_their_templates(spark, monkeypatch, capsys):
    lines = spark.createDataFrame([(f"user {k % 5} of host h{k} said word w{k % 3}",) for k in range(30)], "template STRING")
    tokens = IN.template_tokens(lines)
    fitted, common = IN.document_frequencies(tokens), IN.common_tokens
    want = {(r["template"], r["token"]): r["df"] for r in tokens.join(fitted, "token").collect()}
    for most in (0, 4, 1000):
        monkeypatch.setattr(IN, "common_tokens", lambda df, n=most: common(df, n))
        found = IN.template_vectors(tokens, fitted, 30)
        assert {(r["template"], r["token"]): r["df"] for r in found.collect()} == want
        capsys.readouterr()
        found.explain("formatted")
        blocks = [b for b in capsys.readouterr().out.split("\n\n") if "Exchange" in b and "hashpartitioning(token#" in b]
        assert not any("template#" in b for b in blocks)


def test_rows_of_a_prefix_dont_carry_their_set(spark):
    """Two sets of many long tokens: a set for each row of its prefix would take many gigabytes."""
    token = F.concat(F.lit("t" * 120), F.col("k").cast("string"))
    rows = spark.range(60_000).withColumn("k", F.col("id")).select(
        F.explode(F.expr("filter(array(if(k < 50000, 'a', null), if(k >= 10000, 'b', null)), x -> x is not null)")).alias("id"), token.alias("token"))
    got = {(r["id"], r["rank"], r["other"], r["shared"]) for r in IN.similar_sets(rows).collect()}
    assert got == {("a", 1, "b", 40_000), ("b", 1, "a", 40_000)}


@pytest.mark.parametrize("rows_a_round", [20, 1_000_000])
def test_rounds_of_the_join_give_the_same_rows(spark, monkeypatch, rows_a_round):
    """Large sets share most of their tokens and nothing more; few of their pairs outlast the join."""
    rng = np.random.default_rng(8)
    sets = {i: frozenset(f"w{x}" for x in rng.choice(400, int(rng.integers(60, 120)), replace=False)) for i in range(80)}
    sets |= {100 + i: frozenset(list(sets[i])[3:]) | {"new"} for i in range(5)}
    kept, stash = {}, IN.stash
    monkeypatch.setattr(IN, "stash", lambda df, name: kept.setdefault(name, stash(df, name)))
    monkeypatch.setattr(IN, "ROUND_ROWS", rows_a_round)
    got = IN.similar_token_sets(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id BIGINT, tokens ARRAY<STRING>"))
    want = []
    for i, s in sets.items():
        near = sorted((-len(s & t) / len(s | t), j, len(s & t)) for j, t in sets.items() if j != i and 2 * len(s & t) >= len(s | t))
        want += [(i, k + 1, j, shared, -sim) for k, (sim, j, shared) in enumerate(near[:3])]
    assert sorted((r["id"], r["rank"], r["other"], r["shared"], r["similarity"]) for r in got.collect()) == sorted(want) != []
    found = [df for name, df in kept.items() if name.startswith("set-pairs")]
    assert len(found) == (IN.ROUNDS if rows_a_round == 20 else 1)
    assert len({(r["c1"], r["c2"]) for df in found for r in df.collect()}) < len(sets) * (len(sets) - 1) // 20


def test_tokens_are_counted_inside_the_row(spark, capsys):
    """A template's words are not dealt out, nor gathered, under the text of the template."""
    lines = spark.createDataFrame([("b a B <*>",), ("b a B <*>",), ("!!",), ("x",), (None,), ("",)], "template STRING")
    tokens = IN.template_tokens(lines)
    assert sorted((r["template"], r["token"], r["tf"]) for r in tokens.collect()) == [
        ("b a B <*>", "<*>", 1), ("b a B <*>", "a", 1), ("b a B <*>", "b", 2), ("x", "x", 1)]
    capsys.readouterr()
    tokens.explain("formatted")
    blocks = capsys.readouterr().out.split("\n\n")
    assert not any("Keys [2]" in b or "token#" in b for b in blocks if "HashAggregate" in b or "Exchange" in b)
