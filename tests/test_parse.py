"""The composed parse: cache semantics, generators, trace views."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import lines_df
from logmold.operators import trace as R
from logmold.operators.generators import CallableGenerator, ModelGenerator, common_words
from logmold.operators.parse import cache_hits, new_cache_entries, parse_logs
from logmold.sources import store as ST

TEXTS = (["heartbeat ok"] * 40 + [f"User {i} logged in from 10.0.0.{i}" for i in range(20)]
         + ["Disk error on node 7"] * 3 + [""])


def test_reference_example(spark):
    r = parse_logs(lines_df(spark, ["User 123 logged in from 10.0.0.1", "User 456 logged in from 10.0.0.2"]))
    rows = r.logs.orderBy("idx").collect()
    assert [x["template"] for x in rows] == ["User <*> logged in from <*>"] * 2
    assert {x["source"] for x in rows} == {"SLM"}
    assert rows[0]["cluster_id"] == "user <num> logged"
    b = r.batches.collect()
    assert len(b) == 1 and b[0]["number_of_logs"] == 2 and b[0]["slm_raw_output"] == ""


def test_in_run_hits_and_template_per_batch(spark):
    r = parse_logs(lines_df(spark, TEXTS))
    b = {x["batch_id"]: x for x in r.batches.collect()}
    heartbeat = sorted(x["batch_id"] for x in b.values() if x["cluster_id"] == "heartbeat ok")
    # 40 identical lines: batches of 16, 16, 8; the second repeats the first.
    assert [b[i]["source"] for i in heartbeat] == ["SLM", "CACHE", "SLM"]
    logs = r.logs.collect()
    per_batch = {}
    for x in logs:
        per_batch.setdefault(x["batch_id"], set()).add(x["template"])
    assert all(len(v) == 1 for v in per_batch.values())
    blank = [x for x in logs if x["text"] == ""][0]
    assert blank["template"] == "" and blank["cluster_id"] == ""


def test_second_run_all_cache(spark):
    df = lines_df(spark, TEXTS)
    first = parse_logs(df)
    cache = new_cache_entries(first, "2024-01-01 00:00:00")
    second = parse_logs(df, cache=cache)
    a = {x["idx"]: x["template"] for x in first.logs.collect()}
    rows = second.logs.collect()
    assert {x["source"] for x in rows} == {"CACHE"}
    assert {x["idx"]: x["template"] for x in rows} == a
    merged = ST.merge_cache(cache, new_cache_entries(second, "2024-01-02"), cache_hits(second))
    hb = [x for x in merged.collect() if x["template_text"] == "heartbeat ok"]
    # key A (16 lines) twice and key B (8 lines) once per run: A is served
    # 1 + 2 times, B 0 + 1 times
    assert sorted(x["hit_count"] for x in hb) == [1, 3]


def test_distribution_sums_to_lines(spark):
    batches = parse_logs(lines_df(spark, TEXTS)).batches
    dist = R.template_distribution(batches).agg(F.sum("n")).first()[0]
    tot = R.run_totals(batches).first()
    assert dist == len(TEXTS) == tot["total_logs"]
    assert tot["batch_count"] == parse_logs(lines_df(spark, TEXTS)).batches.count()


def test_empty_input(spark):
    r = parse_logs(spark.createDataFrame([], "idx BIGINT, text STRING"))
    assert r.logs.count() == 0
    tot = R.run_totals(r.batches).first()
    assert tuple(tot) == (0, 0, 0)


def test_model_generator_and_fallback(spark):
    def factory():
        def generate(prompt):
            if "Disk" in prompt:
                raise RuntimeError("model failure")
            return "Template: - " + prompt.split("Logs:\n- ", 1)[1].split("\n", 1)[0].replace("7", "<*>") + "\nnoise"

        return generate

    r = parse_logs(lines_df(spark, ["Disk error on node 7", "svc 7 up", "svc 8 up"]), generator=ModelGenerator(factory))
    b = {x["cluster_id"]: x for x in r.batches.collect()}
    assert b["disk error on"]["template"] == "Disk error on node <*>"
    assert b["disk error on"]["used_fallback"] is True and b["disk error on"]["slm_raw_output"] == ""
    assert b["svc <num> up"]["template"] == "svc <*> up"
    assert b["svc <num> up"]["slm_raw_output"].startswith("Template: - svc <*> up")


def test_callable_generator(spark):
    gen = CallableGenerator(lambda lines: f"{len(lines)} lines: " + lines[0].upper())
    r = parse_logs(lines_df(spark, ["a 1", "a 2", "b"]), generator=gen)
    got = {x["cluster_id"]: x["template"] for x in r.batches.collect()}
    assert got == {"a <num>": "2 lines: A 1", "b": "1 lines: B"}


def test_common_words(spark):
    assert common_words(["a 1 b", "a 2  b c"]) == "a <*> b" and common_words(["", "a"]) == "" and common_words(["x 1"]) == "x 1"
    r = parse_logs(lines_df(spark, ["up node 7 now", "up node 7 then", "up node 7", "down"]), generator=CallableGenerator(common_words))
    got = {x["cluster_id"]: (x["template"], x["source"], x["slm_raw_output"]) for x in r.batches.collect()}
    assert got == {"up node <num>": ("up node 7", "SLM", "up node 7"), "down": ("down", "SLM", "down")}


def test_batch_trace_json(spark):
    import json

    r = parse_logs(lines_df(spark, ["User 1 logged in", "User 2 logged in"]))
    doc = json.loads(R.batch_trace_json(r.batches).first()["batch_json"])
    assert set(doc) == {"batch_id", "cluster_id", "number_of_logs", "cache_key", "source", "slm_raw_output", "logs"}
    assert set(doc["logs"][0]) == {"text", "template", "source", "level", "event_type", "masked"}


def test_event_sink(spark, tmp_root):
    import json

    r = parse_logs(lines_df(spark, ["a 1", "b 2"]))
    R.write_events(r.batches, f"{tmp_root}/events", "2024-01-01 00:00:00")
    recs = [json.loads(x[0]) for x in spark.read.text(f"{tmp_root}/events").collect()]
    assert sorted(x["message"] for x in recs) == ["batch_processed", "batch_processed", "run_completed"]


def test_sources(spark, tmp_root):
    import json as _json

    from logmold.sources.lines import lines_from_list, read_log_files, read_requests

    text = "first line\n\n  second\x0bthird \r\nfourth\x1c\nfifth\n"
    p = f"{tmp_root}/a.log"
    with open(p, "w") as f:
        f.write(text)
    with open(f"{tmp_root}/b.log", "w") as f:
        f.write("b1\nb2\n")
    got = [r["text"] for r in read_log_files(spark, f"{tmp_root}/*.log").orderBy("idx").collect()]
    expect = [x.strip() for x in text.splitlines() if x.strip()] + ["b1", "b2"]
    assert got == expect
    assert [r["text"] for r in lines_from_list(spark, ["x", "", "y"]).orderBy("idx").collect()] == ["x", "", "y"]
    with open(f"{tmp_root}/req.json", "w") as f:
        f.write(_json.dumps({"logs": ["a", "", "b"]}) + "\n")
    assert [r["text"] for r in read_requests(spark, f"{tmp_root}/req.json").orderBy("idx").collect()] == ["a", "", "b"]



def test_run_metrics(spark):
    r = parse_logs(lines_df(spark, TEXTS))
    m = R.run_with_metrics(r.logs, lambda df: df.write.format("noop").mode("overwrite").save())
    assert m["total_logs"] == len(TEXTS) and m["cache_logs"] + m["slm_logs"] == len(TEXTS)
    assert m["batch_count"] == r.batch_count() and m["processing_time_ms"] > 0


def test_cli_runs_with_state(spark, tmp_root, capsys):
    from logmold.__main__ import main

    with open(f"{tmp_root}/a.log", "w") as f:
        f.write("User 1 logged in from 10.0.0.1\nUser 2 logged in from 10.0.0.2\nDisk error on node 7\n")
    args = ["--input", f"{tmp_root}/*.log", "--state", f"{tmp_root}/state"]
    assert main(["parse", *args, "--out", f"{tmp_root}/o1", "--run-ts", "2024-01-01 00:00:00"]) == 0
    assert main(["parse", *args, "--out", f"{tmp_root}/o2", "--run-ts", "2024-01-02 00:00:00"]) == 0
    second = spark.read.parquet(f"{tmp_root}/o2/trace_logs")
    assert {r["source"] for r in second.select("source").distinct().collect()} == {"CACHE"}
    assert main(["stats", "--state", f"{tmp_root}/state", "--top", "1"]) == 0
    assert main(["templates", "--logs", "Disk error on node 7"]) == 0
    assert main(["cache", "--state", f"{tmp_root}/state"]) == 0
    out = capsys.readouterr().out
    assert "4  User <*> logged in from <*>" in out and "Disk error on node <*>" in out
    # both cache keys were written on 2024-01-01: 30 days later + 1 they expire
    assert main(["retain", "--state", f"{tmp_root}/state", "--days", "30", "--run-ts", "2024-02-01 00:00:01"]) == 0
    assert capsys.readouterr().out.strip().splitlines()[-1] == "2"
    assert ST.load_cache(ST.EpochTables(spark, f"{tmp_root}/state")).count() == 0


def test_requests_of_many_partitions(spark):
    from logmold.sources.lines import lines_from_requests

    reqs = spark.range(400).selectExpr("array(concat('a ', id), '', concat('b ', id)) as logs", "id").repartition(200, "id")
    got = lines_from_requests(reqs.sortWithinPartitions("id"))
    assert got.select("idx").distinct().count() == 1200 == got.count()
    by_id = [r["text"] for r in lines_from_requests(reqs, request_col="id").orderBy("idx").collect()]
    assert by_id == [x for i in range(400) for x in (f"a {i}", "", f"b {i}")]


def test_text_files_of_many_splits(spark, tmp_root):
    """Numbers in plain Python order over several files and splits, with and
    without the split table being sent, and blocks as full as those of a
    dense source."""
    from pyspark.sql import functions as F

    import logmold.sources.lines as L
    from logmold.operators.batching import cluster_blocks, with_signature

    want = []
    for name in ("a", "b", "c"):
        text = "".join(f"{name} line {i}\x0bpart {i}\n" if i % 50 == 0 else f"{name} line {i}\n" for i in range(3000))
        with open(f"{tmp_root}/{name}.log", "w") as f:
            f.write(text)
        want += [x.strip() for x in text.splitlines() if x.strip()]
    kept = L.BROADCAST_SPLITS, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for limit in (kept[0], 0):
            L.BROADCAST_SPLITS = limit
            lines = L.read_log_files(spark, f"{tmp_root}/*.log")
            assert [r["text"] for r in lines.orderBy("idx").collect()] == want
    finally:
        L.BROADCAST_SPLITS = kept[0]
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[1])
    signed = with_signature(lines.withColumn("text", F.lit("same")), 3)
    assert cluster_blocks(signed).count() == 1


def test_one_parse_per_stored_run(spark):
    """Everything made of a stored run reads its batch table."""
    r = parse_logs(lines_df(spark, TEXTS)).stored("test")
    for df in (r.logs, r.keys, R.run_totals(r.batches)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "parquet" in plan
    again = parse_logs(lines_df(spark, TEXTS))
    cols = ["cache_key", "hit", "first_batch_id", "key_batches", "template"]
    assert sorted(map(tuple, r.keys.select(*cols).collect())) == sorted(map(tuple, again.keys.select(*cols).collect()))
    assert sorted(map(tuple, r.logs.collect())) == sorted(map(tuple, again.logs.collect()))


def test_batch_statistics_equal_line_statistics(spark):
    from logmold.operators.stats import template_stats, template_stats_of

    r = parse_logs(lines_df(spark, ["", "", *TEXTS, ""]))
    of = template_stats_of(r.batches, "2024-01-01")
    assert sorted(map(tuple, of.collect())) == sorted(map(tuple, template_stats(r.logs, "2024-01-01").collect()))
    plan = of._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_line_numbers_of_any_ids(spark):
    """Ids near the end of BIGINT, negative ones and rows with many lines: numbers are dense and in order."""
    from logmold.sources.lines import text_lines

    ids = [-(1 << 63), -5, 3, 1 << 62, (1 << 63) - 1]
    rows = [(i, t, "\n".join(f"{i} {t} {k}" for k in range(n))) for i in ids for t, n in ((7, 1), (1 << 62, 3), (-2, 40))]
    df = spark.createDataFrame(rows, "id BIGINT, turn BIGINT, text STRING")
    got = text_lines(df.repartition(3), ["id", "turn"]).orderBy("idx").collect()
    want = [line for i, t, text in sorted(rows) for line in text.split("\n")]
    assert [r["text"] for r in got] == want and [r["idx"] for r in got] == list(range(len(want)))
    hashed = df.where("turn = 7").selectExpr("xxhash64(id) AS id", "text")
    assert [r["idx"] for r in text_lines(hashed, ["id"]).orderBy("idx").collect()] == list(range(5))


def test_counts_of_a_stored_run(spark):
    """A written run counts from its batch table what the cluster table says, an empty one nothing."""
    for texts in (TEXTS, []):
        r = parse_logs(lines_df(spark, texts))
        again = r.stored("counts")
        assert (again.line_count(), again.batch_count()) == (r.line_count(), r.batch_count())
        assert again.line_count() == len(texts)
