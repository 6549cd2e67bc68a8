"""Registered queries: name -> builder(spark, sf_dir) -> DataFrame.

Each builder reads the given tables (``events`` through the derived log
lines, ``documents``, ``conversations``) in full and returns a flat result
whose column names equal the DuckDB oracle's (``logmold.plans.oracle``).
Wall-clock values of the reference (run times) are fixed parameters here.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmold.functions import text as T
from logmold.operators import anomaly as AN
from logmold.operators import distinct as D
from logmold.operators import incidents as IN
from logmold.operators import parameters as PA
from logmold.operators import stats as S
from logmold.operators import trace as R
from logmold.operators import tree as TR
from logmold.operators.batching import assign_batches, clusters_from_blocks, cluster_blocks, collect_batches, with_signature
from logmold.operators.generators import CallableGenerator, ModelGenerator, common_words
from logmold.operators.parse import cache_hits, new_cache_entries, parse_logs
from logmold.sources import lines as L
from logmold.session import scratch_path, settle, stash
from logmold.sources import store as ST
from logmold.sources import variants as V

# Parameters of the registered queries (fixed; the reference uses wall-clock time).
BATCH_SIZE = 16
MIN_TOKENS = 3
RUN_TS = "2024-02-01 00:00:00"
HISTORY_SPLIT_TS = "2024-01-16 00:00:00"  # events before it form the earlier run
HISTORY_RUN_TS = "2024-01-16 00:00:00"
RETENTION_TS = "2024-02-20 00:00:00"
RETENTION_DAYS = 30
INSTANCE_LIMIT = 25
TOP_N = 10
RECENT_N = 5
STREAM_WINDOW = "1 hour"
STREAM_WATERMARK = "10 minutes"
WINDOW_WAIT = "6 hours"
STREAM_PARTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]  # ends of the first two of three triggers


def _lines(spark, sf_dir):
    return L.log_lines(spark, sf_dir)


def _parse(spark, sf_dir, **kw):
    return parse_logs(_lines(spark, sf_dir), batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS, **kw)


def _two_runs(spark, sf_dir):
    """History run (events before the split) then the current run with the
    cache the history run left behind."""
    ll = _lines(spark, sf_dir)
    early = F.col("ts") < F.lit(HISTORY_SPLIT_TS).cast("timestamp")
    # Each run's batch table is written once; its cache, stats and examples,
    # and the other run, read that table.
    first = parse_logs(ll.filter(early), batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS).stored("history")
    cache1 = new_cache_entries(first, HISTORY_RUN_TS)
    second = parse_logs(ll.filter(~early), cache=cache1, batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS).stored("current")
    return first, cache1, second


# --- row-local functions -----------------------------------------------------

def q_source_text_lines(spark, sf_dir):
    return L.document_lines(spark, sf_dir).select("idx", "doc_id", "pos", "text")


def q_log_signature(spark, sf_dir):
    ll = _lines(spark, sf_dir)
    return ll.select("idx", T.signature(F.col("text"), MIN_TOKENS).alias("cluster_id"))


def q_doc_signature(spark, sf_dir):
    dl = L.document_lines(spark, sf_dir)
    return dl.select("idx", T.signature(F.col("text"), MIN_TOKENS).alias("cluster_id"))


def q_log_level(spark, sf_dir):
    return _lines(spark, sf_dir).select("idx", T.log_level(F.col("text")).alias("level"))


def q_event_type(spark, sf_dir):
    return _lines(spark, sf_dir).select("idx", T.event_type(F.col("text")).alias("event_type"))


def q_masked(spark, sf_dir):
    return _lines(spark, sf_dir).select("idx", T.mask_dynamic_parts(F.col("text")).alias("masked"))


def q_doc_analysis(spark, sf_dir):
    dl = L.document_lines(spark, sf_dir)
    return dl.select(
        "idx", T.log_level(F.col("text")).alias("level"), T.event_type(F.col("text")).alias("event_type"),
        T.mask_dynamic_parts(F.col("text")).alias("masked"),
    )


def q_template_normalize(spark, sf_dir):
    ll = _lines(spark, sf_dir)
    return ll.select("idx", T.normalize_template(T.heuristic_template(F.col("text"))).alias("template"))


def q_doc_template_normalize(spark, sf_dir):
    dl = L.document_lines(spark, sf_dir)
    return dl.select("idx", T.normalize_template(T.heuristic_template(F.col("text"))).alias("template"))


def q_prompt_text(spark, sf_dir):
    batches = collect_batches(assign_batches(_lines(spark, sf_dir).select("idx", "text"), BATCH_SIZE, MIN_TOKENS))
    return batches.select("batch_id", T.build_prompt(F.transform("lines", lambda x: x["text"])).alias("prompt"))


def q_extract_template(spark, sf_dir):
    conv = L.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return conv.select("conv_id", "turn", T.extract_template(F.col("text")).alias("template"))


def q_classify_template(spark, sf_dir):
    dist = R.template_distribution(_parse(spark, sf_dir).batches)
    return dist.select(F.col("template").alias("template_text"), T.classify_template(F.col("template")).alias("label"))


def q_tree_bucket(spark, sf_dir):
    ll = _lines(spark, sf_dir)
    lvl = T.tree_level(T.log_level(F.col("text")))
    return ll.select(
        "idx", lvl.alias("level"), T.level_color(lvl).alias("color"),
        T.tree_bucket(F.col("text"), T.event_type(F.col("text"))).alias("bucket"),
    )


# --- clustering and batching -------------------------------------------------

def q_clusters(spark, sf_dir):
    signed = with_signature(_lines(spark, sf_dir).select("idx", "text"), MIN_TOKENS)
    cl = clusters_from_blocks(cluster_blocks(signed), BATCH_SIZE)  # nested ranges: no count needed
    return cl.select("cluster_id", "first_idx", "n_lines", "n_batches",
                     (F.col("batch_base") + 1).alias("first_batch_id"))


def q_batches(spark, sf_dir):
    b = collect_batches(assign_batches(_lines(spark, sf_dir).select("idx", "text"), BATCH_SIZE, MIN_TOKENS))
    return b.select("batch_id", "cluster_id", "number_of_logs", "first_idx", "cache_key")


def q_batch_source(spark, sf_dir):
    return _parse(spark, sf_dir).batches.select("batch_id", "cache_key", "source", "template")


def q_parsed_logs(spark, sf_dir):
    return _parse(spark, sf_dir).logs.select(
        "idx", "text", "batch_id", "cluster_id", "template", "source", "level", "event_type", "masked")


def q_doc_parsed_logs(spark, sf_dir):
    r = parse_logs(L.document_lines(spark, sf_dir), batch_size=BATCH_SIZE,
                   min_tokens=MIN_TOKENS)
    return r.logs.select("idx", "batch_id", "cluster_id", "template", "source")


# --- run views ----------------------------------------------------------------

def q_run_totals(spark, sf_dir):
    return R.run_totals(_parse(spark, sf_dir).batches)


def q_template_distribution(spark, sf_dir):
    return R.template_distribution(_parse(spark, sf_dir).batches)


def q_batch_distribution(spark, sf_dir):
    return R.batch_summary(_parse(spark, sf_dir).batches)


def q_template_stats(spark, sf_dir):
    return S.stats_view(S.template_stats_of(_parse(spark, sf_dir).batches, RUN_TS))


def _merged_stats(spark, sf_dir, runs=None):
    first, _, second = runs or _two_runs(spark, sf_dir)
    return S.merge_stats(S.template_stats_of(first.batches, HISTORY_RUN_TS), S.template_stats_of(second.batches, RUN_TS))


def q_template_stats_merged(spark, sf_dir):
    return S.stats_view(_merged_stats(spark, sf_dir))


def q_top_templates(spark, sf_dir):
    return S.top_templates(_merged_stats(spark, sf_dir), TOP_N)


def q_cache_warm_run(spark, sf_dir):
    """First run over the early events fills the cache; the second run parses
    every line with it (every repeated batch of the early part hits)."""
    ll = _lines(spark, sf_dir)
    early = F.col("ts") < F.lit(HISTORY_SPLIT_TS).cast("timestamp")
    first = parse_logs(ll.filter(early), batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS)
    cache = stash(new_cache_entries(first, HISTORY_RUN_TS), "cache")
    warm = parse_logs(ll, cache=cache, batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS)
    return warm.batches.select("batch_id", "cluster_id", "number_of_logs", "cache_key", "source", "template")


def q_cache_merged(spark, sf_dir):
    """The cache after both runs (new keys added, hits counted)."""
    _, cache1, second = _two_runs(spark, sf_dir)
    return ST.merge_cache(cache1, new_cache_entries(second, RUN_TS), cache_hits(second))


def q_example_orphans(spark, sf_dir):
    """Example rows of both runs whose template has no stats row in the
    history (templates first seen in the later run)."""
    first, _, second = _two_runs(spark, sf_dir)
    orphans = ST.orphan_examples(_examples(first, second), S.template_stats_of(first.batches, HISTORY_RUN_TS))
    return orphans.select("template_text", "original_log", "log_level", "event_type", "source", "batch_id",
                          "created_at", F.col("seq.run").alias("run"), F.col("seq.idx").alias("idx"))


def q_source_table(spark, sf_dir):
    """R2: template, usage, cache_pct, slm_pct of the merged stats."""
    return S.source_table(_merged_stats(spark, sf_dir))


def q_structure_table(spark, sf_dir):
    """Text, masked, level, event_type, source per line in trace order."""
    return R.structure_table(_parse(spark, sf_dir).logs)


def q_conversation_parsed_logs(spark, sf_dir):
    r = parse_logs(L.conversation_lines(spark, sf_dir), batch_size=BATCH_SIZE,
                   min_tokens=MIN_TOKENS)
    return r.logs.select("idx", "batch_id", "cluster_id", "template", "source", "level", "event_type")


def q_cache_retention(spark, sf_dir):
    _, cache1, second = _two_runs(spark, sf_dir)
    merged = ST.merge_cache(cache1, new_cache_entries(second, RUN_TS), cache_hits(second))
    return ST.retain_cache(merged, RETENTION_TS, RETENTION_DAYS)


# --- tree ---------------------------------------------------------------------

def _tree_inputs(spark, sf_dir):
    """The run with its batch table written once: the leaves, stats, instances,
    examples and debug branches all read the columns they need of it."""
    r = _parse(spark, sf_dir).stored("tree-run")
    latest = r.batch_count()
    return r, latest, TR.tree_lines(r.logs, latest)


def _tree_lines(spark, sf_dir):
    """Tree lines for a single consumer: nothing is written."""
    r = _parse(spark, sf_dir)
    return TR.tree_lines(r.logs, r.batch_count())


def q_tree_leaves(spark, sf_dir):
    r, latest, lines = _tree_inputs(spark, sf_dir)
    stats = S.template_stats_of(r.batches, RUN_TS)
    return TR.tree_leaves(lines, stats, latest, True, INSTANCE_LIMIT).drop("first_batch_id", "first_idx")


def q_tree_instances(spark, sf_dir):
    return TR.tree_instances(_tree_lines(spark, sf_dir), INSTANCE_LIMIT)


def q_tree_examples(spark, sf_dir):
    return TR.tree_examples(_tree_lines(spark, sf_dir))


def q_tree_debug(spark, sf_dir):
    return TR.tree_debug(_tree_lines(spark, sf_dir))


def q_tree_json(spark, sf_dir):
    r, latest, lines = _tree_inputs(spark, sf_dir)
    stats = S.template_stats_of(r.batches, RUN_TS)
    docs = TR.leaf_documents(
        TR.tree_leaves(lines, stats, latest, True, INSTANCE_LIMIT),
        TR.tree_instances(lines, INSTANCE_LIMIT), TR.tree_examples(lines), TR.tree_debug(lines), cluster_ids=True,
    )
    return TR.leaf_json(docs)


def _tree_rows(r, run_ts, debug=False):
    latest = r.batch_count()
    lines = TR.tree_lines(r.logs, latest)
    docs = TR.leaf_documents(TR.tree_leaves(lines, S.template_stats_of(r.batches, run_ts), latest, True, INSTANCE_LIMIT),
                             TR.tree_instances(lines, INSTANCE_LIMIT), TR.tree_examples(lines), TR.tree_debug(lines) if debug else None)
    return TR.leaf_json(docs), latest


def q_tree_snapshot_latest(spark, sf_dir):
    """S8 + S9: both runs append their tree snapshot to a table in
    the shared checkpoint folder; the latest snapshot is read back and its
    leaf JSON parsed."""
    first, _, second = _two_runs(spark, sf_dir)
    store = ST.EpochTables(spark, scratch_path(spark, "tree-history"))
    for sid, (run, ts) in enumerate([(first, HISTORY_RUN_TS), (second, RUN_TS)], start=1):
        rows, latest = _tree_rows(run, ts)
        total = run.line_count()
        ST.append_snapshot(store, ST.snapshot_rows(rows, sid, ts, latest, total))
    snap = ST.latest_snapshot(ST.load_tree_history(store))
    leaf = F.from_json("tree_data", TR.LEAF_SCHEMA)
    return snap.select("snapshot_id", "batch_id", "total_logs", "level", "event_type", "template_text",
                       leaf["count"].alias("count"), leaf["source"]["cache"].alias("cache"),
                       leaf["source"]["slm"].alias("slm"), leaf["instances_total"].alias("instances_total"))


def q_cache_hottest(spark, sf_dir):
    """O6 as a report: the ten cache entries served most often after both
    runs (nulls last, ties by key)."""
    return ST.hottest_cache(q_cache_merged(spark, sf_dir)).limit(TOP_N)


def q_stats_persisted(spark, sf_dir):
    """S7 + U2: each run appends its stats to a table in the shared
    checkpoint folder; reading folds the epochs (U3 on read)."""
    first, _, second = _two_runs(spark, sf_dir)
    store = ST.EpochTables(spark, scratch_path(spark, "stats"))
    ST.append_stats(store, S.template_stats_of(first.batches, HISTORY_RUN_TS))
    ST.append_stats(store, S.template_stats_of(second.batches, RUN_TS))
    return ST.load_stats(store)


EVENT_SCHEMA = ("level STRING, logger STRING, message STRING, ts STRING, batch_id BIGINT, cluster_id STRING, "
                "number_of_logs BIGINT, cache_key STRING, source STRING, slm_raw_output STRING, "
                "total_logs BIGINT, batch_count BIGINT, template_count BIGINT, logs ARRAY<STRUCT<text: STRING, "
                "template: STRING, source: STRING, level: STRING, event_type: STRING, masked: STRING>>")


def q_event_log(spark, sf_dir):
    """The run's JSON-lines event records, written and read back with a
    schema (batch_processed per batch, one run_completed)."""
    r = _parse(spark, sf_dir)
    path = scratch_path(spark, "events")
    R.write_events(r.batches, path, RUN_TS)
    ev = spark.read.schema(EVENT_SCHEMA).json(path)
    return ev.select("level", "logger", "message", "ts", "batch_id", "cluster_id", "number_of_logs", "cache_key", "source",
                     "slm_raw_output", "total_logs", "batch_count", "template_count", F.to_json("logs").alias("logs_json"))


def q_run_trace_json(spark, sf_dir):
    return R.batch_trace_json(_parse(spark, sf_dir).batches)


def _examples(first, second):
    return ST.example_rows(first.logs, HISTORY_RUN_TS, 0).unionByName(ST.example_rows(second.logs, RUN_TS, 1))


def q_recent_examples(spark, sf_dir):
    runs = _two_runs(spark, sf_dir)
    first, _, second = runs
    examples = _examples(first, second)
    stats = _merged_stats(spark, sf_dir, runs)
    recent = ST.recent_examples(examples, RECENT_N)
    known = stats.select("template_text", F.lit(True).alias("has_stats"))
    return recent.join(known, "template_text", "left").select(
        "template_text", "rank", "original_log", "log_level", "event_type", "source", "batch_id", "created_at",
        F.coalesce(F.col("has_stats"), F.lit(False)).alias("has_stats"),
    )


# --- pluggable generator --------------------------------------------------------

def _echo_model_factory(patterns: list[str]):
    """A stand-in model: answers with the first prompt line after ``Logs:``,
    masked like the fallback, in the raw shape a model returns. Built as a
    closure so the worker needs nothing but the pattern strings."""

    def factory():
        import re

        pats = [re.compile(p) for p in patterns]

        def generate(prompt: str) -> str:
            body = prompt.split("Logs:\n", 1)[1]
            first = body.split("\n", 1)[0][2:]
            for p in pats:
                first = p.sub("<*>", first)
            return f"Template: {first}\nextra words"

        return generate

    return factory


def q_pluggable_parser(spark, sf_dir):
    r = _parse(spark, sf_dir, generator=ModelGenerator(_echo_model_factory(list(T.TEMPLATE_MASK_ORDER))))
    return r.batches.select("batch_id", "cache_key", "source", "template")


def q_common_words_parser(spark, sf_dir):
    """P1 with a plain callable: the words that all lines of a batch share."""
    r = _parse(spark, sf_dir, generator=CallableGenerator(common_words))
    return r.batches.select("batch_id", "cache_key", "source", "template")


# --- streaming ------------------------------------------------------------------

def q_stream_parse(spark, sf_dir):
    from logmold.streaming.stream import stream_parse_events

    return stream_parse_events(spark, sf_dir, batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS, run_ts=RUN_TS).select(
        "idx", "batch_id", "cluster_id", "template", "source", "level", "event_type")


def q_stream_level_counts(spark, sf_dir):
    from logmold.streaming.stream import stream_level_counts

    return stream_level_counts(spark, sf_dir, window=STREAM_WINDOW, watermark=STREAM_WATERMARK)


# --- state, models and streams over several runs ---------------------------------

def q_cache_store_run(spark, sf_dir):
    """S6 + J4: the history run appends its cache to the store; the later run
    loads it from there, and appends its own entries and hits."""
    ll = _lines(spark, sf_dir)
    early = F.col("ts") < F.lit(HISTORY_SPLIT_TS).cast("timestamp")
    store = ST.EpochTables(spark, scratch_path(spark, "cache-store"))
    for part, ts in ((early, HISTORY_RUN_TS), (~early, RUN_TS)):
        run = parse_logs(ll.filter(part), cache=ST.load_cache(store), batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS).stored("run")
        ST.append_cache(store, ST.cache_delta(new_cache_entries(run, ts), cache_hits(run)))
    cache = ST.load_cache(store).select("cache_key", "template_text", "hit_count")
    return run.batches.select("batch_id", "cache_key", "source").join(cache, "cache_key")


def q_examples_store(spark, sf_dir):
    """S10 + O4: each run appends its example rows; the newest per template
    are read back."""
    first, _, second = _two_runs(spark, sf_dir)
    store = ST.EpochTables(spark, scratch_path(spark, "examples"))
    ST.append_examples(store, ST.example_rows(first.logs, HISTORY_RUN_TS, 0))
    ST.append_examples(store, ST.example_rows(second.logs, RUN_TS, 1))
    return ST.recent_examples(ST.load_examples(store), RECENT_N).select(
        "template_text", "rank", "original_log", "log_level", "event_type", "source", "batch_id", "created_at")


def q_state_counts(spark, sf_dir):
    """A9 + U4 + J4: templates in the persisted stats, entries the retention
    removes and keeps, and point lookups of both."""
    first, cache1, second = _two_runs(spark, sf_dir)
    store = ST.EpochTables(spark, scratch_path(spark, "state"))
    ST.append_stats(store, S.template_stats_of(first.batches, HISTORY_RUN_TS))
    ST.append_stats(store, S.template_stats_of(second.batches, RUN_TS))
    ST.save_cache(store, ST.merge_cache(cache1, new_cache_entries(second, RUN_TS), cache_hits(second)))
    cache = ST.load_cache(store)
    kept = ST.retain_cache(cache, RETENTION_TS, RETENTION_DAYS)
    top = ST.hottest_cache(cache).first()
    return kept.agg(F.count(F.lit(1)).alias("kept")).select(
        F.lit(ST.persisted_template_count(store)).cast("long").alias("templates"),
        F.lit(ST.expired_count(cache, RETENTION_TS, RETENTION_DAYS)).cast("long").alias("removed"), "kept",
        F.lit(ST.cache_get(cache, top["cache_key"]).first()["template_text"]).alias("hottest"))


def q_tree_leaves_plain(spark, sf_dir):
    """T3 + W3: current-batch overlay off, no instances shown."""
    r, latest, lines = _tree_inputs(spark, sf_dir)
    return TR.tree_leaves(lines, S.template_stats_of(r.batches, RUN_TS), latest, False, 0).drop("first_batch_id", "first_idx")


def _failing_model_factory(patterns: list[str]):
    """As the echo model, but it raises on prompts about disks."""
    echo = _echo_model_factory(patterns)

    def factory():
        answer = echo()

        def generate(prompt: str) -> str:
            if "Disk error" in prompt.split("Logs:\n", 1)[1].split("\n", 1)[0]:
                raise RuntimeError("no answer")
            return answer(prompt)

        return generate

    return factory


def _failing_run(spark, sf_dir):
    return _parse(spark, sf_dir, generator=ModelGenerator(_failing_model_factory(list(T.TEMPLATE_MASK_ORDER))))


def q_model_fallback(spark, sf_dir):
    """Raw answers of a model, and the fallback where it raises."""
    return _failing_run(spark, sf_dir).batches.select("batch_id", "source", "template", "slm_raw_output", "used_fallback")


def q_tree_debug_model(spark, sf_dir):
    """Cluster ids and raw outputs of each leaf of a model's run."""
    r = _failing_run(spark, sf_dir)
    return TR.tree_debug(TR.tree_lines(r.logs, r.batch_count()))


def q_request_parsed_logs(spark, sf_dir):
    """Each conversation as one parse request, its turns as the lines."""
    turns = L.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    requests = turns.select("conv_id", F.transform("turns", lambda x: x["text"]).alias("logs"))
    r = parse_logs(L.lines_from_requests(requests, request_col="conv_id"), batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS)
    return r.logs.select("idx", "batch_id", "cluster_id", "template", "source")


def q_stream_parse_triggers(spark, sf_dir):
    """X1 over three triggers: later ones find the cache of earlier ones."""
    from logmold.streaming.stream import stream_parse_parts

    return stream_parse_parts(spark, sf_dir, STREAM_PARTS, batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS, run_ts=RUN_TS).select(
        "epoch", "idx", "batch_id", "cluster_id", "template", "source")


def q_stream_late_rows(spark, sf_dir):
    """X2 with a second trigger that moves the watermark and a third whose rows
    are all behind it: they change nothing."""
    from logmold.streaming.stream import stream_level_counts_late

    return stream_level_counts_late(spark, sf_dir, HISTORY_SPLIT_TS, window=STREAM_WINDOW, watermark=STREAM_WATERMARK)


# --- batches over triggers, parameters, anomalies, incidents ----------------------

def q_stream_windows(spark, sf_dir):
    """Batches by number of lines or time since their first line, carried over four triggers."""
    from logmold.streaming.microbatch import stream_windows_of_events

    return stream_windows_of_events(spark, sf_dir, STREAM_PARTS, scratch_path(spark, "windows"), BATCH_SIZE, WINDOW_WAIT, MIN_TOKENS).select(
        "cluster_id", "batch_no", "closed_by", "number_of_logs", "first_idx", "last_idx", "cache_key", "template")


def q_line_parameters(spark, sf_dir):
    return PA.line_parameters(_parse(spark, sf_dir).logs)


def _timed(spark, sf_dir):
    """The parsed lines with the time and user of their events."""
    logs = _parse(spark, sf_dir).stored("timed").logs
    events = L.table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "ts", "user_id")
    return logs.join(events, "idx")


def q_count_anomalies(spark, sf_dir):
    return AN.count_anomalies(stash(AN.hourly_counts(_timed(spark, sf_dir)), "hourly"))


def q_early_warnings(spark, sf_dir):
    return AN.early_warnings(stash(AN.hourly_counts(_timed(spark, sf_dir)), "hourly"))


def q_sequence_anomalies(spark, sf_dir):
    steps = stash(AN.user_steps(_timed(spark, sf_dir)), "steps")
    templates = steps.select("template").distinct().count()
    return AN.sequence_anomalies(steps, AN.transition_counts(steps), templates)


def q_incidents(spark, sf_dir):
    return IN.incidents(_timed(spark, sf_dir))


def q_incident_templates(spark, sf_dir):
    logs = stash(_timed(spark, sf_dir).select("ts", "template", "level", "event_type"), "timed")
    return IN.incident_templates(logs, stash(IN.incidents(logs), "incidents"))


def q_similar_incidents(spark, sf_dir):
    """Each incident's most similar others, by the templates around them."""
    members = q_incident_templates(spark, sf_dir).select(
        F.concat("event_type", F.lit("@"), F.col("started").cast("string")).alias("id"), F.col("template").alias("token"))
    return IN.similar_sets(members).select(F.col("id").alias("incident"), "rank", F.col("other").alias("similar_to"), "shared", "similarity")


def _templates(lines):
    """The distinct templates of a run, written once: those of its keys, as a batch has its key's."""
    settle(lines.sparkSession)
    keys = parse_logs(lines, batch_size=BATCH_SIZE, min_tokens=MIN_TOKENS).keys
    templates = stash(keys.select("template").distinct(), "templates")
    del keys
    settle(lines.sparkSession)
    return templates


def q_similar_templates(spark, sf_dir):
    """Each template's most similar others by their words, over the lines of documents."""
    sets = IN.template_sets(_templates(L.document_lines(spark, sf_dir)))
    return IN.similar_token_sets(sets).select(
        F.col("id").alias("template"), "rank", F.col("other").alias("similar_to"), "shared", "similarity")


def q_template_vectors(spark, sf_dir):
    """Sparse vectors of the templates of all documents, by document frequencies that are fitted and stored."""
    templates = _templates(L.document_lines(spark, sf_dir))
    tokens = IN.template_tokens(templates, written=True)
    settle(spark)
    store = ST.EpochTables(spark, scratch_path(spark, "vectors"))
    store.write("frequencies", IN.document_frequencies(tokens))
    fitted = store.read("frequencies", "token STRING, df BIGINT")
    return IN.template_vectors(tokens, fitted, IN.with_tokens(templates).count())


# --- distinct counts over runs, snapshots of any shape ----------------------------

def q_distinct_over_runs(spark, sf_dir):
    """A1 + U3: distinct templates, clusters and lines of both runs, of the
    first, of the second, in both and new, from the sketches that each run left."""
    first, _, second = _two_runs(spark, sf_dir)
    store = ST.EpochTables(spark, scratch_path(spark, "sketches"))
    for run in (first, second):
        latest = D.append_sketches(store, D.run_sketches(run.logs))
    return D.distinct_over_runs(store, latest)


def _snapshot_documents(spark, sf_dir):
    """Both runs' snapshots in one table of VARIANT documents, those of the
    second with debug values, which the first lacks."""
    first, _, second = _two_runs(spark, sf_dir)
    store = ST.EpochTables(spark, scratch_path(spark, "documents"))
    for sid, (run, ts, debug) in enumerate([(first, HISTORY_RUN_TS, False), (second, RUN_TS, True)], start=1):
        rows, latest = _tree_rows(run, ts, debug)
        V.append_documents(store, V.documents(ST.snapshot_rows(rows, sid, ts, latest, run.line_count())))
    return V.load_documents(store)


def q_snapshot_documents(spark, sf_dir):
    """Values of all snapshots by path, without a schema of the documents."""
    found = V.values(_snapshot_documents(spark, sf_dir), {
        "template_text": ("$.template_text", "string"), "count": ("$.count", "bigint"), "cache": ("$.source.cache", "bigint"),
        "cache_pct": ("$.source.cache_pct", "double"), "cache_hit": ("$.debug.cache_hit", "bigint"),
        "clusters": ("$.debug.cluster_count", "bigint"), "first_log": ("$.instances[0].original_log", "string"),
        "_instances": ("$.instances", "array<variant>")})
    return found.select("snapshot_id", "batch_id", "total_logs", "level", "event_type", "template_text", "count", "cache", "cache_pct",
                        "cache_hit", "clusters", "first_log", F.size("_instances").cast("long").alias("instances"))


def q_snapshot_shapes(spark, sf_dir):
    """The keys of each snapshot's documents, with their kinds."""
    return V.shapes(_snapshot_documents(spark, sf_dir), "snapshot_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_text_lines": q_source_text_lines,
    "log_signature": q_log_signature,
    "doc_signature": q_doc_signature,
    "log_level": q_log_level,
    "event_type": q_event_type,
    "masked": q_masked,
    "doc_analysis": q_doc_analysis,
    "template_normalize": q_template_normalize,
    "doc_template_normalize": q_doc_template_normalize,
    "prompt_text": q_prompt_text,
    "extract_template": q_extract_template,
    "classify_template": q_classify_template,
    "tree_bucket": q_tree_bucket,
    "clusters": q_clusters,
    "batches": q_batches,
    "batch_source": q_batch_source,
    "parsed_logs": q_parsed_logs,
    "doc_parsed_logs": q_doc_parsed_logs,
    "run_totals": q_run_totals,
    "template_distribution": q_template_distribution,
    "batch_distribution": q_batch_distribution,
    "template_stats": q_template_stats,
    "template_stats_merged": q_template_stats_merged,
    "top_templates": q_top_templates,
    "cache_warm_run": q_cache_warm_run,
    "cache_retention": q_cache_retention,
    "cache_merged": q_cache_merged,
    "example_orphans": q_example_orphans,
    "source_table": q_source_table,
    "structure_table": q_structure_table,
    "conversation_parsed_logs": q_conversation_parsed_logs,
    "tree_leaves": q_tree_leaves,
    "tree_instances": q_tree_instances,
    "tree_examples": q_tree_examples,
    "tree_debug": q_tree_debug,
    "tree_json": q_tree_json,
    "run_trace_json": q_run_trace_json,
    "tree_snapshot_latest": q_tree_snapshot_latest,
    "cache_hottest": q_cache_hottest,
    "stats_persisted": q_stats_persisted,
    "event_log": q_event_log,
    "recent_examples": q_recent_examples,
    "pluggable_parser": q_pluggable_parser,
    "stream_parse": q_stream_parse,
    "stream_level_counts": q_stream_level_counts,
    "cache_store_run": q_cache_store_run,
    "examples_store": q_examples_store,
    "state_counts": q_state_counts,
    "tree_leaves_plain": q_tree_leaves_plain,
    "model_fallback": q_model_fallback,
    "tree_debug_model": q_tree_debug_model,
    "request_parsed_logs": q_request_parsed_logs,
    "stream_parse_triggers": q_stream_parse_triggers,
    "stream_late_rows": q_stream_late_rows,
    "stream_windows": q_stream_windows,
    "line_parameters": q_line_parameters,
    "count_anomalies": q_count_anomalies,
    "early_warnings": q_early_warnings,
    "sequence_anomalies": q_sequence_anomalies,
    "incidents": q_incidents,
    "incident_templates": q_incident_templates,
    "similar_incidents": q_similar_incidents,
    "similar_templates": q_similar_templates,
    "template_vectors": q_template_vectors,
    "common_words_parser": q_common_words_parser,
    "distinct_over_runs": q_distinct_over_runs,
    "snapshot_documents": q_snapshot_documents,
    "snapshot_shapes": q_snapshot_shapes,
}
