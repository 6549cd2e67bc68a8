"""Command line: ``python -m logmold <command> ...``.

* ``templates --logs L1 L2 ...``  print one template per line given (S1, S4).
* ``parse --input GLOB --out DIR [--state DIR]``  parse log files; write the
  trace (lines, batches, JSON-lines events) under DIR and, with ``--state``,
  read the persisted cache and append the run's cache / stats / examples
  (S3, S5-S7, S10, U1-U2).
* ``stats --state DIR [--top N]``  most used templates (O2).
* ``tree --trace DIR [--state DIR] --out DIR``  leaf JSON rows of the tree of a
  written trace (T1-T5), with ``--instance-limit``, ``--debug``,
  ``--no-current-batch``.
* ``retain --state DIR [--days 30]``  drop cache entries not written within
  the last days, print how many (U4).
* ``cache --state DIR [--top N]``  cache entries served most often (O6).
* ``classify --template T``  ``error`` / ``normal`` (F12).

Everything large is written by Spark; only small answers (the templates of
lines given on the command line, a top-N, a label) are printed.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import functions as F


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="logmold")
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("templates")
    t.add_argument("--logs", nargs="*", default=[])
    for name in ("parse",):
        q = sub.add_parser(name)
        q.add_argument("--input", required=True)
        q.add_argument("--out", required=True)
        q.add_argument("--state")
        q.add_argument("--run-ts", default=None)
    s = sub.add_parser("stats")
    s.add_argument("--state", required=True)
    s.add_argument("--top", type=int, default=10)
    tr = sub.add_parser("tree")
    tr.add_argument("--trace", required=True)
    tr.add_argument("--state")
    tr.add_argument("--out", required=True)
    tr.add_argument("--instance-limit", type=int, default=25)
    tr.add_argument("--debug", action="store_true")
    tr.add_argument("--no-current-batch", action="store_true")
    rt = sub.add_parser("retain")
    rt.add_argument("--state", required=True)
    rt.add_argument("--days", type=int, default=30)
    rt.add_argument("--run-ts", default=None)
    hc = sub.add_parser("cache")
    hc.add_argument("--state", required=True)
    hc.add_argument("--top", type=int, default=10)
    c = sub.add_parser("classify")
    c.add_argument("--template", required=True)
    for q in (t, sub.choices["parse"]):
        q.add_argument("--batch-size", type=int, default=16)
        q.add_argument("--min-tokens", type=int, default=3)
    args = p.parse_args(argv)

    from logmold.session import get_session

    spark = get_session()
    if args.cmd == "templates":
        from logmold.operators.parse import parse_templates
        from logmold.sources.lines import lines_from_list

        if not args.logs:
            print("Provide logs with --logs")
            return 0
        out = parse_templates(lines_from_list(spark, args.logs), batch_size=args.batch_size,
                              min_tokens=args.min_tokens)
        for row in out.orderBy("idx").toLocalIterator():
            print(row["template"])
        return 0

    if args.cmd == "classify":
        from logmold.functions.text import classify_template

        df = spark.createDataFrame([(args.template,)], "t STRING")
        print(df.select(classify_template(F.col("t"))).first()[0])
        return 0

    from logmold.operators import stats as S
    from logmold.operators import trace as R
    from logmold.operators import tree as TR
    from logmold.sources import store as ST

    if args.cmd == "parse":
        from logmold.operators.parse import cache_hits, new_cache_entries, parse_logs
        from logmold.sources.lines import read_log_files

        run_ts = args.run_ts or _now()
        store = ST.EpochTables(spark, args.state) if args.state else None
        cache = ST.load_cache(store) if store else None
        run = parse_logs(read_log_files(spark, args.input), cache=cache,
                         batch_size=args.batch_size, min_tokens=args.min_tokens)
        run.batches.write.mode("overwrite").parquet(f"{args.out}/trace_batches")
        run = run.over(spark.read.schema(run.batches.schema).parquet(f"{args.out}/trace_batches"))
        logs = run.logs.select("idx", "text", "batch_id", "cluster_id", "template", "source", "slm_raw_output",
                               "level", "event_type", "masked")
        metrics = R.run_with_metrics(logs, lambda df: df.write.mode("overwrite").parquet(f"{args.out}/trace_logs"))
        logs = spark.read.parquet(f"{args.out}/trace_logs")
        R.write_events(run.batches, f"{args.out}/events", run_ts)
        if store:
            ST.append_cache(store, ST.cache_delta(new_cache_entries(run, run_ts), cache_hits(run)))
            ST.append_stats(store, S.template_stats_of(run.batches, run_ts))
            ST.append_examples(store, ST.example_rows(logs, run_ts, store.next_epoch("example_logs")))
        print({k: metrics[k] for k in ("total_logs", "batch_count", "cache_logs", "slm_logs", "processing_time_ms")})
        return 0

    if args.cmd == "stats":
        store = ST.EpochTables(spark, args.state)
        for row in S.top_templates(ST.load_stats(store), args.top).toLocalIterator():
            print(f"{row['usage_count']:>10}  {row['template_text']}")
        return 0

    if args.cmd == "retain":
        store = ST.EpochTables(spark, args.state)
        run_ts = args.run_ts or _now()
        version = store.next_epoch("template_cache")
        cache = ST.load_cache(store, before=version)
        removed = ST.expired_count(cache, run_ts, args.days)
        ST.save_cache(store, ST.retain_cache(cache, run_ts, args.days), version)
        print(removed)
        return 0

    if args.cmd == "cache":
        store = ST.EpochTables(spark, args.state)
        for row in ST.hottest_cache(ST.load_cache(store)).limit(args.top).toLocalIterator():
            print(f"{row['hit_count'] if row['hit_count'] is not None else '-':>8}  {row['cache_key'][:16]}  "
                  f"{row['template_text']}")
        return 0

    if args.cmd == "tree":
        logs = spark.read.parquet(f"{args.trace}/trace_logs")
        latest = TR.latest_batch_id(logs)
        lines = TR.tree_lines(logs, latest)
        stats = ST.load_stats(ST.EpochTables(spark, args.state)) if args.state else None
        leaves = TR.tree_leaves(lines, stats, latest, not args.no_current_batch, args.instance_limit)
        docs = TR.leaf_documents(leaves, TR.tree_instances(lines, args.instance_limit), TR.tree_examples(lines),
                                 TR.tree_debug(lines) if args.debug else None)
        TR.leaf_json(docs).write.mode("overwrite").parquet(args.out)
        if args.debug:
            TR.tree_debug(lines).write.mode("overwrite").parquet(f"{args.out}_debug")
        if args.state:
            store = ST.EpochTables(spark, args.state)
            rows = spark.read.parquet(args.out)
            sid = store.next_epoch("tree_history")
            ST.append_snapshot(store, ST.snapshot_rows(rows, sid, _now(), latest, logs.count()))
        return 0
    return 1


if __name__ == "__main__":
    sys.exit(main())
