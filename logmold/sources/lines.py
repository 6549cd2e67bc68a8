"""Line sources (S1-S3) and the derived log-line tables used by the queries.

Every source returns ``(idx BIGINT, text STRING[, ...])``. ``idx`` is the
input order: batching cuts clusters into consecutive runs of lines in that
order, so it must be explicit, unique and stable on recompute. It need not be
dense; every operator only compares ``idx`` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmold.functions.text import LINE_BREAK, py_strip
from logmold.operators.batching import exclusive_running_sum
from logmold.session import ensure_checkpoint_dir, stash

#: Lines of one block of a source of text files.
BLOCK_LINES = 1 << 20
#: Splits of a text input whose first line numbers are sent to all tasks.
BROADCAST_SPLITS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_input(df: DataFrame) -> DataFrame:
    """Dealt out over as many partitions as ``logmold.input.partitions`` says
    (for one small file that is a single split); unset, the scan's own."""
    n = df.sparkSession.conf.get("logmold.input.partitions", None)
    return df.repartition(int(n)) if n else df


def lines_from_list(spark: SparkSession, logs: list[str]) -> DataFrame:
    """Lines given on the command line (list position is the order)."""
    rows = [(i, "" if t is None else str(t)) for i, t in enumerate(logs)]
    return spark.createDataFrame(rows, "idx BIGINT, text STRING")


def ordered_lines(df: DataFrame, keys: list[str], lines: Column, count: Column, keep: list[str] | None = None) -> DataFrame:
    """``idx, <keys>, <keep>, pos, raw`` of the lines in an array column, in the
    order of ``keys`` (BIGINT, any values; together unique) and position.

    ``idx`` is the number of lines before: dense, so it can't overflow whatever
    the keys are. ``count`` tells a row's lines without splitting it. The counts of
    rows, by key, go through running sums over nested ranges (no window over
    all rows, nor over all rows of a hot first key), are written once, and join
    the rows by their keys.
    """
    rows = df.select(*[F.col(k).cast("long").alias(k) for k in keys], *(keep or []), lines.alias("_lines"), count.cast("long").alias("_n"))
    sizes = stash(rows.groupBy(*keys).agg(F.sum("_n").alias("_n")), "line-counts")
    bits = (20, 40)
    base = exclusive_running_sum(sizes.groupBy(keys[0]).agg(F.sum("_n").alias("_n")), [], keys[0], "_n", "_before", bits).select(keys[0], "_before")
    for k in range(1, len(keys)):
        inner = exclusive_running_sum(sizes.groupBy(*keys[:k + 1]).agg(F.sum("_n").alias("_n")), keys[:k], keys[k], "_n", "_inside", bits)
        base = inner.join(base, keys[:k]).select(*keys[:k + 1], (F.col("_before") + F.col("_inside")).alias("_before"))
    base = stash(base, "line-bases")
    return rows.join(base, keys).select(*keys, *(keep or []), "_before", F.posexplode("_lines").alias("pos", "raw")).select(
        (F.col("_before") + F.col("pos")).alias("idx"), *keys, *(keep or []), F.col("pos").cast("int").alias("pos"), "raw")


def lines_from_requests(df: DataFrame, logs_col: str = "logs", request_col: str | None = None) -> DataFrame:
    """Parse requests ``{"logs": [...]}``; blank lines are kept.

    ``request_col`` orders the requests; without it requests keep the scan
    order (stable for the same files), taken from ``monotonically_increasing_id``.
    """
    req = F.col(request_col) if request_col else F.monotonically_increasing_id()
    rows = df.select(req.alias("_req"), F.col(logs_col).alias("_logs"))
    size = F.greatest(F.size("_logs"), F.lit(0))
    return ordered_lines(rows, ["_req"], F.col("_logs"), size).select("idx", F.coalesce("raw", F.lit("")).alias("text"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """S2 from JSON-lines files, one request object per line."""
    return lines_from_requests(spark.read.schema("logs ARRAY<STRING>").json(path))


def split_text_lines(text: Column) -> Column:
    """Python ``splitlines()`` boundaries as one Spark split."""
    return F.split(F.coalesce(text, F.lit("")), f"(?U){LINE_BREAK}")


def _stripped(lines: DataFrame) -> DataFrame:
    """Stripped, non-blank lines: ``raw`` becomes ``text``."""
    return lines.withColumn("text", py_strip(F.col("raw"))).drop("raw").filter(F.col("text") != F.lit(""))


def text_lines(df: DataFrame, keys: list[str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """S3: multi-line text -> stripped, non-blank lines, ordered by (keys, position);
    written once, since every consumer reads the lines twice or more."""
    count = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"(?U){LINE_BREAK}")) + 1
    return stash(_stripped(ordered_lines(df, keys, split_text_lines(F.col(text_col)), count, keep)), "lines")


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """S3 from text files: stripped, non-blank lines in (file path, offset)
    order, with ``idx`` numbered without a global sort.

    ``spark.read.text`` splits on \\n, \\r and \\r\\n only; the remaining Python
    line boundaries split a physical line further (``idx`` leaves room for the
    most that any line has; usually none has, and idx is the line number).
    Numbering: rows per (file, split) are counted, a running sum over the
    splits (one row each) gives each split its first line number, and a row's
    offset inside its split comes from ``monotonically_increasing_id``.
    Splits of one file are scanned in offset order, so ids are stable. The
    split table is sent to the lines where it is small enough, so that the
    text isn't shuffled for its numbers.
    """
    ensure_checkpoint_dir(spark)
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("mono"), "value",
    )
    per_split = raw.groupBy("file", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("mono").alias("first_mono"),
        F.max(F.size(split_text_lines(F.col("value")))).alias("most")).checkpoint(eager=True)
    splits, most = per_split.agg(F.count("*"), F.coalesce(F.max("most"), F.lit(1))).first()
    running = Window.orderBy("file", "first_mono").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_split.select("file", "part", "first_mono",
                             F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    if splits <= BROADCAST_SPLITS:
        bases = F.broadcast(bases)
    numbered = raw.join(bases, ["file", "part"]).select(
        "file", (F.col("base") + F.col("mono") - F.col("first_mono")).alias("line_no"), "value")
    exploded = numbered.select("file", "line_no", F.posexplode(split_text_lines(F.col("value"))).alias("pos", "raw"))
    return _stripped(exploded.select(
        (F.col("line_no") * F.lit(most).cast("long") + F.col("pos")).alias("idx"),
        F.expr(f"line_no div {BLOCK_LINES}L").alias("block"), "file", "raw"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents``: idx, doc_id, pos, text (whole documents, every line)."""
    return text_lines(spread_input(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``conversations``, by conversation and turn."""
    conv = spread_input(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return text_lines(conv, ["conv_id", "turn"], keep=["role"])


def events_to_log_lines(events: DataFrame) -> DataFrame:
    """Derive one synthetic log line per event (FIXTURES.md section 1).

    A pure projection of ``events`` (no shuffle); ``idx`` is ``event_id``.
    """
    k = F.col("k")
    u = F.col("user_id").cast("string")
    ks = k.cast("string")
    h = F.md5(F.col("event_id").cast("string"))
    et = F.col("event_type")
    text = (
        F.when(k % 25 == 0, F.lit("heartbeat ok"))
        .when(et == "signup", F.concat(F.lit("INFO User "), u, F.lit(" logged in from 10.0."),
                                       (F.col("user_id") % 256).cast("string"), F.lit("."), ks))
        .when(et == "view", F.concat(F.lit("GET /api/page/"), ks, F.lit(" http status 200 for user "), u))
        .when(et == "click", F.concat(F.lit("warning: connection retry "), ks, F.lit(" to node "), u,
                                      F.lit(" addr 0x"), F.lower(F.hex(F.col("user_id"))), F.lit(" "), ks))
        .when(et == "purchase", F.concat(F.lit("Transaction "), F.substring(h, 1, 8), F.lit("-"),
                                         F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"),
                                         F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12),
                                         F.lit(" committed for account "), u))
        .when(k % 3 == 0, F.concat(F.lit("Disk error on node "), u, F.lit(" code 0x"), F.lower(F.hex(k))))
        .when(k % 3 == 1, F.concat(F.lit("login failed for user "), u))
        .otherwise(F.concat(F.lit("service latency timed out after "), ks, F.lit("ms")))
    )
    with_k = events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    return with_k.select(F.col("event_id").alias("idx"), F.col("ts"), F.coalesce(text, F.lit("")).alias("text"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_log_lines(
        spread_input(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"))
    )


# SQL text of the same derivation, for the DuckDB oracle (FIXTURES.md section 1).
LOG_LINES_SQL = """
select event_id as idx, ts,
  case
    when k % 25 = 0 then 'heartbeat ok'
    when event_type = 'signup'   then 'INFO User ' || u || ' logged in from 10.0.' || cast(user_id % 256 as string) || '.' || ks
    when event_type = 'view'     then 'GET /api/page/' || ks || ' http status 200 for user ' || u
    when event_type = 'click'    then 'warning: connection retry ' || ks || ' to node ' || u || ' addr 0x' || lower(hex(user_id)) || ' ' || ks
    when event_type = 'purchase' then 'Transaction ' || substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) || ' committed for account ' || u
    when k % 3 = 0 then 'Disk error on node ' || u || ' code 0x' || lower(hex(k))
    when k % 3 = 1 then 'login failed for user ' || u
    else 'service latency timed out after ' || ks || 'ms'
  end as text
from (select *, cast(user_id as string) as u, cast(k as string) as ks, md5(cast(event_id as string)) as h
      from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from events) a) b
"""
