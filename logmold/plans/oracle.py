"""DuckDB SQL for every registered query with an oracle (independent of Spark).

The SQL is written the plain way -- one window per cluster, one global
window for batch numbers, string_agg for the batch text -- so it also checks
the skew-safe Spark plans against the simple definition. Regexes are RE2
(DuckDB): ``\\b`` and ``\\d`` are ASCII there, which equals the Python/Java
Unicode semantics on these inputs.
"""

from __future__ import annotations

from logmold.functions import text as T
from logmold.operators import anomaly as AN
from logmold.operators import incidents as IN
from logmold.plans import catalog as C
from logmold.sources.lines import LOG_LINES_SQL

# Python white space / line breaks as RE2 classes.
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BACK = "\\"
BS = C.BATCH_SIZE
NT = C.MIN_TOKENS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def strip(x: str) -> str:
    return rr(x, f"^{WS}+|{WS}+$", "")


def sig(x: str) -> str:
    s = f"lower({x})"
    for pattern, token in T.SIGNATURE_TOKENS:
        s = rr(s, pattern, token)
    return (f"array_to_string(list_slice(list_filter(string_split_regex({s}, {q(WS + '+')}), "
            f"lambda t: t <> ''), 1, {NT}), ' ')")


def mask(x: str, order) -> str:
    for pattern in order:
        x = rr(x, pattern, T.PLACEHOLDER)
    return x


def level(x: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({x}, {q('(?i)' + chr(92) + 'b(' + w + ')' + chr(92) + 'b')}) THEN '{lab}'"
                    for lab, w in T.LEVEL_WORDS)
    return f"(CASE {arms} ELSE '{T.DEFAULT_LEVEL}' END)"


def event(x: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({x}, {q('(?i)' + chr(92) + 'b(' + w + ')' + chr(92) + 'b')}) THEN '{lab}'"
                    for lab, w in T.EVENT_WORDS)
    return f"(CASE {arms} ELSE '{T.DEFAULT_EVENT}' END)"


def normalize(x: str) -> str:
    collapsed = rr(strip(x), f"{WS}+", " ")
    masked = mask(collapsed, T.TEMPLATE_MASK_ORDER)
    s = rr(masked, rf"<{WS}*\*{WS}*>", T.PLACEHOLDER)
    s = rr(s, rf"(?:<\*>{WS}*){{2,}}", T.PLACEHOLDER + " ")
    return strip(s)


def fallback(x: str) -> str:
    return normalize(mask(x, T.TEMPLATE_MASK_ORDER))


def extract(x: str) -> str:
    first = f"string_split_regex(coalesce({x}, ''), {q(LINE_BREAK)})[1]"
    line = strip(f"replace({first}, {q(T.TEMPLATE_LABEL)}, '')")
    return f"(CASE WHEN starts_with({line}, '- ') THEN {strip(f'substr({line}, 3)')} ELSE {line} END)"


def classify(x: str) -> str:
    cond = " OR ".join(f"contains(lower({x}), {q(m)})" for m in T.ERROR_MARKERS)
    return f"(CASE WHEN {cond} THEN 'error' ELSE 'normal' END)"


def bucket(text: str, ev: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), {q(w)})" for w in words) + f" THEN '{lab}'"
        for lab, words in T.BUCKET_SUBSTRINGS
    )
    fb = f"(CASE WHEN coalesce({ev}, '') <> '' AND upper({ev}) <> 'GENERIC' THEN lower({ev}) ELSE 'generic' END)"
    return f"(CASE {arms} ELSE {fb} END)"


def tlevel(x: str) -> str:
    return f"(CASE WHEN upper({x}) IN ('INFO', 'WARN', 'ERROR') THEN upper({x}) ELSE 'INFO' END)"


def color(x: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in T.LEVEL_COLORS.items())
    return f"(CASE {x} {arms} END)"


def pct(c: str, t: str) -> str:
    return f"round_even(CAST({c} AS DOUBLE) / greatest(CAST({t} AS DOUBLE), 1.0) * 100.0, 2)"


def ts(s: str) -> str:
    return f"TIMESTAMP '{s}'"


def prompt(agg_lines: str) -> str:
    return f"({q(T.PROMPT_HEAD)} || {agg_lines} || {q(T.PROMPT_TAIL)})"


# --- common CTEs ------------------------------------------------------------------

LL = f"log_lines AS ({LOG_LINES_SQL})"
EMPTY_CACHE = ("empty_cache AS (SELECT CAST(NULL AS VARCHAR) AS cache_key, CAST(NULL AS VARCHAR) AS template_text "
               "WHERE false)")
DOC_LINES = f"""doc_lines AS (
  SELECT CAST(base + pos AS BIGINT) AS idx, doc_id, CAST(pos AS INTEGER) AS pos, text FROM (
    SELECT doc_id, base, pos, {strip('raw')} AS text FROM (
      SELECT doc_id, coalesce(sum(len(l)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
             unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos
      FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), {q(LINE_BREAK)}) AS l FROM documents) d0
    ) d1
  ) d2 WHERE text <> '')"""


def parse_ctes(p: str, src: str, cache: str = "empty_cache") -> list[str]:
    """CTEs ``{p}_lb`` (lines with batch ids), ``{p}_b`` (batches), ``{p}_kt``
    (keys), ``{p}_bt`` (batches with source/template), ``{p}_logs``."""
    return [
        f"{p}_sig AS (SELECT idx, text, {sig('text')} AS cluster_id FROM {src})",
        f"{p}_cl AS (SELECT cluster_id, min(idx) AS first_idx, count(*) AS n_lines, "
        f"(count(*) + {BS - 1}) // {BS} AS n_batches FROM {p}_sig GROUP BY cluster_id)",
        f"{p}_clb AS (SELECT *, coalesce(sum(n_batches) OVER (ORDER BY first_idx ROWS BETWEEN UNBOUNDED PRECEDING "
        f"AND 1 PRECEDING), 0) AS batch_base FROM {p}_cl)",
        f"{p}_lb AS (SELECT s.idx, s.text, s.cluster_id, CAST(c.batch_base + (row_number() OVER "
        f"(PARTITION BY s.cluster_id ORDER BY s.idx) - 1) // {BS} + 1 AS BIGINT) AS batch_id "
        f"FROM {p}_sig s JOIN {p}_clb c USING (cluster_id))",
        f"{p}_b AS (SELECT batch_id, min(cluster_id) AS cluster_id, count(*) AS number_of_logs, min(idx) AS first_idx, "
        f"arg_min(text, idx) AS first_text, string_agg('- ' || text, chr(10) ORDER BY idx) AS dashed, "
        f"sha256(min(cluster_id) || '||' || string_agg(text, chr(10) ORDER BY idx)) AS cache_key "
        f"FROM {p}_lb GROUP BY batch_id)",
        f"{p}_k AS (SELECT cache_key, min(batch_id) AS first_batch_id, count(*) AS key_batches, "
        f"arg_min(first_text, batch_id) AS first_text FROM {p}_b GROUP BY cache_key)",
        f"{p}_kt AS (SELECT k.cache_key, k.first_batch_id, k.key_batches, c.cache_key IS NOT NULL AS hit, "
        f"CASE WHEN c.cache_key IS NOT NULL THEN c.template_text ELSE {fallback('k.first_text')} END AS template "
        f"FROM {p}_k k LEFT JOIN {cache} c ON k.cache_key = c.cache_key)",
        f"{p}_bt AS (SELECT b.batch_id, b.cluster_id, b.number_of_logs, b.cache_key, b.first_idx, "
        f"CASE WHEN NOT kt.hit AND b.batch_id = kt.first_batch_id THEN 'SLM' ELSE 'CACHE' END AS source, "
        f"kt.template FROM {p}_b b JOIN {p}_kt kt ON b.cache_key = kt.cache_key)",
        f"{p}_logs AS (SELECT lb.idx, lb.text, lb.batch_id, lb.cluster_id, bt.template, bt.source, "
        f"{level('lb.text')} AS level, {event('lb.text')} AS event_type, "
        f"{mask('lb.text', T.MASK_ORDER)} AS masked FROM {p}_lb lb JOIN {p}_bt bt ON lb.batch_id = bt.batch_id)",
    ]


def stats_cte(name: str, logs: str, run_ts: str) -> str:
    return (
        f"{name} AS (SELECT template AS template_text, count(*) AS usage_count, "
        f"count(*) FILTER (WHERE upper(source) = 'CACHE') AS cache_count, "
        f"count(*) FILTER (WHERE upper(source) <> 'CACHE') AS slm_count, "
        f"{ts(run_ts)} AS first_seen, {ts(run_ts)} AS last_used, "
        f"coalesce(first(text ORDER BY batch_id, idx) FILTER (WHERE text <> ''), '') AS example_log "
        f"FROM {logs} GROUP BY template)"
    )


def two_run_ctes() -> list[str]:
    split = ts(C.HISTORY_SPLIT_TS)
    return (
        [LL, EMPTY_CACHE,
         f"h_src AS (SELECT idx, text, ts FROM log_lines WHERE ts < {split})",
         f"c_src AS (SELECT idx, text, ts FROM log_lines WHERE NOT (ts < {split}))"]
        + parse_ctes("h", "h_src")
        + [f"cache1 AS (SELECT cache_key, template AS template_text, {ts(C.HISTORY_RUN_TS)} AS created_at, "
           f"{ts(C.HISTORY_RUN_TS)} AS updated_at, CAST(key_batches - 1 AS BIGINT) AS hit_count FROM h_kt WHERE NOT hit)"]
        + parse_ctes("c", "c_src", "cache1")
        + [stats_cte("h_stats", "h_logs", C.HISTORY_RUN_TS), stats_cte("c_stats", "c_logs", C.RUN_TS),
           "merged AS (SELECT template_text, CAST(sum(usage_count) AS BIGINT) AS usage_count, "
           "CAST(sum(cache_count) AS BIGINT) AS cache_count, CAST(sum(slm_count) AS BIGINT) AS slm_count, "
           "min(first_seen) AS first_seen, max(last_used) AS last_used, "
           "coalesce(first(example_log ORDER BY run) FILTER (WHERE example_log <> ''), '') AS example_log "
           "FROM (SELECT *, 0 AS run FROM h_stats UNION ALL SELECT *, 1 AS run FROM c_stats) u GROUP BY template_text)"]
    )


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def tree_ctes() -> list[str]:
    return [LL, EMPTY_CACHE] + parse_ctes("r", "log_lines") + [
        stats_cte("r_stats", "r_logs", C.RUN_TS),
        "latest AS (SELECT coalesce(max(batch_id), 0) AS m FROM r_logs)",
        f"tl AS (SELECT {tlevel('level')} AS level, {bucket('text', 'event_type')} AS event_type, "
        f"template AS template_text, CASE WHEN upper(source) = 'CACHE' THEN 'CACHE' ELSE 'SLM' END AS source, "
        f"batch_id, idx, text, cluster_id, masked, batch_id = (SELECT m FROM latest) AS in_current_batch FROM r_logs)",
    ]


LEAF = "level, event_type, template_text"


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    single = [LL, EMPTY_CACHE] + parse_ctes("r", "log_lines")

    o["source_text_lines"] = with_([DOC_LINES], "SELECT idx, doc_id, pos, text FROM doc_lines")
    o["log_signature"] = with_([LL], f"SELECT idx, {sig('text')} AS cluster_id FROM log_lines")
    o["doc_signature"] = with_([DOC_LINES], f"SELECT idx, {sig('text')} AS cluster_id FROM doc_lines")
    o["log_level"] = with_([LL], f"SELECT idx, {level('text')} AS level FROM log_lines")
    o["event_type"] = with_([LL], f"SELECT idx, {event('text')} AS event_type FROM log_lines")
    o["masked"] = with_([LL], f"SELECT idx, {mask('text', T.MASK_ORDER)} AS masked FROM log_lines")
    o["doc_analysis"] = with_([DOC_LINES], f"SELECT idx, {level('text')} AS level, {event('text')} AS event_type, "
                                           f"{mask('text', T.MASK_ORDER)} AS masked FROM doc_lines")
    o["template_normalize"] = with_([LL], f"SELECT idx, {fallback('text')} AS template FROM log_lines")
    o["doc_template_normalize"] = with_([DOC_LINES], f"SELECT idx, {fallback('text')} AS template FROM doc_lines")
    o["prompt_text"] = with_(single, f"SELECT batch_id, {prompt('dashed')} AS prompt FROM r_b")
    o["extract_template"] = f"SELECT conv_id, turn, {extract('text')} AS template FROM conversations"
    o["classify_template"] = with_(single, f"SELECT template AS template_text, {classify('template')} AS label "
                                           f"FROM r_logs GROUP BY template")
    o["tree_bucket"] = with_([LL], f"SELECT idx, {tlevel(level('text'))} AS level, {color(tlevel(level('text')))} AS color, "
                                   f"{bucket('text', event('text'))} AS bucket FROM log_lines")
    o["clusters"] = with_(single, "SELECT cluster_id, first_idx, n_lines, n_batches, "
                                  "CAST(batch_base + 1 AS BIGINT) AS first_batch_id FROM r_clb")
    o["batches"] = with_(single, "SELECT batch_id, cluster_id, number_of_logs, first_idx, cache_key FROM r_b")
    o["batch_source"] = with_(single, "SELECT batch_id, cache_key, source, template FROM r_bt")
    o["parsed_logs"] = with_(single, "SELECT idx, text, batch_id, cluster_id, template, source, level, event_type, "
                                     "masked FROM r_logs")
    o["doc_parsed_logs"] = with_([DOC_LINES, EMPTY_CACHE] + parse_ctes("d", "doc_lines"),
                                 "SELECT idx, batch_id, cluster_id, template, source FROM d_logs")
    o["run_totals"] = with_(single, "SELECT count(*) AS total_logs, CAST(coalesce(max(batch_id), 0) AS BIGINT) AS "
                                    "batch_count, count(DISTINCT template) AS template_count FROM r_logs")
    o["template_distribution"] = with_(single, "SELECT template, count(*) AS n FROM r_logs GROUP BY template")
    o["batch_distribution"] = with_(single, "SELECT batch_id, cluster_id, number_of_logs, source, template, "
                                            "number_of_logs AS n FROM r_bt")
    stats_view = (f"SELECT template_text, usage_count, cache_count, slm_count, first_seen, last_used, example_log, "
                  f"{pct('cache_count', 'usage_count')} AS cache_pct, {pct('slm_count', 'usage_count')} AS slm_pct FROM ")
    o["template_stats"] = with_(single + [stats_cte("r_stats", "r_logs", C.RUN_TS)], stats_view + "r_stats")
    o["template_stats_merged"] = with_(two_run_ctes(), stats_view + "merged")
    o["top_templates"] = with_(two_run_ctes(), "SELECT template_text, usage_count, cache_count, slm_count, first_seen, "
                                               f"last_used FROM merged ORDER BY usage_count DESC, first_seen, "
                                               f"template_text LIMIT {C.TOP_N}")
    warm = (
        [LL, EMPTY_CACHE, f"h_src AS (SELECT idx, text FROM log_lines WHERE ts < {ts(C.HISTORY_SPLIT_TS)})"]
        + parse_ctes("h", "h_src")
        + [f"cache1 AS (SELECT cache_key, template AS template_text FROM h_kt WHERE NOT hit)"]
        + parse_ctes("w", "log_lines", "cache1")
    )
    o["cache_warm_run"] = with_(warm, "SELECT batch_id, cluster_id, number_of_logs, cache_key, source, template FROM w_bt")
    cutoff = f"{ts(C.RETENTION_TS)} - INTERVAL {C.RETENTION_DAYS} DAY"
    o["cache_retention"] = with_(two_run_ctes() + [
        f"rows AS (SELECT cache_key, template_text, created_at, updated_at, hit_count FROM cache1 "
        f"UNION ALL SELECT cache_key, template, {ts(C.RUN_TS)}, {ts(C.RUN_TS)}, CAST(key_batches - 1 AS BIGINT) "
        f"FROM c_kt WHERE NOT hit "
        f"UNION ALL SELECT cache_key, NULL, NULL, NULL, CAST(key_batches AS BIGINT) FROM c_kt WHERE hit)",
        "merged_cache AS (SELECT cache_key, arg_max(template_text, updated_at) AS template_text, "
        "min(created_at) AS created_at, max(updated_at) AS updated_at, CAST(sum(hit_count) AS BIGINT) AS hit_count "
        "FROM rows GROUP BY cache_key)",
    ], f"SELECT * FROM merged_cache WHERE updated_at >= {cutoff}")

    limit = C.INSTANCE_LIMIT
    o["tree_leaves"] = with_(tree_ctes() + [
        f"leaves AS (SELECT {LEAF}, count(*) AS \"count\", count(*) FILTER (WHERE source = 'CACHE') AS cache, "
        f"count(*) FILTER (WHERE source <> 'CACHE') AS slm, count(*) FILTER (WHERE in_current_batch) AS cur "
        f"FROM tl GROUP BY {LEAF})",
    ], f"SELECT l.level, l.event_type, l.template_text, l.\"count\", l.cache, l.slm, "
       f"{pct('l.cache', 'l.\"count\"')} AS cache_pct, {pct('l.slm', 'l.\"count\"')} AS slm_pct, "
       f"l.cur AS current_batch_count, l.cur > 0 AS highlight_current_batch, l.\"count\" AS instances_total, "
       f"l.\"count\" > {limit} AS instances_truncated, greatest(l.\"count\" - {limit}, 0) AS omitted_instances, "
       f"CAST((SELECT m FROM latest) AS BIGINT) AS latest_batch_id, "
       f"CAST(coalesce(s.usage_count, 0) AS BIGINT) AS global_count, s.first_seen, s.last_used AS last_seen "
       f"FROM leaves l LEFT JOIN r_stats s ON l.template_text = s.template_text")
    o["tree_instances"] = with_(tree_ctes(), (
        f"SELECT {LEAF}, rank, text AS original_log, source, batch_id, cluster_id, masked, in_current_batch FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY {LEAF} ORDER BY batch_id, idx) AS rank FROM tl) x "
        f"WHERE rank <= {limit}"))
    o["tree_examples"] = with_(tree_ctes() + [
        f"firsts AS (SELECT {LEAF}, text, min(batch_id * 1099511627776 + idx) AS pos FROM tl WHERE text <> '' "
        f"GROUP BY {LEAF}, text)"],
        f"SELECT {LEAF}, rank, text AS example_log FROM (SELECT *, row_number() OVER (PARTITION BY {LEAF} "
        f"ORDER BY pos) AS rank FROM firsts) x WHERE rank <= 3")
    o["tree_debug"] = with_(tree_ctes(), f"SELECT DISTINCT {LEAF}, 'cluster_id' AS kind, cluster_id AS value FROM tl")
    o["recent_examples"] = with_(two_run_ctes() + [
        "ex AS (SELECT template AS template_text, text AS original_log, level AS log_level, event_type, source, "
        f"batch_id, {ts(C.HISTORY_RUN_TS)} AS created_at, CAST(0 AS BIGINT) AS run, idx FROM h_logs UNION ALL "
        "SELECT template, text, level, event_type, source, batch_id, "
        f"{ts(C.RUN_TS)}, CAST(1 AS BIGINT), idx FROM c_logs)"],
        f"SELECT x.template_text, x.rank, x.original_log, x.log_level, x.event_type, x.source, x.batch_id, x.created_at, "
        f"m.template_text IS NOT NULL AS has_stats FROM (SELECT *, row_number() OVER (PARTITION BY template_text "
        f"ORDER BY created_at DESC, run DESC, idx DESC) AS rank FROM ex) x LEFT JOIN merged m ON x.template_text = m.template_text "
        f"WHERE x.rank <= {C.RECENT_N}")
    merged_cache = [
        f"rows AS (SELECT cache_key, template_text, created_at, updated_at, hit_count FROM cache1 "
        f"UNION ALL SELECT cache_key, template, {ts(C.RUN_TS)}, {ts(C.RUN_TS)}, CAST(key_batches - 1 AS BIGINT) "
        f"FROM c_kt WHERE NOT hit "
        f"UNION ALL SELECT cache_key, NULL, NULL, NULL, CAST(key_batches AS BIGINT) FROM c_kt WHERE hit)",
        "merged_cache AS (SELECT cache_key, arg_max(template_text, updated_at) AS template_text, "
        "min(created_at) AS created_at, max(updated_at) AS updated_at, CAST(sum(hit_count) AS BIGINT) AS hit_count "
        "FROM rows GROUP BY cache_key)",
    ]
    o["cache_merged"] = with_(two_run_ctes() + merged_cache, "SELECT * FROM merged_cache")
    o["cache_hottest"] = with_(two_run_ctes() + merged_cache, (
        f"SELECT * FROM merged_cache ORDER BY hit_count DESC NULLS LAST, cache_key LIMIT {C.TOP_N}"))
    o["stats_persisted"] = with_(two_run_ctes(), "SELECT * FROM merged")
    run_ts_text = C.RUN_TS.replace(" ", "T")
    o["event_log"] = with_(single, (
        f"SELECT 'INFO' AS level, 'logmold' AS logger, 'batch_processed' AS message, '{run_ts_text}' AS ts, b.batch_id, b.cluster_id, "
        "CAST(b.number_of_logs AS BIGINT) AS number_of_logs, b.cache_key, b.source, '' AS slm_raw_output, CAST(NULL AS BIGINT) AS total_logs, "
        "CAST(NULL AS BIGINT) AS batch_count, CAST(NULL AS BIGINT) AS template_count, to_json(l.logs) AS logs_json FROM r_bt b "
        "JOIN (SELECT batch_id, list(struct_pack(text := text, template := template, source := source, level := level, "
        "event_type := event_type, masked := masked) ORDER BY idx) AS logs FROM r_logs GROUP BY batch_id) l ON b.batch_id = l.batch_id "
        f"UNION ALL SELECT 'INFO', 'logmold', 'run_completed', '{run_ts_text}', NULL, NULL, NULL, NULL, NULL, NULL, count(*), "
        "CAST(coalesce(max(batch_id), 0) AS BIGINT), count(DISTINCT template), NULL FROM r_logs"))
    examples = [
        "ex AS (SELECT template AS template_text, text AS original_log, level AS log_level, event_type, source, "
        f"batch_id, {ts(C.HISTORY_RUN_TS)} AS created_at, CAST(0 AS BIGINT) AS run, idx FROM h_logs UNION ALL "
        "SELECT template, text, level, event_type, source, batch_id, "
        f"{ts(C.RUN_TS)}, CAST(1 AS BIGINT), idx FROM c_logs)"]
    o["example_orphans"] = with_(two_run_ctes() + examples, (
        "SELECT * FROM ex WHERE template_text NOT IN (SELECT template_text FROM h_stats)"))
    o["source_table"] = with_(two_run_ctes(), f"SELECT template_text, usage_count, "
                                              f"{pct('cache_count', 'usage_count')} AS cache_pct, "
                                              f"{pct('slm_count', 'usage_count')} AS slm_pct FROM merged")
    o["structure_table"] = with_(single, "SELECT batch_id, idx, text, masked, level, event_type, source FROM r_logs")
    conv_lines = f"""conv_lines AS (
  SELECT CAST(base + pos AS BIGINT) AS idx, text FROM (
    SELECT base, pos, {strip('raw')} AS text FROM (
      SELECT coalesce(sum(len(l)) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
             unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos
      FROM (SELECT conv_id, turn, string_split_regex(coalesce(text, ''), {q(LINE_BREAK)}) AS l FROM conversations) c0
    ) c1
  ) c2 WHERE text <> '')"""
    o["conversation_parsed_logs"] = with_([conv_lines, EMPTY_CACHE] + parse_ctes("v", "conv_lines"),
                                          "SELECT idx, batch_id, cluster_id, template, source, level, event_type "
                                          "FROM v_logs")
    o["tree_snapshot_latest"] = with_(two_run_ctes() + [
        f"ctl AS (SELECT {tlevel('level')} AS level, {bucket('text', 'event_type')} AS event_type, "
        f"template AS template_text, CASE WHEN upper(source) = 'CACHE' THEN 'CACHE' ELSE 'SLM' END AS source, "
        f"batch_id FROM c_logs)"],
        "SELECT CAST(2 AS BIGINT) AS snapshot_id, CAST((SELECT max(batch_id) FROM c_logs) AS BIGINT) AS batch_id, "
        "CAST((SELECT count(*) FROM c_logs) AS BIGINT) AS total_logs, level, event_type, template_text, "
        "count(*) AS \"count\", count(*) FILTER (WHERE source = 'CACHE') AS cache, "
        "count(*) FILTER (WHERE source <> 'CACHE') AS slm, count(*) AS instances_total "
        f"FROM ctl GROUP BY {LEAF}")
    o["run_trace_json"] = with_(single, (
        "SELECT b.batch_id, to_json(struct_pack(batch_id := b.batch_id, cluster_id := b.cluster_id, "
        "number_of_logs := b.number_of_logs, cache_key := b.cache_key, source := b.source, slm_raw_output := '', "
        "logs := l.logs)) AS batch_json FROM r_bt b JOIN (SELECT batch_id, list(struct_pack(text := text, "
        "template := template, source := source, level := level, event_type := event_type, masked := masked) "
        "ORDER BY idx) AS logs FROM r_logs GROUP BY batch_id) l ON b.batch_id = l.batch_id"))
    fmt = "'%Y-%m-%dT%H:%M:%S.%f+00:00'"
    o["tree_json"] = with_(tree_ctes() + [
        f"leaves AS (SELECT {LEAF}, count(*) AS \"count\", count(*) FILTER (WHERE source = 'CACHE') AS cache, "
        f"count(*) FILTER (WHERE source <> 'CACHE') AS slm, count(*) FILTER (WHERE in_current_batch) AS cur, "
        f"min(batch_id * 1099511627776 + idx) AS first_pos FROM tl GROUP BY {LEAF})",
        f"inst AS (SELECT {LEAF}, list(struct_pack(original_log := text, source := source, batch_id := batch_id, "
        f"cluster_id := cluster_id, masked := masked, in_current_batch := in_current_batch) ORDER BY rank) AS instances "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY {LEAF} ORDER BY batch_id, idx) AS rank FROM tl) x "
        f"WHERE rank <= {limit} GROUP BY {LEAF})",
        f"firsts AS (SELECT {LEAF}, text, min(batch_id * 1099511627776 + idx) AS pos FROM tl WHERE text <> '' "
        f"GROUP BY {LEAF}, text)",
        f"ex AS (SELECT {LEAF}, list(text ORDER BY rank) AS example_logs FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {LEAF} ORDER BY pos) AS rank FROM firsts) x WHERE rank <= 3 GROUP BY {LEAF})",
        f"dbg AS (SELECT {LEAF}, list(DISTINCT cluster_id ORDER BY cluster_id) AS cluster_ids FROM tl GROUP BY {LEAF})",
    ], (
        f"SELECT l.level, {color('l.level')} AS color, l.event_type, CAST(row_number() OVER (PARTITION BY l.level, "
        f"l.event_type ORDER BY l.\"count\" DESC, l.first_pos) AS BIGINT) AS template_rank, l.template_text, "
        f"to_json(struct_pack(template_text := l.template_text, count := l.\"count\", "
        f"global_count := CAST(coalesce(s.usage_count, 0) AS BIGINT), "
        f"first_seen := strftime(s.first_seen, {fmt}), last_seen := strftime(s.last_used, {fmt}), "
        f"source := struct_pack(cache := l.cache, slm := l.slm, cache_pct := {pct('l.cache', 'l.\"count\"')}, "
        f"slm_pct := {pct('l.slm', 'l.\"count\"')}), current_batch_count := l.cur, "
        f"highlight_current_batch := l.cur > 0, instances := coalesce(i.instances, []), "
        f"instances_total := l.\"count\", instances_truncated := l.\"count\" > {limit}, "
        f"omitted_instances := greatest(l.\"count\" - {limit}, 0), example_logs := coalesce(e.example_logs, []), "
        f"debug := struct_pack(cluster_ids := d.cluster_ids, cache_hit := l.cache, cache_miss := l.slm, "
        f"raw_slm_outputs := CAST([] AS VARCHAR[])))) AS leaf_json "
        f"FROM leaves l LEFT JOIN r_stats s ON l.template_text = s.template_text "
        f"LEFT JOIN inst i ON l.level = i.level AND l.event_type = i.event_type AND l.template_text = i.template_text "
        f"LEFT JOIN ex e ON l.level = e.level AND l.event_type = e.event_type AND l.template_text = e.template_text "
        f"LEFT JOIN dbg d ON l.level = d.level AND l.event_type = d.event_type AND l.template_text = d.template_text"))
    o["pluggable_parser"] = o["batch_source"]
    o["common_words_parser"] = with_(single + [
        "words AS (SELECT batch_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT batch_id, "
        f"list_filter(string_split_regex(text, {q(WS + '+')}), lambda t: t <> '') AS w FROM r_lb) x)",
        f"common AS (SELECT batch_id, string_agg(word, ' ' ORDER BY place) AS template FROM (SELECT batch_id, place, count(*) AS n, "
        f"CASE WHEN count(DISTINCT word) = 1 THEN min(word) ELSE {q(T.PLACEHOLDER)} END AS word FROM words GROUP BY batch_id, place) p "
        "JOIN (SELECT batch_id, number_of_logs FROM r_b) b USING (batch_id) WHERE n = number_of_logs GROUP BY batch_id)"],
        "SELECT b.batch_id, b.cache_key, b.source, coalesce(c.template, '') AS template FROM r_bt b LEFT JOIN common c USING (batch_id)")
    o["stream_parse"] = with_(single, "SELECT idx, batch_id, cluster_id, template, source, level, event_type FROM r_logs")
    o["stream_level_counts"] = with_([LL], (
        f"SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + "
        f"INTERVAL '1 hour' AS window_end, {level('text')} AS level, {event('text')} AS event_type, count(*) AS n "
        f"FROM log_lines GROUP BY ALL"))
    # several runs over stored state
    o["cache_store_run"] = with_(two_run_ctes() + merged_cache, (
        "SELECT b.batch_id, b.cache_key, b.source, m.template_text, m.hit_count FROM c_bt b "
        "JOIN merged_cache m ON b.cache_key = m.cache_key"))
    o["examples_store"] = with_(two_run_ctes() + examples, (
        "SELECT template_text, rank, original_log, log_level, event_type, source, batch_id, created_at FROM (SELECT *, "
        "row_number() OVER (PARTITION BY template_text ORDER BY created_at DESC, run DESC, idx DESC) AS rank FROM ex) x "
        f"WHERE rank <= {C.RECENT_N}"))
    o["state_counts"] = with_(two_run_ctes() + merged_cache, (
        f"SELECT (SELECT count(*) FROM merged) AS templates, count(*) FILTER (WHERE updated_at < {cutoff}) AS removed, "
        f"count(*) FILTER (WHERE updated_at >= {cutoff}) AS kept, "
        "(SELECT template_text FROM merged_cache ORDER BY hit_count DESC NULLS LAST, cache_key LIMIT 1) AS hottest "
        "FROM merged_cache"))
    o["tree_leaves_plain"] = with_(tree_ctes() + [
        f"leaves AS (SELECT {LEAF}, count(*) AS \"count\", count(*) FILTER (WHERE source = 'CACHE') AS cache, "
        f"count(*) FILTER (WHERE source <> 'CACHE') AS slm FROM tl GROUP BY {LEAF})",
    ], f"SELECT l.level, l.event_type, l.template_text, l.\"count\", l.cache, l.slm, "
       f"{pct('l.cache', 'l.\"count\"')} AS cache_pct, {pct('l.slm', 'l.\"count\"')} AS slm_pct, "
       f"CAST(0 AS BIGINT) AS current_batch_count, false AS highlight_current_batch, l.\"count\" AS instances_total, "
       f"true AS instances_truncated, l.\"count\" AS omitted_instances, "
       f"CAST((SELECT m FROM latest) AS BIGINT) AS latest_batch_id, "
       f"CAST(coalesce(s.usage_count, 0) AS BIGINT) AS global_count, s.first_seen, s.last_used AS last_seen "
       f"FROM leaves l LEFT JOIN r_stats s ON l.template_text = s.template_text")
    raw = (f"CASE WHEN source <> 'SLM' OR first_text LIKE '%Disk error%' THEN '' ELSE "
           f"'Template: ' || {mask('first_text', T.TEMPLATE_MASK_ORDER)} || chr(10) || 'extra words' END")
    model = [f"model AS (SELECT bt.*, {raw} AS slm_raw_output, source = 'SLM' AND first_text LIKE '%Disk error%' AS used_fallback "
             "FROM r_bt bt JOIN (SELECT batch_id AS fb, first_text FROM r_b) f ON f.fb = bt.batch_id)"]
    o["model_fallback"] = with_([LL, EMPTY_CACHE] + parse_ctes("r", "log_lines") + model,
                                "SELECT batch_id, source, template, slm_raw_output, used_fallback FROM model")
    o["tree_debug_model"] = with_(tree_ctes() + model + [
        f"raws AS (SELECT DISTINCT {LEAF}, slm_raw_output AS value FROM tl JOIN (SELECT batch_id AS mb, slm_raw_output "
        "FROM model WHERE slm_raw_output <> '') m ON m.mb = tl.batch_id)"], (
        f"SELECT DISTINCT {LEAF}, 'cluster_id' AS kind, cluster_id AS value FROM tl UNION ALL "
        f"SELECT {LEAF}, 'raw_slm_output', value FROM (SELECT *, row_number() OVER (PARTITION BY {LEAF} ORDER BY value) AS r "
        "FROM raws) x WHERE r <= 3"))
    request_lines = """request_lines AS (
  SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS idx, coalesce(text, '') AS text FROM conversations)"""
    o["request_parsed_logs"] = with_([request_lines, EMPTY_CACHE] + parse_ctes("q", "request_lines"),
                                     "SELECT idx, batch_id, cluster_id, template, source FROM q_logs")
    a, b = (ts(e) for e in C.STREAM_PARTS)
    stream = [LL, EMPTY_CACHE]
    cache = "empty_cache"
    for k, where in enumerate((f"ts < {a}", f"ts >= {a} AND ts < {b}", f"ts >= {b}")):
        stream += [f"s{k} AS (SELECT idx, text FROM log_lines WHERE {where})"] + parse_ctes(f"e{k}", f"s{k}", cache)
        stream += [f"after{k} AS (SELECT cache_key, template_text FROM {cache} UNION ALL "
                   f"SELECT cache_key, template FROM e{k}_kt WHERE NOT hit)"]
        cache = f"after{k}"
    o["stream_parse_triggers"] = with_(stream, " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS epoch, idx, batch_id, cluster_id, template, source FROM e{k}_logs" for k in range(3)))
    o["stream_late_rows"] = o["stream_level_counts"]

    hours, minutes = C.WINDOW_WAIT.split()[0], 60_000_000
    o["stream_windows"] = "WITH RECURSIVE " + ",\n".join([
        LL, f"sg AS (SELECT idx, ts, text, {sig('text')} AS cluster_id FROM log_lines)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY idx) AS rn, count(*) OVER (PARTITION BY cluster_id) AS n FROM sg)",
        f"step AS (SELECT a.cluster_id, a.rn, any_value(a.n) AS n, count(*) FILTER (WHERE b.ts <= a.ts + INTERVAL {hours} HOUR) AS len "
        f"FROM l a JOIN l b ON a.cluster_id = b.cluster_id AND b.rn BETWEEN a.rn AND a.rn + {BS - 1} GROUP BY a.cluster_id, a.rn)",
        "b AS (SELECT cluster_id, CAST(1 AS BIGINT) AS batch_no, rn AS start, len, n FROM step WHERE rn = 1 UNION ALL "
        "SELECT s.cluster_id, b.batch_no + 1, s.rn, s.len, s.n FROM b JOIN step s ON s.cluster_id = b.cluster_id AND s.rn = b.start + b.len)",
    ]) + (f"\nSELECT cluster_id, batch_no, CASE WHEN any_value(b.len) = {BS} THEN 'size' ELSE 'time' END AS closed_by, count(*) AS number_of_logs, "
          f"min(idx) AS first_idx, max(idx) AS last_idx, sha256(cluster_id || '||' || string_agg(text, chr(10) ORDER BY idx)) AS cache_key, "
          f"{fallback('arg_min(text, idx)')} AS template FROM b JOIN l USING (cluster_id) WHERE rn >= start AND rn < start + b.len "
          "GROUP BY cluster_id, batch_no")

    slots = 9  # the most groups that the function knows
    escaped = rr("template", r"([\\\[\](){}.*+?^$|])", r"\\\1")
    pattern = f"'(?s)^' || {rr(escaped, ' *<' + BACK + BACK + BACK + '*> *', ' *(.*?) *')} || repeat('()', {slots}) || '$'"
    line = rr(strip("text"), f"{WS}+", " ")
    each = " UNION ALL ".join(
        f"SELECT idx, batch_id, template, fits, CAST({i} AS INTEGER) AS slot, regexp_extract(line, pattern, {i}) AS value FROM fitted WHERE fits AND n >= {i}"
        for i in range(1, slots + 1))
    o["line_parameters"] = with_(single + [
        f"fitted AS (SELECT *, regexp_matches(line, pattern) AS fits FROM (SELECT idx, batch_id, template, {line} AS line, {pattern} AS pattern, "
        "CAST((length(template) - length(replace(template, '<*>', ''))) / 3 AS INTEGER) AS n FROM r_logs) x)"],
        f"{each} UNION ALL SELECT idx, batch_id, template, fits, NULL, NULL FROM fitted WHERE NOT fits OR n = 0")

    timed = single + ["users AS (SELECT event_id AS idx, user_id FROM events)",
                      "timed AS (SELECT r.*, g.ts, u.user_id FROM r_logs r JOIN log_lines g USING (idx) JOIN users u USING (idx))"]
    spine = timed + [
        f"counts AS (SELECT template, epoch_us(ts) // {60 * minutes} AS hour, count(*) AS n FROM timed GROUP BY ALL)",
        f"spans AS (SELECT template, min(hour) AS first, least(max(hour) + {AN.HISTORY_HOURS}, (SELECT max(hour) FROM counts)) AS last FROM counts GROUP BY template)",
        "spine AS (SELECT template, first, unnest(range(first, last + 1)) AS hour FROM spans)",
        "filled AS (SELECT s.template, s.first, s.hour, coalesce(c.n, 0) AS n FROM spine s LEFT JOIN counts c USING (template, hour))"]
    o["count_anomalies"] = with_(spine + [
        "framed AS (SELECT *, count(n) OVER w AS k, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS s, CAST(coalesce(sum(n * n) OVER w, 0) AS BIGINT) AS q FROM filled "
        f"WINDOW w AS (PARTITION BY template ORDER BY hour RANGE BETWEEN {AN.HISTORY_HOURS} PRECEDING AND 1 PRECEDING))",
        "means AS (SELECT *, CASE WHEN k > 0 THEN CAST(s AS DOUBLE) / k END AS mean FROM framed)",
        f"scored AS (SELECT *, CASE WHEN k > 0 THEN (n - mean) / greatest(sqrt(CAST(k * q - s * s AS DOUBLE)) / k, {AN.FLOOR}) END AS z FROM means)"],
        f"SELECT template, hour, n, k AS history_hours, mean, z, coalesce(k >= {AN.LEAST_HOURS} AND z >= {AN.Z_LIMIT}, false) AS anomaly FROM scored")
    o["early_warnings"] = with_(spine + [
        "xs AS (SELECT *, hour - first AS x FROM filled)",
        "framed AS (SELECT *, count(*) OVER w AS k, CAST(sum(x) OVER w AS BIGINT) AS sx, CAST(sum(n) OVER w AS BIGINT) AS sy, "
        "CAST(sum(x * x) OVER w AS BIGINT) AS sxx, CAST(sum(x * n) OVER w AS BIGINT) AS sxy FROM xs "
        f"WINDOW w AS (PARTITION BY template ORDER BY hour RANGE BETWEEN {AN.SLOPE_HOURS - 1} PRECEDING AND CURRENT ROW))",
        "sloped AS (SELECT *, CASE WHEN k * sxx - sx * sx > 0 THEN CAST(k * sxy - sx * sy AS DOUBLE) / (k * sxx - sx * sx) END AS slope FROM framed)"],
        f"SELECT template, hour, n, slope, coalesce(k = {AN.SLOPE_HOURS} AND slope >= {AN.SLOPE_LIMIT}, false) AS alert FROM sloped")
    o["sequence_anomalies"] = with_(timed + [
        "steps AS (SELECT idx, user_id, template, lag(template) OVER (PARTITION BY user_id ORDER BY ts, idx) AS previous FROM timed WHERE user_id IS NOT NULL)",
        "model AS (SELECT previous, template, count(*) AS seen FROM steps WHERE previous IS NOT NULL GROUP BY ALL)",
        "totals AS (SELECT previous, CAST(sum(seen) AS BIGINT) AS total FROM model GROUP BY ALL)",
        "scored AS (SELECT s.*, m.seen, CAST(m.seen + 1 AS DOUBLE) / (t.total + (SELECT count(DISTINCT template) FROM steps)) AS probability "
        "FROM steps s LEFT JOIN model m USING (previous, template) LEFT JOIN totals t USING (previous))"],
        f"SELECT idx, user_id, previous, template, seen, probability, coalesce(probability < {AN.RARE}, false) AS rare FROM scored")
    found = timed + [
        "errors AS (SELECT event_type, epoch_us(ts) AS us FROM timed WHERE level = 'ERROR')",
        f"opened AS (SELECT *, CASE WHEN us - lag(us) OVER w > {IN.GAP_SECONDS * 1_000_000} THEN 1 ELSE 0 END AS opens FROM errors WINDOW w AS (PARTITION BY event_type ORDER BY us))",
        "numbered AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY us) AS number FROM opened)",
        "found AS (SELECT event_type, min(us) AS started, max(us) AS ended, count(*) AS n_errors FROM numbered GROUP BY event_type, number)"]
    o["incidents"] = with_(found, "SELECT event_type, started, ended, n_errors FROM found")
    around = found + [
        "around AS (SELECT f.event_type, f.started, t.template, count(*) AS n FROM found f JOIN timed t "
        f"ON epoch_us(t.ts) BETWEEN f.started - {IN.LEAD_SECONDS * 1_000_000} AND f.ended GROUP BY ALL)"]
    o["incident_templates"] = with_(around, "SELECT * FROM around")

    def similar(name: str) -> str:
        return (f"SELECT {name}, rank, similar_to, shared, similarity FROM (SELECT *, row_number() OVER (PARTITION BY {name} ORDER BY similarity DESC, similar_to) AS rank "
                f"FROM (SELECT a.id AS {name}, b.id AS similar_to, count(*) AS shared, CAST(count(*) AS DOUBLE) / (any_value(x.n) + any_value(y.n) - count(*)) AS similarity "
                "FROM members a JOIN members b ON a.token = b.token AND a.id <> b.id JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id GROUP BY a.id, b.id) p "
                f"WHERE 100 * similarity >= {IN.LEAST}) r WHERE rank <= {IN.TOP}")

    sizes = "sizes AS (SELECT id, count(*) AS n FROM members GROUP BY id)"
    o["similar_incidents"] = with_(around + [
        "members AS (SELECT DISTINCT event_type || '@' || started AS id, template AS token FROM around)", sizes], similar("incident"))
    words = "regexp_extract_all(lower(template), '(<\\*>|[0-9a-z]+)')"
    # all pairs of documents' templates are too many here; two sets with this similarity share one of their rarest tokens
    o["similar_templates"] = with_([DOC_LINES, EMPTY_CACHE] + parse_ctes("d", "doc_lines") + [
        f"tokens AS MATERIALIZED (SELECT DISTINCT template AS id, unnest({words}) AS token FROM d_bt)", "sizes AS (SELECT id, count(*) AS n FROM tokens GROUP BY id)",
        "rare AS (SELECT id, token, n, row_number() OVER (PARTITION BY id ORDER BY df, token) AS r FROM tokens "
        "JOIN (SELECT token, count(*) AS df FROM tokens GROUP BY token) USING (token) JOIN sizes USING (id))",
        f"firsts AS (SELECT id, token FROM rare WHERE r <= n - (n * {IN.LEAST} + 99) // 100 + 1)",
        "met AS (SELECT DISTINCT a.id AS i, b.id AS j FROM firsts a JOIN firsts b ON a.token = b.token AND a.id <> b.id)",
        "joint AS (SELECT i, j, count(*) AS shared FROM met JOIN tokens a ON a.id = i JOIN tokens b ON b.id = j AND b.token = a.token GROUP BY i, j)",
        "scored AS (SELECT i, j, shared, CAST(shared AS DOUBLE) / (x.n + y.n - shared) AS similarity FROM joint JOIN sizes x ON x.id = i JOIN sizes y ON y.id = j)"],
        "SELECT i AS template, row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j) AS rank, j AS similar_to, shared, similarity FROM scored "
        f"WHERE 100 * similarity >= {IN.LEAST} QUALIFY rank <= {IN.TOP}")
    o["template_vectors"] = with_([DOC_LINES, EMPTY_CACHE] + parse_ctes("d", "doc_lines") + [
        "named AS (SELECT DISTINCT template FROM d_bt)",
        f"tokens AS (SELECT template, token, count(*) AS tf FROM (SELECT template, unnest({words}) AS token FROM named) GROUP BY ALL)",
        "total AS (SELECT count(DISTINCT template) AS m FROM tokens)",
        "dfs AS (SELECT token, count(*) AS df FROM tokens GROUP BY token)"],
        "SELECT template, token, tf, df, round(tf * (1 + ln(CAST(1 + m AS DOUBLE) / (1 + df))), 6) AS weight FROM tokens JOIN dfs USING (token), total")
    # distinct counts over runs: exact here, and in sketches of so few values
    def measured(scope: str, name: str, value: str, group: str) -> str:
        def side(p: str, where: str) -> str:
            return f"count(DISTINCT v) FILTER (WHERE {where}) AS {p}"
        return (f"SELECT {q(scope)} AS scope, name, count(DISTINCT v) AS n_total, {side('n_before', 'h')}, {side('n_latest', 'c')}, "
                f"{side('n_both', 'h AND c')}, {side('n_new', 'c AND NOT h')} FROM (SELECT {name} AS name, {value} AS v, bool_or(run = 0) AS h, "
                f"bool_or(run = 1) AS c FROM both_logs GROUP BY {group}) x GROUP BY name")

    both = ("both_logs AS (SELECT template, cluster_id, text, 0 AS run FROM h_logs UNION ALL "
            "SELECT template, cluster_id, text, 1 FROM c_logs)")
    o["distinct_over_runs"] = with_(two_run_ctes() + [both], " UNION ALL ".join(
        [measured("run", q(name), value, value) for name, value in (("templates", "template"), ("clusters", "cluster_id"), ("lines", "text"))]
        + [measured("template", "template", "text", "template, text")]))

    # snapshots of two shapes: the second run's leaves have debug values
    runs = [f"{p}tl AS (SELECT {tlevel('level')} AS level, {bucket('text', 'event_type')} AS event_type, template AS template_text, "
            f"source, batch_id, idx, text, cluster_id FROM {p}_logs)" for p in "hc"]
    o["snapshot_documents"] = with_(two_run_ctes() + runs, " UNION ALL ".join(
        f"SELECT CAST({sid} AS BIGINT) AS snapshot_id, CAST((SELECT max(batch_id) FROM {p}_logs) AS BIGINT) AS batch_id, "
        f"CAST((SELECT count(*) FROM {p}_logs) AS BIGINT) AS total_logs, {LEAF}, count(*) AS \"count\", "
        f"count(*) FILTER (WHERE source = 'CACHE') AS cache, {pct('count(*) FILTER (WHERE source = ' + q('CACHE') + ')', 'count(*)')} AS cache_pct, "
        f"{hit} AS cache_hit, {clusters} AS clusters, first(text ORDER BY batch_id, idx) AS first_log, "
        f"CAST(least(count(*), {limit}) AS BIGINT) AS instances FROM {p}tl GROUP BY {LEAF}"
        for sid, p, hit, clusters in ((1, "h", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)"),
                                      (2, "c", "count(*) FILTER (WHERE source = 'CACHE')", "count(DISTINCT cluster_id)"))))
    kinds = {"template_text": "STRING", "count": "BIGINT", "global_count": "BIGINT", "first_seen": "STRING", "last_seen": "STRING",
             "source": "OBJECT", "current_batch_count": "BIGINT", "highlight_current_batch": "BOOLEAN", "instances": "ARRAY",
             "instances_total": "BIGINT", "instances_truncated": "BOOLEAN", "omitted_instances": "BIGINT", "example_logs": "ARRAY", "debug": "OBJECT"}
    listed = ", ".join(f"({q(k)}, {q(v)})" for k, v in kinds.items())
    o["snapshot_shapes"] = with_(two_run_ctes() + runs + [
        f"kinds AS (SELECT * FROM (VALUES {listed}) t(key, kind))",
        f"sizes AS (SELECT CAST(1 AS BIGINT) AS snapshot_id, count(*) AS n FROM (SELECT DISTINCT {LEAF} FROM htl) a UNION ALL "
        f"SELECT CAST(2 AS BIGINT), count(*) FROM (SELECT DISTINCT {LEAF} FROM ctl) b)"],
        "SELECT snapshot_id, key, kind, n FROM kinds, sizes WHERE key <> 'debug' OR snapshot_id = 2")
    return o


ORACLE_SQL = build()
