"""Golden rows of the row-local functions (FIXTURES.md section 3) and
properties of the text expressions."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logmold.functions import text as T

# text, signature, masked, template, level, event, bucket, label
GOLDEN = [
    ("User 123 logged in from 10.0.0.1", "user <num> logged", "User <*> logged in from <*>",
     "User <*> logged in from <*>", "INFO", "GENERIC", "login", "normal"),
    ("Database query timed out after 5000ms", "database query timed", "Database query timed out after 5000ms",
     "Database query timed out after 5000ms", "INFO", "DB", "database", "normal"),
    ("Error: connection timeout", "error: connection timeout", "Error: connection timeout",
     "Error: connection timeout", "ERROR", "NETWORK", "timeout", "error"),
    ("Disk error on node 7", "disk error on", "Disk error on node <*>", "Disk error on node <*>",
     "ERROR", "SYSTEM", "system", "error"),
    ("id 123e4567-e89b-12d3-a456-426614174000 done", "id <guid> done", "id 123e4567-e89b-12d3-a456-<*> done",
     "id 123e4567-e89b-12d3-a456-<*> done", "INFO", "GENERIC", "generic", "normal"),
    ("id a1b2c3d4-e5f6-a7b8-c9d0-e1f2a3b4c5d6 done", "id <guid> done", "id <*> done", "id <*> done",
     "INFO", "GENERIC", "generic", "normal"),
    ("code 0xFF 12 13", "code <hex> <num>", "code <*> <*> <*>", "code <*>", "INFO", "GENERIC", "generic", "normal"),
    ("1.2.3.4.5 up", "<ip>.<num> up", "<*>.<*> up", "<*>.<*> up", "INFO", "GENERIC", "generic", "normal"),
    ("login failed", "login failed", "login failed", "login failed", "ERROR", "AUTH", "login", "error"),
    ("will fail soon", "will fail soon", "will fail soon", "will fail soon", "INFO", "GENERIC", "generic", "error"),
    ("rapid author", "rapid author", "rapid author", "rapid author", "INFO", "GENERIC", "login", "normal"),
    ("", "", "", "", "INFO", "GENERIC", "generic", "normal"),
    ("ERROR   multiple   spaces 5", "error multiple spaces", "ERROR   multiple   spaces <*>",
     "ERROR multiple spaces <*>", "ERROR", "GENERIC", "generic", "error"),
    ("token é5 ok", "token é5 ok", "token é5 ok", "token é5 ok", "INFO", "AUTH", "login", "normal"),
]


def test_golden_rows(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "text STRING")
    tmpl = T.normalize_template(T.heuristic_template(F.col("text")))
    ev = T.event_type(F.col("text"))
    out = df.select(
        "text", T.signature(F.col("text")).alias("sig"), T.mask_dynamic_parts(F.col("text")).alias("masked"),
        tmpl.alias("template"), T.log_level(F.col("text")).alias("level"), ev.alias("event"),
        T.tree_bucket(F.col("text"), ev).alias("bucket"), T.classify_template(tmpl).alias("label"),
    ).collect()
    got = {r["text"]: tuple(r) for r in out}
    for g in GOLDEN:
        assert got[g[0]] == g, (got[g[0]], g)


def test_extract_and_normalize(spark):
    df = spark.createDataFrame([("Template: - User <*> x\nmore",), ("",), (None,), ("- a\r\nb",)], "raw STRING")
    got = [r[0] for r in df.select(T.extract_template(F.col("raw"))).collect()]
    assert got == ["User <*> x", "", "", "a"]
    n = spark.createDataFrame([("< * >  <*>",)], "t STRING").select(T.normalize_template(F.col("t"))).first()[0]
    assert n == "<*>"


def test_prompt_and_cache_key(spark):
    import hashlib

    df = spark.createDataFrame([(["a 1", "b 2"],)], "lines ARRAY<STRING>")
    row = df.select(T.build_prompt(F.col("lines")).alias("p"),
                    T.cache_key(F.lit("a <num>"), F.col("lines")).alias("k")).first()
    assert row["p"].startswith(T.PROMPT_HEAD) and row["p"].endswith("- a 1\n- b 2" + T.PROMPT_TAIL)
    assert row["k"] == hashlib.sha256("a <num>||a 1\nb 2".encode()).hexdigest()


def test_pct_half_even(spark):
    df = spark.createDataFrame([(1, 8), (2, 3), (0, 0), (1, 32)], "c BIGINT, t BIGINT")
    got = [r[0] for r in df.select(T.pct(F.col("c"), F.col("t"))).collect()]
    assert got == [12.5, 66.67, 0.0, 3.12]


def test_level_colors_and_source(spark):
    df = spark.createDataFrame([("warn",), ("bogus",), (None,)], "l STRING")
    got = [tuple(r) for r in df.select(T.tree_level("l").alias("lv"), T.level_color(T.tree_level("l")),
                                       T.source_norm("l")).collect()]
    assert got == [("WARN", "orange", "SLM"), ("INFO", "blue", "SLM"), ("INFO", "blue", "SLM")]


def _literal_signature(c, n=3):
    # The definition as written: replace on the whole lowered text, then split.
    out = F.lower(c)
    for pattern, token in T.SIGNATURE_TOKENS:
        out = F.regexp_replace(out, T._u(pattern), token)
    toks = F.filter(F.split(out, f"(?U){T.WS}+"), lambda t: t != F.lit(""))
    return F.array_join(F.slice(toks, 1, n), " ")


WORDS = st.sampled_from(["User", "0x1F", "12", "1.2.3.4", "10.0.0.1.7", "a1b2c3d4-e5f6-a7b8-c9d0-e1f2a3b4c5d6",
                         "é5", "٣", "ERROR", "x", "<*>", "< * >", "db", "\t", " ", "\x1c", "-", ""])
TEXTS = st.lists(st.tuples(WORDS, st.sampled_from([" ", "  ", "\t", " ", "", "\x1f"])), max_size=8).map(
    lambda xs: "".join(a + b for a, b in xs))


@settings(max_examples=30, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_signature_prefix_equals_literal_definition(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    for n in (0, 1, 3):
        rows = df.select(T.signature(F.col("text"), n).alias("a"), _literal_signature(F.col("text"), n).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows), [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]


@settings(max_examples=20, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_normalize_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    once = T.normalize_template(F.col("text"))
    rows = df.select(once.alias("a"), T.normalize_template(once).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


PIECES = st.sampled_from(["5", "12", "٣", "5\u0301", "\u093e5", "5²", "10½", "①5", "Ⅷ", "5\u200d", "\u200d7", "x", "é", "_", "-", ".",
                          " ", "1.2.3.4", "0x1F", "0xé", "error", "erroré", "error\u0301", "login", "db", "db²", "a1b2c3d4-e5f6-a7b8-c9d0-e1f2a3b4c5d6"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=6).map("".join), min_size=1, max_size=30))
def test_patterns_equal_python(spark, texts):
    """Digits beside marks, joiners and superscripts: as Python's re does."""
    import re

    def mask(t, order):
        for pattern in order:
            t = re.sub(pattern, T.PLACEHOLDER, t)
        return t

    def first(t, table, default):
        return next((label for label, words in table if re.search(rf"\b({words})\b", t, re.I)), default)

    c = F.col("text")
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").select(
        "text", T.mask_dynamic_parts(c).alias("m"), T.heuristic_template(c).alias("h"),
        T.log_level(c).alias("l"), T.event_type(c).alias("e")).collect()
    for r in rows:
        t = r["text"]
        assert (r["m"], r["h"]) == (mask(t, T.MASK_ORDER), mask(t, T.TEMPLATE_MASK_ORDER)), repr(t)
        assert r["l"] == first(t, T.LEVEL_WORDS, T.DEFAULT_LEVEL) and r["e"] == first(t, T.EVENT_WORDS, T.DEFAULT_EVENT), repr(t)


def test_every_listed_word(spark):
    """Golden rows: each word of each list, written out here on its own."""
    levels = {"ERROR": "error exception fatal panic failed", "WARN": "warn warning deprecated retry",
              "INFO": "info started connected success"}
    events = {"AUTH": "login logout auth token password", "NETWORK": "timeout connection socket dns http",
              "DB": "sql database db query transaction", "SYSTEM": "cpu memory disk node service process"}
    rows = [(f"x {w.upper()} y", lab, None) for lab, ws in levels.items() for w in ws.split()]
    rows += [(f"x {w} y", None, lab) for lab, ws in events.items() for w in ws.split()] + [("logged in", "INFO", "GENERIC")]
    df = spark.createDataFrame(rows, "t STRING, level STRING, event STRING")
    for r in df.select("*", T.log_level(F.col("t")).alias("l"), T.event_type(F.col("t")).alias("e")).collect():
        assert r["level"] in (None, r["l"]) and r["event"] in (None, r["e"]), r


def test_python_whitespace_and_line_breaks(spark):
    from logmold.sources.lines import split_text_lines

    text = "a\x1cb c\r\nd\x0be\n\nf"
    got = spark.createDataFrame([(text,)], "t STRING").select(split_text_lines(F.col("t"))).first()[0]
    assert [x for x in got if x] == [x for x in text.splitlines() if x]
    s = " \x1f  x y 　"
    got = spark.createDataFrame([(s,)], "t STRING").select(T.py_strip(F.col("t")), T.collapse_whitespace(F.col("t"))).first()
    assert tuple(got) == (s.strip(), " ".join(s.split()))
