"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names, for every operator and stage."""

from __future__ import annotations

import random

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from logmold.llm import common, hamming_dedup, sentence_spans
from logmold.llm.bpe import decode, encode, encode_word, pretokens, read_ranks
from logmold.llm.credential_links import find_secrets
from logmold.llm.decontaminate import align, find_leaks, least_score
from logmold.llm.hamming_dedup import CHUNKS, SYMBOLS, index_keys, keep_one, near_duplicates
from logmold.llm.lattice_lm import score_documents
from logmold.llm.line_templates import drop_templates
from logmold.llm.queries import PIECES, RANKS, URL_RULES
from logmold.llm.resampling import resample
from logmold.llm.robust_rules import judge
from logmold.llm.sentence_spans import drop_repeats
from logmold.llm.url_rules import judge_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."


LONG = "\n".join(prose(40, k) for k in range(1500))
NEAR = prose(200, 1).split()
PASSAGE = ". ".join(prose(12, 90 + k) for k in range(6))
#: doc_id, text: nulls, empties, white space, repeated rows, equal and near texts, ids given twice.
ROWS = [
    (1, prose(120, 5)), (2, prose(120, 5)), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (None, prose(60, 6)),
    (None, None), (7, LONG), (8, " ".join(NEAR)), (9, " ".join(NEAR[:100] + ["other"] + NEAR[101:])), (9, "one word"),
    (10, "word"), (11, "a b c d"), (11, "a b c d"), (12, "naïve Ünïcode 𝒳 \u00a0 \u2028 words \U0001F600"),
    (13, prose(30, 11) + " " + PASSAGE), (14, prose(30, 12) + " " + PASSAGE), (15, prose(30, 13) + " " + PASSAGE),
    (16, "All rights reserved.\n" + prose(40, 14)), (17, "All rights reserved.\n" + prose(40, 15)),
    (18, "x\nAll rights reserved."), (19, "z" * 30000), (20, "user = bob password = hunter22x https://h.example/x"),
]
CLASHING = ["k1", "k2", "key", "component_id", "kept", "row", "o", "leaf", "n_words", "gone", "ids", "best", "text_", "rule", "u", "v",
            "dropped_lines", "line", "pos", "x", "cleaned"]


@pytest.fixture(scope="module")
def docs(spark):
    wide = spark.createDataFrame([(d, t, None if d == 1 else "en", "s") for d, t in ROWS], "doc_id long, text string, lang string, source string")
    for c in CLASHING:
        wide = wide.selectExpr("*", f"'x' as {c}")
    return wide.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (2, 1, 0), (3, 0, 1), (3, None, None), (None, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, None), (2, ""), (3, PASSAGE), (4, "too short"), (None, prose(30, 99077)))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "resample": lambda spark, d: resample(d, labels(spark)),
    "drop_templates": lambda spark, d: drop_templates(d),
    "near_duplicates": lambda spark, d: near_duplicates(d),
    "find_secrets": lambda spark, d: find_secrets(d),
    "score_documents": lambda spark, d: score_documents(d, PIECES),
    "judge": lambda spark, d: judge(d),
    "encode": lambda spark, d: decode(encode(d, RANKS), RANKS),
    "drop_repeats": lambda spark, d: drop_repeats(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, docs, empty, name):
    out = OPERATORS[name](spark, docs)
    got = out.collect()
    ids = sorted((r["doc_id"] for r in got), key=repr)
    assert ids == sorted((d for d, _ in ROWS), key=repr)
    none = OPERATORS[name](spark, empty)
    assert none.count() == 0
    if name != "drop_templates":  # that one returns the columns it was given
        assert none.columns == out.columns


def test_stages(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert name == "byte_bpe" or out.columns == docs.columns
        assert out.count() <= len(ROWS)
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_near_edges(spark, docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()]
    by = {(d, n): (c, k) for d, n, c, k in got}
    assert by[2, 116] == (1, False) and by[1, 116] == (1, True)
    assert by[9, 196] == (8, False) and by[9, 1] == (9, True)
    assert by[3, 0] == by[3, 0][:1] + (True,) and by[5, 0] == (5, True) and by[None, 0] == (None, True)
    assert [x for x in got if x[0] == 11] == [(11, 1, 11, True)] * 2
    kept = keep_one(docs).collect()
    assert sum(r["doc_id"] == 11 for r in kept) == 1 and {r["doc_id"] for r in kept} >= {1, 3, 4, 5, 7, 8, None}
    assert 2 not in {r["doc_id"] for r in kept}


def test_big_groups_go_by_blocks(spark, monkeypatch):
    """Small blocks, a large group of near copies, and one of exact copies."""
    monkeypatch.setattr(hamming_dedup, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(hamming_dedup, "BLOCK_SHINGLES", 2000)
    r, rows = random.Random(3), {}
    for i in range(60):
        w = list(NEAR)
        for _ in range(r.randint(1, 7)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(1000)
        rows[i] = " ".join(w)
    rows |= {100 + i: prose(80, 21) for i in range(40)} | {200 + i: prose(50, 300 + i) for i in range(20)}
    got = near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    want = brute.near_groups(rows)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want


def test_pigeonhole_guarantee():
    """Signatures that differ in at most 23 of 84 symbols share a key."""
    r = np.random.default_rng(5)
    for _ in range(300):
        a = r.integers(0, 256, SYMBOLS).astype(np.uint8)
        b = a.copy()
        at = r.choice(SYMBOLS, 2 * CHUNKS - 1, replace=False)
        b[at] ^= r.integers(1, 256, len(at)).astype(np.uint8)
        x, y = index_keys(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + r.randrange(500)) for _ in range(200)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[2001] == 2000 and all(v == 1000 for k, v in got.items() if 1000 <= k < 1500)


def test_urls(spark):
    odd = [(1, None), (2, "x"), (3, "http://COM"), (4, "http://a.com/"), (5, "ftp://x.net/es/a?b"), (6, "http://www.example.com/en/x#y"),
           (7, "http://q.example.com/en/"), (8, "http://example.com/en"), (9, "a://b://c.com/"), (10, "://.com/x"), (11, "http://com/"),
           (12, "http://a..com//en/"), (13, ""), (14, "http://x\n.com/en/\nz"), (14, "http://x\n.com/en/\nz"), (None, "http://" + "a." * 300 + "com/" + "d/" * 300)]
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in odd], "page_id long, url string, host string, r_path string, verdict string")
    rules = spark.createDataFrame(URL_RULES + [("", "/", "block"), (None, "/", "block"), ("com", None, "block"), ("net", "/e", "allow")], "host string, path string, verdict string")

    def want(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = brute.re.match("[^/?#]*", rest)[0]
            path = brute.re.match("[^?#]*", rest[len(host):])[0]
        host = brute.lower(host)
        fits = [(len(h) + len(p), v, h + p) for h, p, v in [*URL_RULES, ("net", "/e", "allow")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else "allow"

    import logmold.llm.url_rules as module
    kept = module.BROADCAST_RULES
    for limit in (kept, 0):  # both ways to join
        module.BROADCAST_RULES = limit
        got = judge_urls(pages, rules).collect()
        assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=repr) == sorted(((i, *want(u)) for i, u in odd), key=repr)
    module.BROADCAST_RULES = kept
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r["rule"], r["verdict"]) for r in judge_urls(pages, none, "block").collect()} == {(None, "block")}
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_leaks_edges(spark, docs, empty):
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in find_leaks(docs, benchmark(spark)).collect()}
    assert got == {(d, 3): 1.0 for d in (13, 14, 15)}
    assert find_leaks(docs, benchmark(spark).limit(0)).count() == 0 and find_leaks(empty, benchmark(spark)).count() == 0
    w = prose(40, 77).split()
    edited = " ".join(x if k % 7 else "changed" for k, x in enumerate(w))
    cut = " ".join(w[:24])
    texts = spark.createDataFrame([(1, "before " + edited + " after"), (2, cut), (3, " ".join(reversed(w))), (4, " ".join(w[:8]))], "doc_id long, text string")
    assert {r["doc_id"] for r in find_leaks(texts, benchmark(spark, [(1, " ".join(w))])).collect()} == {1, 2}


def test_benchmark_in_blocks(spark, docs, monkeypatch):
    import logmold.llm.decontaminate as module
    monkeypatch.setattr(module, "BLOCK_WORDS", 20)
    assert {r["doc_id"] for r in find_leaks(docs, benchmark(spark)).collect()} == {13, 14, 15}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20))
def test_align(a, b):
    score, start, end = align(np.array(a, np.uint64), np.array(b, np.uint64))
    assert score == brute.local_alignment(a, b) and score == brute.local_alignment(a, b[start:end])
    assert least_score(len(a)) <= 2 * len(a)


def test_linked_secrets(spark):
    opaque = "Ab3dEf6hIj9kLm2nOp5qRs8tUv1wXy4zAb7dEf0h"
    texts = [
        f"login: alice then {opaque} at https://api.example.org/v1",  # all three parts
        f"{opaque} alone", "https://api.example.org/v1 alone", "user = alice",  # nothing complementary
        "username: bob" + " pad" * 200 + " password = hunter22x",  # too far away
        "username: bob password = hunter22x", "password=abc token=secret:abcdefgh", None, "",
        "pa\u017fsword=abcdefg", "x" * 50 + "AKIA" + "A" * 16 + " " + "f" * 23 + " " + "0" * 24,
    ]
    got = {r["doc_id"]: r for r in find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = [",".join(x.split(":")[0] for x in got[i]["spans"].split(",")) for i in range(len(texts))]
    assert kinds == ["account,opaque,endpoint", "", "", "", "assign", "account,assign", "assign", "", "", "", "access,hex"]
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == brute.sha(",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in brute.secrets(t)))


def test_bpe_words_and_pieces():
    ranks = read_ranks(RANKS)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    def ids(text):
        return [i for joined, _, start, end, _ in pretokens([text]) for a, b in zip(start, end) for i in encode_word(joined[a:b].encode(), ranks)]

    r = random.Random(2)
    alphabet = "abcdefghij   \n\té's'll1234.,!?<|>𝒳\u3000\u00a0\x1c²"
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert ids(t) == encoder.encode_ordinary(t), t
    for n in (47, 48, 49, 50, 400, 3000):
        for t in ("a" * n, " " * n, "".join(r.choice("abcdefg") for _ in range(n)), "é" * n, "<|endoftext|>" * n):
            assert ids(t) == encoder.encode_ordinary(t)


def test_decode_edges(spark):
    rows = spark.createDataFrame([(1, [72, 105]), (2, []), (3, None)], "doc_id long, ids array<int>")
    ranks = {i: t for t, i in read_ranks(RANKS).items()}
    got = {r["doc_id"]: r["decoded"] for r in decode(rows, RANKS).collect()}
    assert got == {1: ranks[72] + ranks[105], 2: b"", 3: None}
    with pytest.raises(Exception, match="vocabulary"):
        decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), RANKS).collect()


def test_repeats_edges(spark, docs):
    got = {}
    for r in drop_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_removed"], r["text"]))
    texts = dict(ROWS)
    assert got[1] == [(0, texts[1])] and got[3] == [(0, None)] and got[4] == [(0, "")] and got[7] == [(0, LONG)]
    assert got[13] == [(0, texts[13])] and got[14][0][0] > 0 and PASSAGE[20:] not in got[15][0][1]
    assert sorted(got[11]) == [(0, "a b c d")] * 2


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .!?\n\t\x0bé", max_size=60))
def test_sentences_cover_the_text(text):
    found = sentence_spans.sentences(text)
    assert "".join(found) == text and found == brute.sentence_list(text)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_word_hashes(text):
    w = brute.words(brute.lower(text))
    h = common.lower_hashes(text)
    assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))


def test_word_hashes_in_pieces(monkeypatch):
    whole = common.lower_hashes(LONG)
    monkeypatch.setattr(common, "PIECE", 97)
    assert (common.lower_hashes(LONG) == whole).all()


def test_templates_generalise_fields(spark):
    """Digits and rare words are fields; the first document keeps its line."""
    lines = [f"Session {k} opened for {n} by the gateway" for k, n in zip(range(4), ["ann", "bob", "cy", "dee"])]
    rows = [(i, f"{prose(9, 500 + i)}\n{x}") for i, x in enumerate(lines)] + [(9, prose(9, 600)), (10, "two words\ntwo words")]
    got = {r["doc_id"]: (r["dropped_lines"], r["text"]) for r in drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(4)] == [[], [1], [1], [1]] and got[9][0] == [] and got[10][0] == []
    assert got[2][1] == prose(9, 502)
