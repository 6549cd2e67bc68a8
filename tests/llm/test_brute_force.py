"""Each corpus query on a small folder of the given tables against a
brute-force version, or its DuckDB oracle."""

from __future__ import annotations

import collections
import math
import os

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from logmold.llm import bpe, lattice_lm, resampling, robust_rules
from logmold.llm.oracle import ORACLE_SQL
from logmold.llm.queries import PIECES, QUERIES, RANKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("select doc_id, text from documents").fetchall())


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def collect(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_importance(spark, con, docs):
    rows = collect(spark, "op1_importance")
    labels = con.execute("select doc_id, quality, toxic from labels").fetchall()
    target = {d for d, q, t in labels if q == 1 and t == 0}
    raw, good = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    found = {d: resampling.buckets(t) for d, t in docs.items()}
    for d, b in found.items():
        np.add.at(raw, b, 1)
        if d in target:
            np.add.at(good, b, 1)
    n = resampling.BUCKETS
    for r in rows:
        b = found[r["doc_id"]]
        want = sum(math.log((good[x] + 1) / (good.sum() + n)) - math.log((raw[x] + 1) / (raw.sum() + n)) for x in b)
        assert r["n_grams"] == len(b) and abs(r["log_weight"] - want) < 1e-6
    k = round(np.mean([q == 1 for _, q, _ in labels]) * len(docs))
    by_key = sorted(rows, key=lambda r: -r["key"])
    assert [r["kept"] for r in by_key] == [True] * k + [False] * (len(docs) - k)
    # held to the labels: the draw keeps good documents and few others
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert np.mean([d in kept for d in target if d in docs]) > 0.95
    assert np.mean([d in kept for d, q, t in labels if q == 0]) < 0.5


def test_near_groups_brute(spark, docs):
    want = brute.near_groups(docs)
    for r in collect(spark, "op4_minhash_hamming"):
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_leaks(spark, con, docs):
    items = dict(con.execute("select item_id, text from benchmark").fetchall())
    rows = collect(spark, "op5_decontaminate")
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute.leaks(docs, items)
    for r in rows:
        w = brute.benchmark_words(docs[r["doc_id"]])[r["first_word"]:r["end_word"]]
        item = brute.benchmark_words(items[r["item_id"]])
        assert brute.local_alignment(item, w) == r["score"] * 2 * len(item)


def test_secrets(spark, docs):
    for r in collect(spark, "op6_credential_links"):
        found = brute.secrets(docs[r["doc_id"]])
        spans = ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in found)
        assert r["base_sha256"] == brute.sha(spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize("hot", [lattice_lm.HOT_WORDS, 50])
def test_lattice(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(lattice_lm, "HOT_WORDS", hot)
    c, ends = collections.Counter(), 0
    for d, t in docs.items():
        if not brute.held_out(d):
            c.update(brute.words(brute.lower(t)))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    pieces, of_byte = lattice_lm.read_pieces(PIECES)
    longest = max(map(len, pieces))
    for r in collect(spark, "op7_lattice"):
        w = brute.words(brute.lower(docs[r["doc_id"]]))
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (brute.held_out(r["doc_id"]), len(w) + 1, n)
        assert r["n_known"] == sum(c[x] > 0 for x in w) + 1
        base = sum(math.log10((k + 0.5) / (n + 0.5 * (v + 1))) for k in [*(c[x] for x in w), ends])
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
        score = sum(lattice_lm.log_marginal(x, pieces, of_byte, longest) / math.log(10) + math.log10(1 - ends / n) for x in w) + math.log10(ends / n)
        assert abs(r["score"] - score) < 1e-6 * abs(score)


def test_log_marginal_sums_all_segmentations():
    pieces, of_byte = lattice_lm.read_pieces(PIECES)
    assert abs(sum(map(math.exp, pieces.values())) + 256 * math.exp(of_byte[0]) - 1) < 1e-9
    longest = max(map(len, pieces))
    for w in ("a", "the", "then", "thetion", "aaaaaa", "é", "x1.", "eaux"):
        if all(ch in pieces for ch in w):
            want = math.log(brute.all_segmentations(lattice_lm.SPACE + w, pieces))
            assert abs(lattice_lm.log_marginal(w, pieces, of_byte, longest) - want) < 1e-9
    assert lattice_lm.log_marginal("\U0001F9FF", pieces, of_byte, longest) > -math.inf
    assert lattice_lm.log_marginal("q" * 20000, pieces, of_byte, longest) > -math.inf


def test_robust_rules(spark, con, docs, monkeypatch):
    monkeypatch.setattr(robust_rules, "MIN_GROUP", 30)
    rows = con.execute("select lang, source, text, doc_id from documents order by doc_id").fetchall()
    want = brute.robust_kept([r[:3] for r in rows], robust_rules)
    got = {r["doc_id"]: r for r in collect(spark, "op8_robust_rules")}
    for k, (_, _, text, d) in enumerate(rows):
        counts = brute.quality_counts(text)
        assert all(got[d][c] == counts[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got[d]["kept"] == want[k], (d, got[d])


@pytest.mark.parametrize("hot", [bpe.HOT_WORDS, 20])
def test_bpe(spark, docs, encoder, monkeypatch, hot):
    monkeypatch.setattr(bpe, "HOT_WORDS", hot)
    for r in collect(spark, "op9_bpe"):
        ids = encoder.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == brute.sha(docs[r["doc_id"]])


def test_sentence_spans(spark, docs):
    want = brute.removed_sentences(docs)
    for r in collect(spark, "op10_sentence_spans"):
        found = brute.sentence_list(docs[r["doc_id"]])
        off = want[r["doc_id"]]
        assert (r["n_sentences"], r["n_removed"], r["removed"]) == (len(found), len(off), ",".join(map(str, off)))
        assert r["text"] == "".join(s for i, s in enumerate(found) if i not in off)


def test_pipeline(spark, con, encoder):
    rows = con.execute("select doc_id, lang, source, text from documents order by doc_id").fetchall()
    kept = brute.robust_kept([r[1:] for r in rows], robust_rules)
    docs = {r[0]: r[3] for k, r in enumerate(rows) if kept[k]}
    off = brute.dropped_lines(docs)
    docs = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in off[d]) for d, t in docs.items()}
    docs = {d: t for d, t in docs.items() if not off[d] or brute.words(t)}
    groups = brute.near_groups(docs, 80)
    docs = {d: t for d, t in docs.items() if groups[d][1] == d}
    items = dict(con.execute("select item_id, text from benchmark").fetchall())
    gone = {d for d, _ in brute.leaks(docs, items)}
    want = {d: encoder.encode_ordinary(t) for d, t in docs.items() if d not in gone}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys()
    for d, ids in want.items():
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(docs[d]))


def test_stage_columns(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
