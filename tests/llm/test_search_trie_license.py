"""Ball-tree search, conversation trie and license scan: brute force, bounds, bursting and edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logmold.llm import ball_tree, conversation_trie, license_index
from logmold.llm.oracle import ORACLE_SQL

DOCS = "doc_id long, text string"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- ranked search -----------------------------------------------------------------

def brute_search(docs, items, top=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(d, cut(t)) for d, t in docs]
    found = [(d, t) for d, t in found if t]
    n_docs, words = len(found), sum(len(t) for _, t in found)
    df = collections.Counter(w for _, t in found for w in set(t))
    out = []
    for item, text in set(items):
        scored = []
        for d, t in found:
            tf, m = collections.Counter(t), 100 - 25 + (25 * len(t) * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 12 * m))
                        for w in cut(text) if w in tf)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def test_search_small_blocks_and_trees(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(int(i), " ".join(rng.choice(vocabulary[k % 4 * 10:k % 4 * 10 + 30], rng.integers(1, 40)))) for k, i in enumerate(rng.permutation(400))]
    docs += [(5000, docs[0][1]), (4000, docs[0][1]), (None, docs[0][1]), (7, "É É x_y Z9"), (8, None), (9, ""), (8, "...")]
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(9)] + [(20, docs[0][1]), (20, docs[0][1]), (21, None), (22, "nowhere"), (23, "z9 É é")]
    monkeypatch.setattr(ball_tree, "BLOCK_WORDS", 40)
    monkeypatch.setattr(ball_tree, "TREE_DOCS", 64)
    got = ball_tree.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_search(docs, items)
    assert got.schema["rank"].dataType.simpleString() == "int"


def test_search_edge_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], DOCS)
    assert ball_tree.search(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b", 2, 3.0)], "doc_id long, text string, score int, rank double")
    assert ball_tree.search(docs, items.limit(0)).count() == 0
    assert rows_of(ball_tree.search(docs, items), "item_id", "rank", "doc_id") == [(1, 1, 1)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(33, 300))
def test_no_score_above_its_bounds_and_nothing_lost(seed, n):
    rng = np.random.default_rng(seed)
    width = 50
    weight = rng.integers(0, 20000, width)
    held = [np.sort(rng.choice(width, rng.integers(1, 12), replace=False)) for _ in range(n)]
    size, term = np.array([len(x) for x in held]), np.concatenate(held)
    impact = rng.integers(1, 1_000_000, len(term))
    tree = ball_tree.BallTree(size, term, impact, np.sqrt(weight.astype(float)))
    own = np.sort(rng.choice(width, 8, replace=False))
    dense = np.zeros(width, np.int64)
    best = ball_tree.Best(own, weight[own] * rng.integers(1, 4, 8), np.sqrt(weight.astype(float)), 5)
    dense[own] = best.weight
    scores = tree.scores(np.arange(n), dense)

    def below(node):
        return tree.docs[node] if tree.docs[node] is not None else np.concatenate([below(c) for c in tree.children[node]])

    for node in range(len(tree.radius)):
        assert scores[below(node)].max() <= tree.bounds([node], best.term, best.value, best.norm)[0]
    best.search(tree, list(range(n)), dense)
    want = sorted((-int(s), False, i) for i, s in enumerate(scores) if s > 0)[:5]
    assert best.found == want


def test_distant_subtrees_are_pruned():
    """Documents of other terms than the item's lie in leaves that aren't read."""
    size, impact = np.full(1024, 6), np.full(6 * 1024, 500_000)
    term = np.concatenate([np.arange(6) + 6 * (i % 32) for i in range(1024)])
    scale = np.ones(192)
    tree = ball_tree.BallTree(size, term, impact, scale)
    best = ball_tree.Best(np.arange(6), np.full(6, 1000), scale, 20)
    dense = np.zeros(192, np.int64)
    dense[:6] = 1000
    leaves = best.search(tree, list(range(1024)), dense)
    assert leaves <= 8 and sum(d is not None for d in tree.docs) >= 32 and len(best.found) == 20


# --- conversation trie ----------------------------------------------------------------

def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:])
    members = collections.defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[:len(p)] == p]
        leaf = [q for q in under if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in under)]
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in under), len(leaf),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q),
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))).encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        depth = int(rng.integers(0, 7)) if c % 3 else 14  # a third share a long beginning, most of them whole
        for t in range(depth):
            text = f"same {t}" if not c % 3 and (t < 12 or c % 2) else f"é{rng.integers(0, 3)}"
            rows.append((c * 7 - 100, t, "user" if t % 2 else None, text if rng.random() > 0.05 or not c % 3 else None))
    return rows


@pytest.mark.parametrize("limit", [0, 5, 40, 1 << 16])
def test_trie_at_any_container_size(spark, limit):
    rows = conversations(5)
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), limit)
    assert rows_of(got, *NODE) == brute_trie(rows)


def test_trie_edges(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, "a", "first"), (1, 0, "a", "second"), (2, 3, None, None), (None, 1, "a", "b"), (-3, 1, "", "x" * 100_000), (12, 0, "u", "t")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", n int, ends string")
    assert rows_of(conversation_trie.prefix_trie(df), *NODE) == brute_trie(rows)
    assert rows_of(conversation_trie.prefix_trie(df, 0), *NODE) == brute_trie(rows)


def test_same_conversation_many_times(spark):
    """One sequence with thousands of ids, over several chunks of ids, and one very long conversation."""
    rows = [(c * 5, t, "u", f"turn {t}") for c in range(3000) for t in range(2)] + [(1_000_003, t, "u", f"l{t % 7}") for t in range(3000)]
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6), 1000)
    by_depth = {(r["depth"], r["conv_id"]): r for r in got.collect()}
    node = by_depth[2, 0]
    assert node["n_convs"] == 3000 and node["ends_sha256"] == hashlib.sha256(",".join(str(c * 5) for c in range(3000)).encode()).hexdigest()
    assert by_depth[0, 0]["n_convs"] == 3001 and max(d for d, _ in by_depth) >= 2990


# --- license scan ---------------------------------------------------------------------

MIT = license_index.TEMPLATES[13][1]
APACHE = license_index.TEMPLATES[1][1]
LICENSED = [
    (1, "All rights reserved. ALL RIGHTS  RESERVED"), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0."), (5, "x" * 200_000 + " cc-by " + "y " * 50_000),
    (6, f"some words before\n{MIT}\nand after"), (7, MIT.replace("hereby", "herewith")), (8, "license software permission"), (9, "Released under the MIT License."),
    (10, f"{APACHE} Copyright 2020 Someone. {MIT}"), (11, "rights reserved all"), (12, "cc by cc by cc by"), (None, "gnu general public license version 3"),
    (13, "Licensed, as of now, under the Apache License, Version 2.0."), (14, "...!"), (15, "the mit license " * 300), (16, "É all rights reserved é"),
]


def test_license_scan(spark):
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in LICENSED], DOCS + ", pos int, word string")
    got = {r["doc_id"]: r.asDict() for r in license_index.scan(docs).collect()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", LICENSED)
    res = con.execute(ORACLE_SQL["op13_license_index"])
    cols = [d[0] for d in res.description]
    want = {r["doc_id"]: r for r in (dict(zip(cols, x)) for x in res.fetchall())}
    none = got.pop(None)  # SQL joins by id
    want.pop(None)
    assert got == want
    labels = {d: r["labels"] for d, r in got.items()}
    assert labels[1] == "reserved" and labels[4] == "cc-by,cc-by-nc-4.0" and labels[6] == "mit" and labels[9] == "mit"
    assert labels[7] == "" and labels[8] == "" and labels[11] == "" and labels[5] == "cc-by" and labels[10] == "apache-2.0,mit"
    assert none["labels"] == "gpl,gpl-3.0" and labels[13] == "apache-2.0" and got[6]["score"] == 1.0
    assert (got[12]["n_base"], got[12]["first_word"], got[12]["last_word"]) == (3, 0, 4)
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["n_words"]) == (2, 0, 3, 6)
    assert (got[2]["n_words"], got[3]["n_words"], got[14]["n_words"], got[2]["first_word"]) == (0, 0, 0, None)


def test_license_scan_empty(spark):
    assert license_index.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_license_scan_has_no_python(spark):
    plan = license_index.scan(spark.createDataFrame(LICENSED, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
