"""Cases that the corpus operators once did in part only."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from logmold.llm.credential_links import KINDS, ROLE, SCOPE, find_secrets, parts
from logmold.llm.decontaminate import find_leaks
from logmold.llm.hamming_dedup import near_duplicates, set_forest
from logmold.llm.line_templates import drop_templates
from logmold.llm.robust_rules import judge

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."


@pytest.mark.parametrize("junk", [20, 100, 130])
def test_alike_junk_of_a_source_is_rejected(spark, junk):
    """Copied spam that passes the base rules, up to more than a third of one source."""
    spam = " ".join(f"{w}{'#$*' * 4}{k}" for k, w in enumerate(VOCABULARY[:40]))
    rows = [(k, prose(60 + k % 90, k), "en", "s") for k in range(300 - junk)]
    rows += [(1000 + k, f"{spam} n{k}", "en", "s") for k in range(junk)]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(300 - junk))


def test_edited_copies_without_six_words_in_a_row(spark):
    """Each item in two copies with different edits, of which neither has all its trigrams."""
    items, texts = {}, {}
    for n in (18, 39, 58):
        for every in (4, 5, 6):
            items[n * 10 + every] = item = prose(n, n * 10 + every)[:-1]
            for off in (1, 3):
                w = [f"edit{k}" if k % every == off else x for k, x in enumerate(item.split())]
                texts[(n * 10 + every) * 10 + off] = prose(30, n + every) + " " + " ".join(w) + " " + prose(30, n * every)
    # a word put in after every three
    items[1], texts[1] = prose(30, 1)[:-1], " ".join(x + f" more{k}" * (k % 3 == 2) for k, x in enumerate(prose(30, 1)[:-1].split()))
    want = brute.leaks(texts, items)
    assert {d for d, _ in want} == set(texts)
    got = find_leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
                     spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_parts_longer_than_the_scope_are_linked(spark):
    """The gap counts, wherever the parts lie and however long they are."""
    def token(n):
        return ("Ab3dEf6hIj9kLm2nOp5q" * (n // 20 + 1))[:n]

    texts = []
    for long in (40, 299, 301, 700, 2000):
        for gap in (20, 290, 298, 299, 300, 301, 302, 320):
            for lead in ("", " " * 299, " " * 450):
                texts.append(f"{lead}{token(long)}{' ' * gap}user = alice")
                texts.append(f"{lead}login: alice{' ' * gap}{token(long)}")
                texts.append(f"{lead}password={token(long)}{' ' * gap}user = alice")
                texts.append(f"{lead}user = {token(long)}{' ' * gap}https://h.example/{'x' * long}{' ' * gap}{token(long)}")

    def linked(text):
        found, out = parts(text), []
        for a, k, b in found:
            near = {ROLE[KINDS[j]] for c, j, d in found if max(c - b, a - d) <= SCOPE} - {ROLE[KINDS[k]]}
            if k >= 3 and {"i": "s" in near, "s": "i" in near, "e": near >= {"i", "s"}}[ROLE[KINDS[k]]]:
                out.append((a, k, b))
        return out

    got = {r["doc_id"]: [tuple(x) for x in r["linked"]] for r in find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: linked(t) for i, t in enumerate(texts)}
    assert any(want.values()) and not all(want.values())
    assert got == want


def test_items_of_one_two_and_three_words(spark):
    items = {1: "photosynthesis", 2: "Hello world", 3: "alpha beta gamma", 4: "", 5: "...", 6: "not there", 7: "x"}
    texts = {10: "On photosynthesis, and more", 11: "we say hello WORLD to all", 12: "hello big world", 13: "so alpha beta gamma", 14: "alpha beta", 15: "world hello",
             16: "x", 17: "", 18: "hello world, hello world x"}
    want = brute.leaks(texts, items)
    assert want == {(10, 1), (11, 2), (13, 3), (16, 7), (18, 2), (18, 7)}
    got = find_leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
                     spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


@pytest.mark.parametrize("n", [1000, 20_000])
def test_share_of_template_lines_found_at_any_size(spark, n):
    """A line of two fields with a thousand values each, once in each document."""
    r = random.Random(n)
    docs = [(i, f"Posted on Monday by {VOCABULARY[r.randrange(1000)]} in {VOCABULARY[1000 + r.randrange(1000)]} section") for i in range(n)]
    got = drop_templates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert got.where("size(dropped_lines) = 1").count() == n - 1


@pytest.mark.parametrize("least", [80, 85])
def test_links_at_a_given_similarity(spark, least):
    r = random.Random(least)
    docs = {}
    for g in range(25):
        words = [r.choice(VOCABULARY) for _ in range(r.randint(20, 60))]
        for k in range(4):
            docs[g * 10 + k] = " ".join(words)
            words = words[:r.randint(len(words) * 8 // 10, len(words))] + [r.choice(VOCABULARY)] * r.randint(0, 2)
    want = brute.near_groups(docs, least)
    got = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), least).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_many_short_near_copies_in_one_block():
    """A hundred thousand sets of ten shingles in one family: one step, no pairs."""
    base = np.arange(11, dtype=np.uint64) * np.uint64(1 << 40)
    sets = [np.sort(np.r_[base, np.uint64(k + 1)]) for k in range(100_000)]
    out = set_forest(sets, 80)
    assert len(out) == len(sets) - 1 and {root for _, root in out} == {0}
    far = [np.arange(10, dtype=np.uint64) + np.uint64(100 * k) for k in range(300)]
    assert set_forest(far + far[:2], 85) == [(300, 0), (301, 1)]
