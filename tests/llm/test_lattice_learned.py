"""The subword lattice's probabilities come from the training rows."""

import collections
import math
import random

import pytest

import brute
from logmold.llm import lattice_lm
from logmold.llm.lattice_lm import Lattice, score_documents
from logmold.llm.queries import PIECES

SCHEMA = "doc_id long, text string"


def rows():
    r = random.Random(3)
    parts = ["qua", "zor", "vix", "mel", "dra", "po"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(60)]
    found = [(d, " ".join(words[int(r.random() ** 3 * 60)] for _ in range(40))) for d in range(60)]
    return found + [(60, None), (61, ""), (None, "Melpo melpo"), (62, "zor\U0001F9FF zor\U0001F9FFé \U0001F9FF"), (62, "melpo"), (62, "melpo")]


def all_cuts(s, p, spelled):
    """Every way to cut ``s``: its pieces and probability."""
    if not s:
        return [((), 1.0)]
    out = []
    for k in range(1, len(s) + 1):
        if s[:k] in p:
            out += [((s[:k], *rest), p[s[:k]] * x) for rest, x in all_cuts(s[k:], p, spelled)]
    if s[0] not in p:
        b = s[0].encode()
        out += [((*b, *rest), math.prod(spelled[c] for c in b) * x) for rest, x in all_cuts(s[1:], p, spelled)]
    return out


def learned(words):
    logs, of_byte = lattice_lm.read_pieces(PIECES)
    prior = {**{p: math.exp(x) for p, x in logs.items()}, **{b: math.exp(x) for b, x in enumerate(of_byte)}}
    now = prior
    for _ in range(lattice_lm.PASSES):
        times = {k: lattice_lm.PRIOR * x for k, x in prior.items()}
        for w in words:
            found = all_cuts(lattice_lm.SPACE + w, now, now)
            total = sum(x for _, x in found)
            for cut, x in found:
                for k in cut:
                    times[k] += x / total
        total = sum(times.values())
        now = {k: x / total for k, x in times.items()}
    return now


@pytest.mark.parametrize("hot", [lattice_lm.HOT_WORDS, 10])
def test_scores_are_learned(spark, monkeypatch, hot):
    monkeypatch.setattr(lattice_lm, "HOT_WORDS", hot)
    table = rows()
    held = [d is not None and brute.held_out(d) for d, _ in table]
    c = collections.Counter(w for (_, t), h in zip(table, held) if not h for w in brute.words(brute.lower(t or "")))
    n, ends = sum(c.values()), held.count(False)
    p = learned(list(c))

    def of(w):
        spelled = sum(x for _, x in all_cuts(lattice_lm.SPACE + w, p, p))
        return (max(c[w] - lattice_lm.DISCOUNT, 0) + lattice_lm.DISCOUNT * len(c) * spelled) / n

    def score(t):
        end = ends / (n + ends)
        return sum(math.log10(of(w) * (1 - end)) for w in brute.words(brute.lower(t or ""))) + math.log10(end)

    got = score_documents(spark.createDataFrame(table, SCHEMA), PIECES).collect()
    key = lambda d, s: (d is None, d or 0, s)
    got = sorted(key(r["doc_id"], r["score"]) for r in got)
    for a, b in zip(got, sorted(key(d, score(t)) for d, t in table), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * abs(b[2])


def test_held_out_near_the_base(spark):
    got = score_documents(spark.createDataFrame(rows(), SCHEMA), PIECES).where("held_out").collect()
    assert len(got) > 5 and all(math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got) > 1.1 * sum(r["base_score"] for r in got)


def test_no_training_rows(spark):
    """All held out: the prior spells every word, scores are finite."""
    held = [d for d in range(40) if brute.held_out(d)][:3]
    got = score_documents(spark.createDataFrame([(d, "qua zor") for d in held], SCHEMA), PIECES).collect()
    assert len(got) == 3 and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)


def test_recursion_of_many_words():
    import numpy as np

    logs, of_byte = lattice_lm.read_pieces(PIECES)
    longest = max(map(len, logs))
    words = ["the", "a", "thetion", "x1.", "été", "\U0001F9FF", "q" * 3000, "z\U0001F9FF͸", "\ud800"]
    cuts = Lattice(list(logs)).cut([w.encode("utf-8", "surrogatepass") for w in words])
    got = cuts.forward(np.array([*logs.values(), *of_byte]), len(logs))[1][cuts.last]
    for w, x in zip(words, got):
        want = lattice_lm.log_marginal(w, logs, of_byte, longest)
        assert abs(x - want) < 1e-9 * abs(want)
