"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Every word trigram of a test item is a seed, so any three words copied in a row
hit one, however the copy is edited around them, and no choice between the
trigrams can fall on one that the copy doesn't have. (A copy that is edited so
densely that no three words are left in a row has no hit.) Seeds join the
texts' trigrams; around each hit the item is aligned with the passage, and a
score of 45 hundredths of a perfect one is a leak (unrelated texts reach 33).

Items of one or two words are seeds as a whole, and have to be there whole.

The join sends the items to the texts, in blocks of ``BLOCK_WORDS`` words: the
texts never move, and a larger benchmark takes more rounds, not more memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmold.llm.common import map_batches, ngrams, prepare, texts, utf8, whole_rows, word_hashes

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: An alignment's score has to reach this share of a perfect one, and that of
#: ``LEAST`` matching words (of all words in shorter items).
SHARE, LEAST = 0.45, 8
#: Words of the items in one block.
BLOCK_WORDS = 1_000_000

#: Bytes of words: ASCII letters and digits, and all that is not ASCII.
INSIDE = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of the runs of letters and digits, lower-cased."""
    return word_hashes(utf8(text.lower()), INSIDE) if text else np.empty(0, np.uint64)


def least_score(words: int) -> float:
    return max(SHARE * MATCH * words, min(words, LEAST) * MATCH)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first word in the passage, word after the last."""
    n = len(passage)
    table = np.zeros((len(item) + 1, n + 1), np.int32)
    place = np.arange(n + 1, dtype=np.int32) * -GAP
    for i, word in enumerate(item):
        row = table[i + 1]
        np.maximum(table[i, :-1] + np.where(passage == word, MATCH, MISMATCH), table[i, 1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        np.maximum(np.maximum.accumulate(row + place) - place, row, out=row)
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, end = int(table[i, j]), int(j)
    while table[i, j] > 0:
        here = table[i, j]
        if here == table[i - 1, j - 1] + (MATCH if item[i - 1] == passage[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif here == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, int(j), end


class Seeds:
    """Runs of ``n`` words of items, sorted by hash: item number and place of each."""

    def __init__(self, n: int, numbers: list[int], words: list[np.ndarray]):
        self.n = n
        found = [ngrams(w, n) for w in words]
        size = [len(g) for g in found]
        seed, item = np.concatenate([np.empty(0, np.uint64), *found]), np.repeat(np.array(numbers, np.int64), size)
        place = np.concatenate([np.empty(0, np.int64), *map(np.arange, size)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]

    def hits(self, words: np.ndarray):
        """(place in the text, item number, place in the item) wherever they agree."""
        g = ngrams(words, self.n)
        low = np.searchsorted(self.seed, g)
        hit = np.flatnonzero(np.append(self.seed, 0)[low] == g)
        hit = hit[low[hit] < len(self.seed)]
        for p in hit.tolist():
            for s in range(low[p], np.searchsorted(self.seed, g[p], side="right")):
                yield p, int(self.item[s]), int(self.place[s])


class Items:
    """A block of test items: words and seeds, those of shorter items by their length."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.words = [plain_words(t) for t in texts]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                by_size.setdefault(min(len(w), GRAM), []).append(i)
        self.seeds = [Seeds(n, numbers, [self.words[i] for i in numbers]) for n, numbers in sorted(by_size.items())]

    def leaks(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item number, score, first word, word after the last) of the best
        alignment of each item that reaches its least score."""
        around: dict[int, list[tuple[int, int]]] = {}
        for seeds in self.seeds:
            for p, i, place in seeds.hits(words):
                m, begin = len(self.words[i]), p - place
                # an alignment that scores enough has fewer gaps than the item has words
                a, b = max(0, begin - m), min(len(words), begin + 2 * m)
                spans = around.setdefault(i, [])
                if spans and a <= spans[-1][1]:
                    spans[-1] = (min(a, spans[-1][0]), max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
        out = []
        for i, spans in around.items():
            item, need = self.words[i], least_score(len(self.words[i]))
            best = (0, 0, 0)
            for a, b in spans:
                passage = words[a:b]
                if MATCH * np.isin(item, passage).sum() < need:  # can't reach it
                    continue
                score, x, y = align(item, passage)
                if score > best[0]:
                    best = (score, a + x, a + y)
            if best[0] >= need:
                out.append((i, *best))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, item_id, score, first_word, end_word`` of each row of
    ``docs (doc_id, text)`` and item of ``benchmark (item_id, text)`` that it
    contains; ``score`` is the share of a perfect alignment.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased. Null and empty texts and
    items contain nothing. Items of ``LEAST`` words or fewer have to be there
    whole. Repeated rows or items are reported for each; with either table
    empty there are no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_WORDS))
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        block = Items(part["item_id"].to_pylist(), part["text"].to_pylist())
        shared = spark.sparkContext.broadcast(block)

        def matching(shared=shared):
            held = shared.value

            def work(batch: pa.RecordBatch) -> dict:
                row, out = [], {"item_id": [], "score": [], "first_word": [], "end_word": []}
                for r, text in enumerate(batch["text"].to_pylist()):
                    for i, score, a, e in held.leaks(plain_words(text)):
                        row.append(r)
                        out["item_id"].append(held.ids[i])
                        out["score"].append(score / (MATCH * len(held.words[i])))
                        out["first_word"].append(a)
                        out["end_word"].append(e)
                few = batch.select(["k1", "k2", "doc_id"]).take(pa.array(row, pa.int64()))
                return {c: few[c] for c in ("k1", "k2", "doc_id")} | out

            return work

        kind = items.schema["item_id"].dataType.simpleString()
        leaks = map_batches(rows, matching, f"k1 long, k2 long, doc_id long, item_id {kind}, score double, first_word int, end_word int")
        found = leaks if found is None else found.unionByName(leaks)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns."""
    gone = find_leaks(docs, benchmark).select("k1", "k2").distinct()
    return whole_rows(docs).join(gone, ["k1", "k2"], "left_anti").select("row.*")
