"""Ranked lexical search: exact inner products by sparse ball trees.

A document's impact of a term is an integer, a term's weight too, and the score
of an item is the inner product of its weights and the document's impacts.

1. Items go in blocks of at most ``BLOCK_WORDS`` words (one block for any usual
   benchmark). One pass over the texts keeps, for each document, its length and
   the counts of the block's terms, as numbers; the corpus statistics are
   aggregates over these rows, that is over all documents.
2. A task deals its documents into ball trees of a bounded size. A node is a
   ball: the centroid of its documents, the largest Euclidean distance from it,
   and the largest excess over it in each term. Impacts are scaled by the root
   of the term's weight, and so are items, so that frequent terms count little
   in either distance.
3. Each item searches each tree best first. No document of a node scores more
   than ``<item, centroid>`` plus the smaller of ``|item| * radius``
   (Cauchy-Schwarz) and ``<item, excess>`` (Hoelder); a node whose bound is
   below the k-th best score so far is pruned with all its documents. Bounds
   are rounded up by far more than their floating-point error. In a leaf the
   scores are integers. The best k of an item go on from tree to tree.
4. The tasks' best k are ranked per item, k rows a task at most.

Nothing but the k best of each item leaves a task, and documents don't move.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmold.llm.common import map_batches, prepare, stash, texts, utf8

TOP = 20
#: Words of the items in one block, and of a block's terms in one tree node
#: times the nodes of a tree: bounds what a task holds.
BLOCK_WORDS, CELLS = 1 << 15, 1 << 23
TREE_DOCS, LEAF = 4096, 32
#: Relative error that bounds allow for; that of a sum of n products is n * 2^-53.
SLACK = 1e-9

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Byte for byte: A-Z to lower case, other ASCII but letters and digits to a space.
FOLD = bytes(i if i >= 128 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased."""
    return utf8(text).translate(FOLD).split()


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


class BallTree:
    """Documents given as rows of (term, impact): ``size`` terms each, end to end, none empty."""

    def __init__(self, size: np.ndarray, term: np.ndarray, impact: np.ndarray, scale: np.ndarray):
        self.size, self.term, self.impact = size, term, impact
        self.start = np.cumsum(size) - size
        self.value = impact * scale[term]
        self.square = np.add.reduceat(self.value ** 2, self.start)
        self.width = len(scale)
        self.center: list[np.ndarray] = []
        self.excess: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.docs: list[np.ndarray | None] = []
        self._build(np.arange(len(size)))
        self.center, self.excess, self.radius = np.array(self.center), np.array(self.excess), np.array(self.radius)

    def _dots(self, docs: np.ndarray, place: np.ndarray, vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value[place] * vector[self.term[place]], np.cumsum(self.size[docs]) - self.size[docs])

    def _build(self, docs: np.ndarray) -> int:
        """Adds the ball of ``docs`` and, below it, those of its two halves. (At
        most log2(TREE_DOCS / LEAF) calls deep: halves are even.)"""
        node = len(self.radius)
        place = _ranges(self.start[docs], self.size[docs])
        term, value = self.term[place], self.value[place]
        center = np.bincount(term, value, self.width) / len(docs)
        toward = self._dots(docs, place, center)
        square = self.square[docs] - 2 * toward + center @ center
        # the difference cancels; its error is relative to what was subtracted
        radius = np.sqrt(max(square.max(), 0.0) + SLACK * (self.square[docs].max() + center @ center))
        most = np.zeros(self.width)
        np.maximum.at(most, term, value)
        for held, x in ((self.center, center), (self.excess, np.maximum(most - center, 0)), (self.radius, radius),
                        (self.children, None), (self.docs, None)):
            held.append(x)
        if len(docs) <= LEAF:
            self.docs[node] = docs
            return node
        # halves along the line between two documents that lie far apart
        first = self._row(docs[int(square.argmax())])
        second = self._row(docs[int((self.square[docs] - 2 * self._dots(docs, place, first)).argmax())])
        order = np.argsort(self._dots(docs, place, second - first), kind="stable")
        half = len(docs) // 2
        self.children[node] = (self._build(docs[order[:half]]), self._build(docs[order[half:]]))
        return node

    def _row(self, doc: int) -> np.ndarray:
        out = np.zeros(self.width)
        at = slice(self.start[doc], self.start[doc] + self.size[doc])
        out[self.term[at]] = self.value[at]
        return out

    def bounds(self, nodes: list[int], term: np.ndarray, value: np.ndarray, norm: float) -> np.ndarray:
        """No document of the node scores more."""
        cells = np.ix_(nodes, term)
        reach = np.minimum(norm * self.radius[nodes], self.excess[cells] @ value)
        return (self.center[cells] @ value + reach) * (1 + SLACK) + 0.5

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        place = _ranges(self.start[docs], self.size[docs])
        return np.add.reduceat(weight[self.term[place]] * self.impact[place], np.cumsum(self.size[docs]) - self.size[docs])


class Best:
    """The ``top`` best documents of one item so far: (-score, id is null, id)."""

    def __init__(self, term: np.ndarray, weight: np.ndarray, scale: np.ndarray, top: int):
        self.term, self.weight, self.top = term, weight, top
        self.value = weight / np.where(scale[term] > 0, scale[term], 1)
        self.norm = float(np.sqrt((self.value ** 2).sum()))
        self.found: list[tuple[int, bool, int]] = []
        self.least = 1  # scores below it don't matter

    def search(self, tree: BallTree, ids: list, weight: np.ndarray) -> int:
        """Best first through a tree; ``weight`` is zero but for the item's terms. Returns the leaves read."""
        open_nodes = [(-float(tree.bounds([0], self.term, self.value, self.norm)[0]), 0)]
        leaves = 0
        while open_nodes and -open_nodes[0][0] >= self.least:
            _, node = heapq.heappop(open_nodes)
            if (docs := tree.docs[node]) is not None:
                leaves += 1
                self.offer(tree.scores(docs, weight), docs, ids)
                continue
            pair = list(tree.children[node])
            for bound, child in zip(tree.bounds(pair, self.term, self.value, self.norm).tolist(), pair):
                if bound >= self.least:
                    heapq.heappush(open_nodes, (-bound, child))
        return leaves

    def offer(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        good = np.flatnonzero(scores >= self.least)
        if len(good):
            self.found += [(-int(scores[i]), ids[docs[i]] is None, ids[docs[i]] or 0) for i in good]
            self.found.sort()
            del self.found[self.top:]
            if len(self.found) == self.top:
                self.least = -self.found[-1][0]  # an equal score with a smaller id still counts


class _Searching:
    """A task's documents in trees, searched by all items of the block."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, docs: int, words: int, top: int):
        self.weight, self.total, self.words = weight, docs, words
        self.scale = np.sqrt(weight.astype(float))
        self.best = [Best(t, weight[t] * c, self.scale, top) for t, c in items]
        self.limit = int(np.clip(LEAF * CELLS // (2 * max(len(weight), 1)), LEAF, TREE_DOCS))
        self.ids: list = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def __call__(self, batch: pa.RecordBatch) -> None:
        size = np.diff(batch["terms"].offsets.to_numpy())
        term, tf = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
        impact = impacts(tf, np.repeat(batch["n"].to_numpy(), size), self.total, self.words)
        some = np.flatnonzero(size > 0)  # a document without a term of the block scores nothing
        ends = np.r_[0, np.cumsum(size)]
        ids = batch["doc_id"].to_pylist()
        for a in range(0, len(some), self.limit):
            rows = some[a:a + self.limit]
            if self.ids and len(self.ids) + len(rows) > self.limit:
                self.flush()
            at = slice(ends[rows[0]], ends[rows[-1] + 1])
            self.ids += [ids[r] for r in rows]
            self.held.append((size[rows], term[at], impact[at]))

    def flush(self) -> None:
        size, term, impact = (np.concatenate(x) for x in zip(*self.held))
        tree = BallTree(size, term, impact, self.scale)
        dense = np.zeros(len(self.weight), np.int64)
        for best in self.best:
            dense[best.term] = best.weight
            best.search(tree, self.ids, dense)
            dense[best.term] = 0
        self.ids, self.held = [], []

    def finish(self) -> dict | None:
        if self.ids:
            self.flush()
        rows = [(q, None if no else i, -s) for q, best in enumerate(self.best) for s, no, i in best.found]
        return {"q": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "score": [r[2] for r in rows]} if rows else None


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of ``docs (doc_id,
    text)`` that score highest, above 0, for each item of ``benchmark (item_id, text)``.

    Equal scores rank by ``doc_id``, null ids last; a document written twice is
    ranked twice. An item written twice (id and text) is one; items of equal id
    and different texts are ranked apart. Null and empty texts have no terms:
    such a document is never found, such an item finds nothing. With either
    table empty there are no rows. A text may be of any length.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs).select("doc_id", "text")
    kind = benchmark.schema["item_id"].dataType
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    words = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(TERM))), F.lit(0))).first()[0]
    blocks = max(1, -(-words // BLOCK_WORDS))
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        counts = [Counter(terms(t)) for t in block["text"].to_pylist()]
        number = {t: i for i, t in enumerate(sorted(set().union(*counts)))} if counts else {}
        part = _block(rows, number, [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts], top)
        names = spark.createDataFrame(list(enumerate(block["item_id"].to_pylist())), f"q int, item_id {kind.simpleString()}")
        part = part.join(F.broadcast(names), "q").select(F.lit(b).alias("block"), "q", "item_id", "doc_id", "score")  # a block's items
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("block", "q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _block(rows: DataFrame, number: dict[bytes, int], items: list[tuple[np.ndarray, np.ndarray]], top: int) -> DataFrame:
    """``q, doc_id, score``: every task's best documents of each item of a block."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(number)

    def counting():
        held = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": [], "n": [], "terms": [], "tf": []}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                found = terms(text)
                if found:
                    own = [(i, c) for t, c in Counter(found).items() if (i := held.get(t)) is not None]
                    out["doc_id"].append(doc_id)
                    out["n"].append(len(found))
                    out["terms"].append([i for i, _ in own])
                    out["tf"].append([c for _, c in own])
            return out

        return work

    counted = stash(map_batches(rows, counting, "doc_id long, n long, terms array<int>, tf array<int>"), "terms")
    docs, words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    seen = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # a block's terms
    df[seen["t"].to_numpy()] = seen["df"].to_numpy()
    weight = np.maximum(weights(df, docs), 0)
    model = spark.sparkContext.broadcast((items, weight))

    def searching():
        return _Searching(*model.value, docs, max(words, 1), top)

    return map_batches(counted, searching, "q int, doc_id long, score long")
