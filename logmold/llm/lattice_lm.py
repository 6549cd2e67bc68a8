"""Document likelihood under a subword lattice.

The pieces of an existing vocabulary weight every way to cut a word into
pieces; a forward recursion in log space sums over all of them, so a document's
score is its marginal probability, not that of one segmentation. A word depends
on nothing but itself, so the recursion runs once for each distinct word of the
corpus. Beside it, a smoothed word model (``base_score``) is counted on the
training documents.

The pieces' probabilities are learned from the training words by expectation
maximisation: forward and backward recursions give how often each piece is
expected, summed over all words by Spark. A training word is also one arc over
its whole lattice, with its count less ``DISCOUNT``; what the discounts leave
goes to the pieces (absolute discounting), so they learn from distinct words,
each once, as it is rare and new words that they have to spell. The
probabilities of all words add up to 1, known or not.

The vocabulary file keeps merge ranks as scores (0, -1, -2, ...). Zipf's law
makes them the start and the prior: a piece of rank r weighs 1 / (r + ZIPF_SHIFT).
The end of a text has the share that ends have among the training tokens.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmold.llm.common import frequent, lower_words, map_batches, prepare, stash, texts

ZIPF_SHIFT = 2.7
#: Passes over the distinct training words; held-out scores hardly move after them.
PASSES = 3
#: Pieces, dealt by Zipf's law, that count beside those of the training words.
PRIOR = 100.0
#: Part of each training word's count that goes to the pieces.
DISCOUNT = 0.75
#: Bound of the table of frequent words that is sent to all tasks; the words
#: beyond it are looked up by a join.
HOT_WORDS = 200_000
#: Distinct words that a task counts before it passes its counts on.
FLUSH_WORDS = 500_000
SPACE = "▁"


def read_pieces(path: str) -> tuple[dict[str, float], list[float]]:
    """Natural log-probability of each piece, and of each of the 256 bytes
    that spell characters without a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    last = max(-score for _, score in pieces)
    weight = {p: 1 / (-score + ZIPF_SHIFT) for p, score in pieces}
    rare = 1 / (last + 1 + ZIPF_SHIFT)
    total = math.log(sum(weight.values()) + 256 * rare)
    return {p: math.log(w) - total for p, w in weight.items()}, [math.log(rare) - total] * 256


def log_marginal(word: str, pieces: dict[str, float], of_byte: list[float], longest: int) -> float:
    """Natural log of the summed probability of all segmentations of a word:
    the recursion of :class:`Lattice`, for one word."""
    s = SPACE + word
    alpha = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        found = [alpha[i] + p for i in range(max(0, j - longest), j) if (p := pieces.get(s[i:j])) is not None]
        if s[j - 1] not in pieces:
            found.append(alpha[j - 1] + sum(of_byte[b] for b in s[j - 1].encode("utf-8", "surrogatepass")))
        if len(found) == 1:
            alpha[j] = found[0]
        elif found:
            top = max(found)
            alpha[j] = top + math.log(sum([math.exp(x - top) for x in found]))
    return alpha[-1]


class Lattice:
    """All ways to cut many words at once. Pieces are found by a trie whose
    edges ``(node, character)`` are sorted numbers; the recursions take one
    place of all words in a step."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        edges: dict[int, int] = {}
        piece_of = [-1]
        for k, p in enumerate(pieces):
            if "\n" in p:  # parts words below; no word has it
                continue
            node = 0
            for ch in p:
                node = edges.setdefault(node << 21 | ord(ch), len(piece_of))
                if node == len(piece_of):
                    piece_of.append(-1)
            piece_of[node] = k
        self.edges = np.array([*sorted(edges), np.iinfo(np.int64).max])
        self.to = np.array([*(edges[e] for e in sorted(edges)), 0])
        self.piece_of = np.array(piece_of)

    def cut(self, words: list[bytes]) -> Cuts:
        codes = np.frombuffer("".join([SPACE + w.decode("utf-8", "surrogatepass") + "\n" for w in words])
                              .encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        last = np.flatnonzero(codes == 10)
        at = np.flatnonzero(codes != 10)
        whole, spelled = at, np.ones(len(codes), bool)
        node, start, end, piece = np.zeros(len(at), np.int64), [], [], []
        length = 0
        while len(at):
            key = node << 21 | codes[at + length]
            found = np.searchsorted(self.edges, key)
            ok = self.edges[found] == key
            at, node = at[ok], self.to[found[ok]]
            length += 1
            has = self.piece_of[node] >= 0
            start.append(at[has])
            end.append(at[has] + length)
            piece.append(self.piece_of[node[has]])
            if length == 1:
                spelled[at[has]] = False
        rest = whole[spelled[whole]]
        chars, which = np.unique(codes[rest], return_inverse=True)
        return Cuts(np.r_[0, last[:-1] + 1], last, np.concatenate([*start, rest]), np.concatenate([*end, rest + 1]),
                    np.concatenate([*piece, self.n + which]),
                    [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in chars.tolist()])


class Cuts:
    """Pieces ``piece[i]`` from place ``start[i]`` to ``end[i]`` of words that
    stand one after the other. From the number of pieces on, ``piece`` counts
    the characters without one, which their bytes spell."""

    def __init__(self, first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, spelled: list[np.ndarray]):
        self.first, self.last, self.start, self.end, self.piece, self.spelled = first, last, start, end, piece, spelled

    def _steps(self, place: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Order by distance from the word's begin, and where each distance begins."""
        far = place - self.first[np.searchsorted(self.first, place, "right") - 1]
        return np.argsort(far, kind="stable"), [0, *np.cumsum(np.bincount(far)).tolist()]

    def forward(self, log_p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs: of each piece here, and summed over all ways to each place.
        ``log_p`` has ``n`` pieces, then 256 bytes."""
        of = np.concatenate([log_p[:n], [log_p[n:][b].sum() for b in self.spelled]])[self.piece]
        order, bounds = self._steps(self.start)
        start, end, p = self.start[order], self.end[order], of[order]
        alpha = np.full(self.last[-1] + 1, -np.inf)
        alpha[self.first] = 0
        for a, b in zip(bounds, bounds[1:]):  # one begin a word, so no end comes twice
            to = end[a:b]
            alpha[to] = np.logaddexp(alpha[to], alpha[start[a:b]] + p[a:b])
        return of, alpha

    def expected(self, log_p: np.ndarray, n: int) -> np.ndarray:
        """How often each piece and each byte is expected in these words."""
        of, alpha = self.forward(log_p, n)
        order, bounds = self._steps(self.end)
        start, end = self.start[order], self.end[order]
        share = np.exp(alpha[start] + of[order] - alpha[end])
        through = np.zeros(len(alpha))
        through[self.last] = 1
        for a, b in zip(reversed(bounds[:-1]), reversed(bounds[1:])):  # one end a word, so no begin comes twice
            share[a:b] *= through[end[a:b]]
            through[start[a:b]] += share[a:b]
        found = np.bincount(self.piece[order], share, n + len(self.spelled))
        out = np.concatenate([found[:n], np.zeros(256)])
        for b, times in zip(self.spelled, found[n:]):
            np.add.at(out, n + b.astype(np.int64), times)
        return out


class _Expecting:
    """How often each piece is expected in the words that a task saw."""

    def __init__(self, lattice: Lattice, log_p: np.ndarray):
        self.lattice, self.log_p, self.sums = lattice, log_p, np.zeros(len(log_p))

    def __call__(self, batch: pa.RecordBatch) -> None:
        self.sums += self.lattice.cut(batch["word"].to_pylist()).expected(self.log_p, self.lattice.n)

    def finish(self) -> dict:
        at = np.flatnonzero(self.sums)
        return {"piece": at, "times": self.sums[at]}


def learn(words: DataFrame, lattice: Broadcast, prior: np.ndarray, passes: int) -> np.ndarray:
    """Natural log-probabilities of pieces and bytes after ``passes`` steps of
    expectation maximisation over ``words (word)``, each taken once; begins
    with ``prior``, which also counts as ``PRIOR`` pieces."""
    log_p = prior
    for _ in range(passes):
        now = words.sparkSession.sparkContext.broadcast(log_p)
        found = map_batches(words, lambda: _Expecting(lattice.value, now.value), "piece int, times double") \
            .groupBy("piece").agg(F.sum("times").alias("times")).toArrow()
        times = PRIOR * np.exp(prior)
        times[found["piece"].to_numpy()] += found["times"].to_numpy()
        log_p = np.log(times / times.sum())
        now.unpersist()
    return log_p


class _Counting:
    """Training count of each word that a task saw, 0 for those only held out."""

    def __init__(self):
        self.seen: Counter = Counter()

    def __call__(self, batch: pa.RecordBatch) -> dict | None:
        for text, held_out in zip(batch["text"].to_pylist(), batch["held_out"].to_pylist()):
            found = lower_words(text)
            if held_out:
                for w in set(found):
                    self.seen.setdefault(w, 0)
            else:
                self.seen.update(found)
        return self.finish() if len(self.seen) > FLUSH_WORDS else None

    def finish(self) -> dict | None:
        out = {"word": list(self.seen), "c": list(self.seen.values())}
        self.seen = Counter()
        return out if out["word"] else None


def score_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: ``doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score``.

    Learned from the rows whose crc32 of the id as text isn't 1 modulo 5 (a
    null id counts as 0). Null and empty texts are one end token. Repeated
    rows count each time in training and get equal scores. With no training
    rows the word model knows nothing, pieces have their prior and the end has
    probability 1/2. An empty table gives no rows. Counts cover all texts; nothing is sampled.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs).withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)))
    pieces, of_byte = read_pieces(model_path)
    lattice = spark.sparkContext.broadcast(Lattice(list(pieces)))
    counted = stash(map_batches(rows.select("text", "held_out"), _Counting, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    learned = spark.sparkContext.broadcast(
        learn(counted.where("c > 0").select("word"), lattice, np.array([*pieces.values(), *of_byte]), PASSES if v else 0))
    to_pieces = math.log(DISCOUNT * v / n) if v else 0.0

    def marginals():
        cuts, log_p = lattice.value, learned.value

        def work(batch: pa.RecordBatch) -> dict:
            found = cuts.cut(batch["word"].to_pylist())
            spelled = found.forward(log_p, cuts.n)[1][found.last] + to_pieces
            c = batch["c"].to_numpy()
            whole = np.log(np.maximum(c - DISCOUNT, 0) / max(n, 1), out=np.full(len(c), -np.inf), where=c > 0)
            return {"word": batch["word"], "c": batch["c"], "lattice": pa.array(np.logaddexp(whole, spelled) / math.log(10))}

        return work

    vocabulary = stash(map_batches(counted, marginals, "word binary, c long, lattice double"), "words")
    ends = rows.where("not held_out").count()
    train, distinct = n + ends, v + (ends > 0)
    spread = train + 0.5 * (distinct + 1)
    end = ends / train if train else 0.5
    end_base, end_lattice = math.log10((ends + 0.5) / spread), math.log10(end if 0 < end else 0.5)
    go_on = math.log10(1 - end) if end < 1 else math.log10(0.5)

    table = frequent(vocabulary, "c", HOT_WORDS).toArrow()
    c = table["c"].to_numpy().astype(np.float64)
    hot = spark.sparkContext.broadcast((
        dict(zip(table["word"].to_pylist(), range(len(c)))), np.log10((c + 0.5) / spread), table["lattice"].to_numpy() + go_on, c > 0))

    def known():
        number, base, lattice, seen = hot.value

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"k1": batch["k1"], "k2": batch["k2"], "doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                    "n": [], "n_known": [], "base": [], "lattice": []}
            for text in batch["text"].to_pylist():
                found = lower_words(text)
                at = np.fromiter((number.get(w, -1) for w in found), np.int64, len(found))
                at = at[at >= 0]
                out["n"].append(len(found))
                out["n_known"].append(int(seen[at].sum()))
                out["base"].append(float(base[at].sum()))
                out["lattice"].append(float(lattice[at].sum()))
            return out

        return work

    def others():
        number = hot.value[0]

        def work(batch: pa.RecordBatch) -> dict:
            row, word, times = [], [], []
            for r, text in enumerate(batch["text"].to_pylist()):
                rare = Counter(w for w in lower_words(text) if w not in number)
                row += [r] * len(rare)
                word += rare.keys()
                times += rare.values()
            few = batch.select(["k1", "k2"]).take(pa.array(row, pa.int64()))
            return {"k1": few["k1"], "k2": few["k2"], "word": word, "times": times}

        return work

    partial = map_batches(rows, known, "k1 long, k2 long, doc_id long, held_out boolean, n long, n_known long, base double, lattice double")
    rare = map_batches(rows.select("k1", "k2", "text"), others, "k1 long, k2 long, word binary, times long") \
        .repartition("word").groupBy("word", "k1", "k2").agg(F.max("times").alias("times"))
    rest = rare.join(vocabulary, "word").groupBy("k1", "k2").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(spread))).alias("more_base"),
        F.sum(F.col("times") * (F.col("lattice") + F.lit(go_on))).alias("more_lattice"))
    return partial.join(rest, ["k1", "k2"], "left").select(
        "doc_id", "held_out", (F.col("n") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(end_base)).alias("base_score"),
        (F.col("lattice") + F.coalesce("more_lattice", F.lit(0.0)) + F.lit(end_lattice)).alias("score"))
