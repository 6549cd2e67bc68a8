"""Substring dedup by sliding spans of consecutive sentences.

A sentence ends after ``.``, ``!`` or ``?`` before white space, or at a line's
end. A span is a run of consecutive sentences that has at least ``MIN_SENTENCES``
sentences and ``MIN_WORDS`` words and no shorter run at its beginning or at its
end that has; a sentence of ``LONG`` words is a span of its own, and a text
without any span is one as a whole. So the runs from each sentence on and the
runs up to each sentence are all there, and the last sentences of a repeated
passage are covered like the first. Spans are compared by a 64-bit hash of their
words (A-Z lower-cased), over all documents. Every sentence covered by a repeated
span goes, but for the span's first occurrence: first in the document of the
smallest id.

A first pass counts each span hash (partial counts before the shuffle, so a
span of a third of all documents is one row for each task). A bitmap of fixed
size then lets the second pass give out only spans that may repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmold.llm.common import NOT_SPACE, map_batches, prepare, run_hashes, stash, texts, utf8, word_hashes

MIN_SENTENCES, MIN_WORDS, LONG = 2, 24, 50
FILTER_BITS = 1 << 25
LAST = (1 << 63) - 1
END = re.compile(rb"\n|[.!?][ \t\r\x0b\x0c]+")


def sentences(text: str) -> list[str]:
    """The text in sentences, each with the white space that follows it."""
    data, out, start = utf8(text), [], 0
    for end in [*(m.end() for m in END.finditer(data)), len(data)]:
        if end > start:
            out.append(data[start:end].decode("utf-8", "surrogatepass"))
        start = end
    return out


def spans(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and sentence after the last of each span. Sentences
    without a word may lie inside a span but don't count for it."""
    data = utf8(text).lower()
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = word_hashes(data)
    word = NOT_SPACE[np.frombuffer(data, np.uint8)]
    words_upto = np.r_[0, np.cumsum(word & ~np.r_[False, word[:-1]])]
    ends = [m.end() for m in END.finditer(data)]
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    bounds = words_upto[np.r_[0, ends]]
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    first, after = bounds[full], bounds[full + 1]
    sentence = run_hashes(hashes, first, after)
    size, upto = after - first, np.r_[first, after[-1:]]
    each = np.arange(len(full))
    ahead = np.where(size >= LONG, each + 1, np.maximum(each + MIN_SENTENCES, np.searchsorted(upto, first + MIN_WORDS)))
    behind = np.where(size >= LONG, each, np.minimum(each + 1 - MIN_SENTENCES, np.searchsorted(upto, after - MIN_WORDS, side="right") - 1))
    pair = np.r_[np.c_[each, ahead][ahead <= len(full)], np.c_[behind, each + 1][behind >= 0]]
    if not len(pair) and len(full):
        pair = np.array([[0, len(full)]])
    a, b = np.unique(pair, axis=0).T if len(pair) else (each[:0], each[:0])
    return run_hashes(sentence, a, b).view(np.int64), full[a], full[b - 1] + 1


def _counting():
    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"span": [], "o": [], "m": []}
        for text, o in zip(batch["text"].to_pylist(), batch["o"].to_pylist()):
            own, m = np.unique(spans(text)[0], return_counts=True)
            out["span"] += own.tolist()
            out["m"] += m.tolist()
            out["o"] += [o] * len(own)
        return out

    return work


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, n_removed, removed, text`` of each row of ``docs
    (doc_id, text)``; ``removed`` has the numbers of the sentences, from 0.

    Null texts stay null, empty ones empty, with no sentences. Where a span's
    smallest id is on several rows, all of these count as its first document; null
    ids come last. Inside the first document, later occurrences go too. An
    empty table gives no rows. A text without repeats comes back unchanged.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs).withColumn("o", F.coalesce("doc_id", F.lit(LAST)))
    repeated = stash(
        map_batches(rows.select("o", "text"), _counting, "span long, o long, m long")
        .groupBy("span").agg(F.min("o").alias("o1"), F.sum("m").alias("m")).where(F.col("m") > 1), "spans")
    at = f"pmod(span, {FILTER_BITS}L)"
    bitmap = repeated.groupBy(F.expr(f"{at} div 32").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} % 32 as int)))").alias("m")).toArrow()
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    filled[bitmap["w"].to_numpy()] = bitmap["m"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(filled)

    def candidates():
        bits = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            row, out = [], {"span": [], "start": [], "end": [], "again": []}
            for r, text in enumerate(batch["text"].to_pylist()):
                h, a, b = spans(text)
                p = h % FILTER_BITS
                hit = np.flatnonzero((bits[p >> 5] >> (p & 31).astype(np.uint32)) & 1)
                if len(hit):
                    own, once = np.unique(h[hit], return_index=True)
                    again = np.ones(len(hit), bool)
                    again[once] = False
                    row += [r] * len(hit)
                    out["span"] += h[hit].tolist()
                    out["start"] += a[hit].tolist()
                    out["end"] += b[hit].tolist()
                    out["again"] += again.tolist()
            few = batch.select(["k1", "k2", "o"]).take(pa.array(row, pa.int64()))
            return {c: few[c] for c in ("k1", "k2", "o")} | out

        return work

    covered = map_batches(rows, candidates, "k1 long, k2 long, o long, span long, start int, end int, again boolean") \
        .join(repeated.select("span", "o1"), "span").where("again or o != o1") \
        .groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("gone"))

    def cut():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch["doc_id"], "n_sentences": [], "n_removed": [], "removed": [], "text": []}
            for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist()):
                found = sentences(text or "")
                off = sorted({i for g in gone or () for i in range(g["start"], g["end"])})
                out["n_sentences"].append(len(found))
                out["n_removed"].append(len(off))
                out["removed"].append(off)
                drop = set(off)
                out["text"].append("".join(s for i, s in enumerate(found) if i not in drop) if off else text)
            return out

        return work

    return map_batches(rows.select("k1", "k2", "doc_id", "text").join(covered, ["k1", "k2"], "left"), cut,
                       "doc_id long, n_sentences long, n_removed long, removed array<int>, text string")
