"""Helpers that the corpus operators share.

Row identity: ``doc_id`` may be null or repeated, so operators that have to
bring a decision back to its row use :func:`row_key`, 128 bits of
``(doc_id, text)``. Rows that agree in both are the same row written twice and
get the same decision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmold.session import ensure_checkpoint_dir, settle, ship_package, stash  # noqa: F401 (settle, stash: for the operators)

#: Rows in one Arrow batch that goes to a Python worker: bounds its memory
#: also where every text is long.
BATCH_ROWS = 256

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> None:
    """Shared folder, worker code and batch size for the Python stages."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """``k1``, ``k2``: 128 bits that identify a row by id and text; never null."""
    doc_id, text = doc_id.cast("long"), text.cast("string")
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit(7)).alias("k2")]


def whole_rows(docs: DataFrame) -> DataFrame:
    """``k1, k2`` and ``row``, a struct of all columns whatever their names."""
    return docs.select(*row_key(F.col("doc_id"), F.col("text")), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``k1, k2, doc_id, text`` and ``more``; other columns of any name stay out."""
    return docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), *[F.col(c) for c in more])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with one function per task. ``make()`` builds it; it gets
    a batch and returns columns (or None); ``schema`` is the Spark DDL."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip((out[f.name] for f in arrow), arrow)],
                    schema=arrow)
        if (last := getattr(work, "finish", None)) and (out := last()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, fields)


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes, A-Z lower-cased: ``bytes.split``
    parts at exactly these six characters, ``bytes.lower`` changes ASCII only."""
    return utf8(text).lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words, in order; none if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    x = np.full(count, np.uint64(n), np.uint64)
    for i in range(n):
        x = (x ^ hashes[i:i + count]) * STEP
        x ^= x >> np.uint64(29)
    return mix(x)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; with fewer words the whole sequence
    as one; none without words."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(ngrams(hashes, min(n, len(hashes))))


def _size_class(count: str) -> Column:
    """Counts in rising classes: exact below 4096, then 64 classes for each doubling."""
    c = F.col(count)
    return F.when(c < 4096, c).otherwise(4096 + F.floor(F.log2(c / 4096) * 64)).cast("long")


def frequent(counted: DataFrame, count: str, most: int, key: str = "word") -> DataFrame:
    """The rows of the highest counts, at most ``most``, and all rows if there
    are no more. No sort, no single task, and no count is clipped.

    Whole classes of counts are taken from the top down. Of the first class
    that doesn't fit, as many rows as there is room for are taken by the
    hash of ``key``, in ranges of 16 bits, refined until the room is used.
    """
    df = counted.withColumns({"_class": _size_class(count), "_hash": F.shiftrightunsigned(F.xxhash64(key), 1)})
    held = df.groupBy("_class").agg(F.count("*").alias("m")).collect()  # at most 4096 + 64 * 51 rows
    room, cut = most, None
    for c, m in sorted(((r["_class"], r["m"]) for r in held), reverse=True):
        if m > room:
            cut = c
            break
        room -= m
    if cut is None:
        return counted
    inside, low, bound = df.where(F.col("_class") == cut), 0, 0
    for shift in (47, 31, 15):
        part = inside.where(f"shiftrightunsigned(_hash, {shift + 16}) = {low >> 16}L") if shift < 47 else inside
        held = part.groupBy(F.expr(f"shiftrightunsigned(_hash, {shift})").alias("r")).agg(F.count("*").alias("m")).collect()
        for r, m in sorted((r["r"], r["m"]) for r in held):
            low = r
            if m > room:
                break
            room, bound = room - m, (r + 1) << shift
        if bound:
            break
        low <<= 16
    return df.where((F.col("_class") > cut) | ((F.col("_class") == cut) & (F.col("_hash") < F.lit(bound)))).drop("_class", "_hash")


def groups_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[c].to_numpy(zero_copy_only=False) for c in by]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        begin = 0
        for end in [*cuts.tolist(), batch.num_rows]:
            key = tuple(c[begin] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield pa.Table.from_batches(held)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = np.full(max(n, 2 * len(self.up)), STEP)
            base[0] = 1
            self.up = np.cumprod(base, dtype=np.uint64)
            base[1:] = pow(int(STEP), -1, 1 << 64)
            self.down = np.cumprod(base, dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run ``values[start:end]`` of random 64-bit values, all at
    once: differences of the prefix sums of a polynomial."""
    up, down = POWERS.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * MIX_A)


NOT_SPACE = ~np.isin(np.arange(256), [32, *range(9, 14)])
PIECE = 1 << 20


def word_hashes(data: bytes, inside: np.ndarray = NOT_SPACE) -> np.ndarray:
    """64-bit hash of each word of a UTF-8 text, all at once; ``inside`` says
    which bytes belong to words. Long texts go in pieces cut between words."""
    out, start = [], 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and inside[data[end]]:
            end += 1
        piece = np.frombuffer(data, np.uint8, end - start, start)
        word = inside[piece]
        edge = np.flatnonzero(np.r_[word, False] != np.r_[False, word])
        out.append(run_hashes(OF_BYTE[piece], edge[::2], edge[1::2]))
        start = end
    return np.concatenate([np.empty(0, np.uint64), *out])


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def lower_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased
    (``bytes.lower`` changes ASCII only)."""
    return word_hashes(utf8(text).lower())


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node in ``edges (u, v)`` (longs); root is the
    smallest node reachable.

    Alternating large-star and small-star steps: each round is two joins on
    the minimum of a node's neighbours, no neighbour list is ever gathered,
    and the table is written to the shared folder in between.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def print_of(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(3)))).first()

    now = stash(oriented(edges), name)
    mark = print_of(now)
    for _ in range(rounds if mark[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = stash(oriented(small.unionByName(low.select("u", F.col("m").alias("v")))), name)
        last, mark = mark, print_of(now)
        settle(now.sparkSession)
        if last == mark:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
