"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct 5-word shingles. Documents are linked when
``100 * intersection >= least * union``; groups are the connected components.

1. Each text gets a digest of its set and a signature of ``CHUNKS * WIDTH``
   symbols, the low 8 bits of as many MinHash values. Equal sets are one class.
2. Multi-index: the signature is split into ``CHUNKS`` chunks, and ``ERRORS``
   wrong symbol in a chunk is enumerated by leaving out each of its symbols in
   turn. By the pigeonhole principle two signatures that differ in at most
   ``CHUNKS * (ERRORS + 1) - 1 = 23`` of the 84 symbols agree on one of these
   keys. (At a similarity of 0.85 a pair shares none with a chance of 3e-7, at
   0.80 of 3e-5; below that the signature is too short.)
3. Classes that meet under a key are compared by signature distance, a block
   of a key's members against a block at a time. A task gives a spanning
   forest of the pairs within ``LIMIT``, never the pairs: its output is linear
   in the members.
4. The forest's components (families) are small; within a family, again by
   blocks, an inverted index over the full shingle sets gives every exact
   intersection, and a task gives a spanning forest of the true links.
5. The components of the true links, spread back over classes and rows.

Nothing is dropped for size: large keys and families go by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmold.llm.common import components, groups_of, lower_hashes, map_batches, mix, prepare, shingles, stash, texts, whole_rows

SHINGLE = 5
#: Similarity of a link, in hundredths, unless given.
LEAST = 85
CHUNKS, WIDTH, ERRORS = 12, 7, 1
SYMBOLS = CHUNKS * WIDTH
#: Distance up to which classes that share a key are taken to one family.
#: Above the guaranteed 23, so that a link whose signatures differ more than
#: usual isn't lost (84 symbols, similarity 0.85: mean 12.6, deviation 3.3).
LIMIT = 34
#: Members of a key, and shingles of a family, in one block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 20
#: Bits of the filter that tells which texts are read again.
FILTER_BITS = 1 << 24

_RANDOM = np.random.default_rng(20240501)
MULTIPLIERS = _RANDOM.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` bytes: the low 8 bits of as many MinHash values."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingle_set), 1 << 14):
        low = np.minimum(low, (shingle_set[None, i:i + (1 << 14)] * MULTIPLIERS[:, None] + OFFSETS[:, None]).min(axis=1))
    return (mix(low) & np.uint64(0xFF)).astype(np.uint8)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * WIDTH) keys: a chunk with one symbol left out; 48 bits
    of symbols below the number of chunk and gap, so keys never collide."""
    parts = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.int64)
    keys = np.empty((len(signatures), CHUNKS, WIDTH), np.int64)
    for gap in range(WIDTH):
        x = np.zeros((len(signatures), CHUNKS), np.int64)
        for i in range(WIDTH):
            if i != gap:
                x = (x << 8) | parts[:, :, i]
        keys[:, :, gap] = x + ((np.arange(CHUNKS) * WIDTH + gap) << 48)
    return keys.reshape(len(signatures), -1)


def _describe():
    def work(batch: pa.RecordBatch) -> dict:
        out = {"k1": batch["k1"], "k2": batch["k2"], "doc_id": batch["doc_id"], "n": [], "digest": [], "sig": []}
        for text in batch["text"].to_pylist():
            s = shingles(lower_hashes(text), SHINGLE)
            out["n"].append(len(s))
            out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()))
            out["sig"].append(signature(s).tobytes() if len(s) else None)
        return out

    return work


def _keys():
    def work(batch: pa.RecordBatch) -> dict:
        sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(-1, SYMBOLS)
        keys = index_keys(sig)
        return {"key": pa.array(keys.ravel()), "cid": pa.array(np.repeat(batch["cid"].to_numpy(), keys.shape[1]))}

    return work


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) of a symmetric relation's components, roots left out."""
    left, out = np.ones(len(near), bool), []
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            found = np.flatnonzero(near[todo.pop()] & left)
            left[found] = False
            out += [(int(x), start) for x in found]
            todo += found.tolist()
    return out


def near_by_signature(sig: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Symmetric boolean matrix: signatures that differ in at most ``limit`` symbols."""
    far = np.zeros((len(sig), len(sig)), np.uint8)
    for i in range(sig.shape[1]):
        far += sig[:, None, i] != sig[None, :, i]
    return far <= limit


def set_forest(sets: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(member, root) of the groups that links make, roots left out: sets are
    linked with 100 * intersection >= least * union.

    From each new root on, a set is compared with those that are still left, by
    an inverted index over their shingles, which is built anew when half of
    them are gone. What it links to is left no more: a group of near copies
    goes in one step, and memory is that of the shingles, never of pairs.
    """
    n = np.array([len(s) for s in sets], np.int64)
    left = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    rest, indexed = len(sets), 0
    values = starts = counts = owner = np.empty(0, np.int64)
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        rest -= 1
        while todo and rest:
            if 2 * rest < indexed or not indexed:
                held = np.flatnonzero(left)
                everything, owner = np.concatenate([sets[i] for i in held]), np.repeat(held, n[held])
                order = np.argsort(everything, kind="stable")
                everything, owner = everything[order], owner[order]
                starts = np.flatnonzero(np.r_[True, everything[1:] != everything[:-1]])
                values, counts, indexed = everything[starts], np.diff(np.r_[starts, len(everything)]), rest
            i = todo.pop()
            at = np.searchsorted(values, sets[i])
            at = at[np.append(values, 0)[at] == sets[i]]
            at = at[at < len(values)]
            c = counts[at]
            steps = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            met, both = np.unique(owner[np.repeat(starts[at], c) + steps], return_counts=True)
            found = met[left[met] & (100 * both >= least * (n[met] + n[i] - both))]
            left[found] = False
            rest -= len(found)
            out += [(int(x), start) for x in found]
            todo += found.tolist()
    return out


def _edges(cids: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    return [(int(cids[a]), int(cids[b])) for a, b in _forest(near)]


def _by_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for group in groups_of(batches, ["x1", "x2", "bi", "bj"]):
        if group.num_rows > 1:
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            out += _edges(group["cid"].to_numpy(), near_by_signature(sig))
        if len(out) > 50_000:
            yield _pairs(out)
            out = []
    yield _pairs(out)


def _by_sets(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in groups_of(batches, ["family", "bi", "bj"]):
            if group.num_rows > 1:
                cids = group["cid"].to_numpy()
                out += [(int(cids[a]), int(cids[b])) for a, b in set_forest([np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()], least)]
        yield _pairs(out)

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["u", "v"])


def _blocks(df: DataFrame, blocks: str) -> DataFrame:
    """One row for each pair of blocks that a member belongs to; a single block
    gives one row."""
    return df.withColumn("b", F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")).withColumn(
        "o", F.explode(F.when((F.col(blocks) == 1), F.array(F.lit(0))).otherwise(
            F.expr(f"filter(sequence(0, cast({blocks} as int) - 1), x -> x != b)")))
    ).withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("b", "o")


def _wanted(spark, keys: DataFrame):
    """A bitmap of ``FILTER_BITS`` with a bit set for each ``k1`` in ``keys``:
    of fixed size whatever the number of rows."""
    at = f"pmod(k1, {FILTER_BITS}L)"
    words = keys.groupBy(F.expr(f"{at} div 32").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} % 32 as int)))").alias("m")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(bits)


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``k1, k2, doc_id, n_shingles, component_id, kept, keeper`` per row of
    ``docs (doc_id, text)``. ``least`` is from 80 on.

    ``component_id`` is the smallest ``doc_id`` of the group; ``kept`` says
    whether the row's id is that; ``keeper`` marks the rows of exactly one
    (id, text) in each group. Null or empty texts have an empty set, link with
    nothing and are each kept. A null ``doc_id`` is never the smallest unless
    all ids of its group are null; its ``component_id`` is then null and
    ``kept`` true. Repeated rows link with each other and share ``kept``. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = stash(map_batches(texts(docs), _describe,
                             "k1 long, k2 long, doc_id long, n long, digest binary, sig binary"), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2"))
    classes = stash(
        rows.where("n > 0").groupBy("digest").agg(F.first("sig").alias("sig"), F.first("n").alias("n"), best.alias("best"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")

    # keys -> members of keys that several classes share, each set of members once
    keys = map_batches(classes.select("cid", "sig"), _keys, "key long, cid long")
    several = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(cid))").alias("x1"),
        F.expr("bit_xor(xxhash64(cid, 5))").alias("x2")).where("m > 1")
    shared = keys.join(several, "key").select("x1", "x2", "m", "cid").distinct()
    met = _blocks(shared.withColumn("nb", F.ceil(F.col("m") / BLOCK_MEMBERS)), "nb").join(classes.select("cid", "sig"), "cid")
    by = ["x1", "x2", "bi", "bj"]
    near = met.select(*by, "cid", "sig").repartition(*by).sortWithinPartitions(*by, "cid").mapInArrow(_by_signature, "u long, v long")
    families = components(near, "families")

    # exact links inside each family, on the full sets of its classes' texts
    found = (families.select(F.col("node").alias("cid"), F.col("root").alias("family"))
             .join(classes.select("cid", "n", "best.k1", "best.k2"), "cid"))
    size = found.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("nb"))
    members = stash(found.join(size, "family"), "members")
    wanted = _wanted(spark, members)

    def grams():
        bits = wanted.value

        def work(batch: pa.RecordBatch) -> dict | None:
            at = np.mod(batch["k1"].to_numpy(), FILTER_BITS)
            hit = np.flatnonzero((bits[at // 32] >> (at % 32).astype(np.uint32)) & 1)
            if not len(hit):
                return None
            few = batch.take(pa.array(hit))
            return {"k1": few["k1"], "k2": few["k2"],
                    "grams": [shingles(lower_hashes(t), SHINGLE).tobytes() for t in few["text"].to_pylist()]}

        return work

    sets = map_batches(texts(docs), grams, "k1 long, k2 long, grams binary")
    by = ["family", "bi", "bj"]
    links = (_blocks(members.join(sets, ["k1", "k2"]), "nb").select(*by, "cid", "grams")
             .repartition(*by).sortWithinPartitions(*by, "cid").mapInArrow(_by_sets(least), "u long, v long"))
    roots = components(links, "links")

    # the group's row and id for each class, then for each row
    labelled = classes.select("digest", "cid", "best").join(roots.withColumnRenamed("node", "cid"), "cid", "left") \
        .withColumn("root", F.coalesce("root", "cid"))
    top = labelled.groupBy("root").agg(F.min("best").alias("top"))
    labels = labelled.join(top, "root").select("digest", "top")
    return rows.where("n > 0").join(labels, "digest").select(
        "k1", "k2", "doc_id", F.col("n").alias("n_shingles"), F.col("top.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("top.doc_id")).alias("kept"),
        ((F.col("k1") == F.col("top.k1")) & (F.col("k2") == F.col("top.k2"))).alias("keeper"),
    ).unionByName(rows.where("n = 0").select(
        "k1", "k2", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(True).alias("kept"), F.lit(True).alias("keeper")))


def keep_one(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that stay: one of each near-duplicate group, with
    all their columns. Repeated rows are one; texts without words all stay,
    each (id, text) once."""
    stay = near_duplicates(docs, least).where("keeper").select("k1", "k2").distinct()
    return whole_rows(docs).join(stay, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")
