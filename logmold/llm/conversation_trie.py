"""Prefix trie of conversations, built as burst tries.

A conversation is a sequence of turns (role, text); a node of the trie is a
distinct prefix. Nodes are told apart by 128 bits of hash of the prefix.

1. Turns become numbers (hashes and text sizes) before anything moves; each
   conversation is one row with the hash of each of its prefixes.
2. Equal conversations are one sequence: their ids are counted, and digested
   in order, by chunks of ids and then chunk by chunk, so that a third of all
   conversations may be the same one.
3. All sequences start in one container under the root. A container of more
   than ``MAX_TURNS`` turns bursts: its trie head becomes a node of its own, and
   the sequences go to containers by their next turn. ``LEVELS`` levels are
   settled by one count of prefixes, so a long shared beginning takes few rounds.
4. The remaining containers are dealt out by head, and a task sorts each and
   sweeps it once: what a sequence shares with the one before it stays on the
   stack, the rest of the stack is finished, node by node.
5. What is below a burst head is summed up over the containers under it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmold.llm.common import groups_of, map_batches, prepare, run_hashes, settle, stash

#: Turns below its head that a container of several sequences may hold.
MAX_TURNS = 1 << 16
#: Levels that one round of bursting settles.
LEVELS = 8
#: Ids in one chunk of a digest: two to this power.
CHUNK_BITS = 12
#: Contract: share of borrowed turns, and the conversation that they come from.
HEAD_MOD, SOURCE_MOD = 9, 5

NO_ENDS = hashlib.sha256(b"").hexdigest()
SEQUENCE = "conv_id long, n long, ends string, p1 array<long>, p2 array<long>, bytes array<int>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as two hashes and the text's size."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    numbers = F.struct(F.col("turn"), F.xxhash64(role, text).alias("t1"), F.xxhash64(text, F.lit(11), role).alias("t2"),
                       F.octet_length(text).alias("bytes"))
    return conversations.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(numbers)).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the first h turns of conversation ``conv_id - conv_id % 5``, then
    the conversation's own after its first h; h = crc32(decimal id) % 9."""
    own = turns_of(conversations)
    source = own.select(F.col("conv_id").alias("of"), F.col("turns").alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_MOD).cast("int")
    both = own.join(source, F.col("conv_id") - F.col("conv_id") % SOURCE_MOD == F.col("of"), "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), none),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def _prefixes():
    """Hash of each prefix of each row, from the empty one on, in two lanes."""
    def work(batch: pa.RecordBatch) -> dict:
        turns = batch["turns"]
        size = np.diff(turns.offsets.to_numpy())
        begin = np.cumsum(size) - size
        each = turns.flatten()
        row = np.repeat(np.arange(len(size)), size + 1)
        start = begin[row]
        end = start + np.arange(len(row)) - np.r_[0, np.cumsum(size + 1)[:-1]][row]
        ends = np.r_[0, np.cumsum(size + 1)].astype(np.int32)
        lane = {p: pa.ListArray.from_arrays(pa.array(ends), pa.array(run_hashes(
            each.field(t).to_numpy(zero_copy_only=False).view(np.uint64), start, end).view(np.int64))) for p, t in (("p1", "t1"), ("p2", "t2"))}
        held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), each.field("bytes"))
        return {"conv_id": batch["conv_id"], "bytes": held} | lane

    return work


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence from the chunks of its ids, in order: only the
    running digest is held."""
    last, digest, out = None, None, []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": c, "n": n, "ends": d.hexdigest()} for _, c, n, d in out], schema=pa.schema(
            [("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())]))

    for batch in batches:
        for r in batch.to_pylist():
            if (r["e1"], r["e2"]) != last:
                last, digest = (r["e1"], r["e2"]), hashlib.sha256()
                if len(out) > 50_000:
                    yield done()
                    out = []
                out.append([last, r["least"], 0, digest])
            else:
                digest.update(b",")
            digest.update(r["ids"].encode())
            out[-1][2] += r["m"]
    if out:
        yield done()


def sequences(conversations: DataFrame) -> DataFrame:
    """One row for each distinct rebuilt conversation, written once: its smallest id, how
    many there are, the digest of their ids, and its prefix hashes and text sizes."""
    every = stash(map_batches(rebuilt(conversations), _prefixes, "conv_id long, p1 array<long>, p2 array<long>, bytes array<int>"), "prefixes")
    chunks = every.groupBy(F.element_at("p1", -1).alias("e1"), F.element_at("p2", -1).alias("e2"), F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"), F.count("*").alias("m"), F.min("conv_id").alias("least"))
    ends = chunks.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "chunk").mapInArrow(_digests, "conv_id long, n long, ends string")
    return stash(ends.join(every, "conv_id").select("conv_id", "n", "ends", "p1", "p2", "bytes"), "sequences")


def _burst(seqs: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Heads of burst containers, the children of all prefixes that were counted, and
    ``conv_id, at``: the depth at which each sequence's container begins (null: it ends at a head)."""
    live, heads, children, placed, base = seqs, [], [], None, 0
    while True:
        levels = F.sequence(F.lit(base), F.least(F.size("bytes"), F.lit(base + LEVELS - 1)))
        entries = live.select("conv_id", "n", "p1", "p2", "bytes", F.explode(levels).alias("depth"))
        at = lambda a, i: F.get(a, i)
        depth = F.col("depth")
        entries = entries.select("conv_id", "n", "depth", (F.size("bytes") - depth).alias("below"), at("p1", depth).alias("p1"), at("p2", depth).alias("p2"),
                                 at("p1", depth - 1).alias("q1"), at("p2", depth - 1).alias("q2"), at("bytes", depth - 1).alias("last"))
        counted = stash(entries.groupBy("depth", "p1", "p2", "q1", "q2").agg(
            F.count("*").alias("m"), F.sum("below").alias("weight"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("last").alias("last")), "prefix-counts")
        big = counted.where((F.col("m") > 1) & (F.col("weight") > most))
        heads.append(big)
        children.append(counted.where("depth > 0").select("q1", "q2"))
        # what is over the limit is so with all its beginnings: the deepest head tells a sequence's container
        deepest = entries.select("conv_id", "depth", "p1", "p2").join(big.select("depth", "p1", "p2"), ["depth", "p1", "p2"]).groupBy("conv_id").agg(F.max("depth").alias("deepest"))
        settled = stash(live.select("conv_id", F.size("bytes").alias("size")).join(deepest, "conv_id", "left").select(
            "conv_id", "size", (F.coalesce("deepest", F.lit(base - 1)) + 1).alias("at")), "containers")
        on = (F.col("at") == base + LEVELS) & (F.col("size") >= base + LEVELS)
        now = settled.where(~on).select("conv_id", F.when(F.col("at") <= F.col("size"), F.col("at")).alias("at"))
        placed = now if placed is None else placed.unionByName(now)
        more = settled.where(on).select("conv_id")
        if more.isEmpty():
            return heads, children, placed
        live, base = seqs.join(more, "conv_id", "left_semi"), base + LEVELS
        settle(seqs.sparkSession)


NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def sweep(rows: list[tuple]) -> dict[str, list]:
    """Nodes of one container from its sequences ``(path, n, conv_id, ends, bytes, depth of the
    head)``; a path has the prefixes from the head on. Parents stand before their children's rows."""
    out: dict[str, list] = {c.split()[0]: [] for c in NODE.split(", ")}
    parents: list[int] = []
    stack: list[int] = []
    sizes: list[int] = []
    last: tuple = ()

    def close(node: int) -> None:
        out["n_leaves"][node] += out["n_children"][node] == 0
        out["saved_tokens"][node] += (out["n_convs"][node] - 1) * sizes[node]
        if (up := parents[node]) >= 0:
            out["conv_id"][up] = min(out["conv_id"][up], out["conv_id"][node])
            for c in ("n_convs", "n_leaves", "saved_tokens"):
                out[c][up] += out[c][node]

    for path, n, conv_id, ends, size, head in sorted(rows):
        shared = 0
        while shared < min(len(last), len(path)) and last[shared] == path[shared]:
            shared += 1
        while len(stack) > shared:
            close(stack.pop())
        for k in range(shared, len(path)):
            parents.append(stack[-1] if stack else -1)
            if stack:
                out["n_children"][stack[-1]] += 1
            stack.append(len(parents) - 1)
            sizes.append(size[head + k - 1] if head + k else 0)
            for c, v in (("conv_id", conv_id), ("depth", head + k), ("parent_conv_id", None), ("n_convs", 0), ("n_children", 0),
                         ("n_leaves", 0), ("saved_tokens", 0), ("ends", NO_ENDS)):
                out[c].append(v)
        node = stack[-1]
        out["n_convs"][node] += n
        out["conv_id"][node] = min(out["conv_id"][node], conv_id)
        out["ends"][node] = ends
        last = path
    while stack:
        close(stack.pop())
    out["parent_conv_id"] = [out["conv_id"][p] if p >= 0 else None for p in parents]
    return out


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each container, in batches; the first row of each has the prefixes above it."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("a1", pa.list_(pa.int64())), ("a2", pa.list_(pa.int64()))])
    for group in groups_of(batches, ["h1", "h2"]):
        rows, above = [], None
        for r in group.to_pylist():
            above = above or (r["p1"][:r["at"]], r["p2"][:r["at"]])
            rows.append((tuple(zip(r["p1"][r["at"]:], r["p2"][r["at"]:])), r["n"], r["conv_id"], r["ends"], r["bytes"], r["at"]))
        nodes = sweep(rows)
        none: list = [None] * (len(nodes["depth"]) - 1)
        yield pa.RecordBatch.from_pydict(nodes | {"a1": [above[0], *none], "a2": [above[1], *none]}, schema=schema)


def prefix_trie(conversations: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` of each node of the trie of rebuilt ``conversations (conv_id, turn, role, text)``.

    Null roles and texts are empty; null turns come first, and equal turns in
    the order of their hashes (a turn written twice is two turns). Rows
    without a ``conv_id`` belong to no conversation. A conversation left without
    turns ends at the root. An empty table has no nodes. One conversation's
    numbers (not its texts) are held in memory, so its turns may be many, but
    not a large share of a huge table.
    """
    spark = conversations.sparkSession
    prepare(spark)
    seqs = sequences(conversations)
    heads, children, placed = _burst(seqs, max_turns)
    placed = stash(placed, "placed")
    boxed = seqs.join(placed.where("at is not null"), "conv_id").withColumns({"h1": F.get("p1", F.col("at")), "h2": F.get("p2", F.col("at"))})
    swept = stash(boxed.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(_swept, f"{NODE}, a1 array<long>, a2 array<long>"), "nodes")
    every = heads[0]
    for more in heads[1:]:
        every = every.unionByName(more)
    top = every.select("conv_id", "depth", "n_convs", "p1", "p2", "q1", "q2", ((F.col("n_convs") - 1) * F.coalesce("last", F.lit(0))).alias("own"))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    if top.isEmpty():
        return swept.select(*result)

    # below the heads: sums over the containers, and over the heads themselves
    path = top.select("conv_id", "depth", "own").join(seqs.select("conv_id", "p1", "p2"), "conv_id").select(
        F.lit(0).cast("long").alias("leaves"), F.col("own").alias("saved"), F.explode(F.arrays_zip(
            F.slice("p1", F.lit(1), F.col("depth") + 1).alias("p1"), F.slice("p2", F.lit(1), F.col("depth") + 1).alias("p2"))).alias("x"))
    tops = swept.where("size(a1) > 0")
    below = tops.select(F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"),
                        F.explode(F.arrays_zip(F.col("a1").alias("p1"), F.col("a2").alias("p2"))).alias("x"))
    sums = path.unionByName(below).groupBy("x.p1", "x.p2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    kids = children[0]
    for more in children[1:]:
        kids = kids.unionByName(more)
    kids = kids.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    ends = seqs.join(placed.where("at is null"), "conv_id").select(F.element_at("p1", -1).alias("p1"), F.element_at("p2", -1).alias("p2"), "ends")
    up = top.select(F.col("conv_id").alias("parent_conv_id"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    of_heads = (top.join(sums, ["p1", "p2"]).join(kids, ["p1", "p2"]).join(ends, ["p1", "p2"], "left").join(up, ["q1", "q2"], "left")
                .withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))).select(*result))
    inner = swept.where("a1 is null or size(a1) = 0").select(*result)
    under = tops.drop("parent_conv_id").withColumns({"q1": F.element_at("a1", -1), "q2": F.element_at("a2", -1)}).join(up, ["q1", "q2"]).select(*result)
    return of_heads.unionByName(inner).unionByName(under)
