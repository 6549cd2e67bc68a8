"""Line dedup by a log-template tree, in DataFrame operations only.

A line goes down a tree of fixed depth: its number of words, then its first
``DEPTH`` words; words with a digit are variable fields. In a leaf, a word is
constant at its place if at least ``MIN_DOCS`` lines of the leaf have it there, and
``SUPPORT`` hundredths of them, else a variable field: a share, so that the values
of a field don't become constants as the leaf grows. A line whose constants make up ``CONSTANT`` of its words
belongs to the template of those constants; any other line is its own template.
A template found in at least ``MIN_DOCS`` documents is recurring: its lines are
dropped, but for those of the first document (smallest id) that has it, so that
a text isn't lost with all its copies.

Plan: leaves with fewer than ``MIN_DOCS`` lines can't recur, so a first pass
counts leaves only (64-bit hashes); a bitmap of fixed size lets the second pass
drop almost all other lines before anything moves; distinct lines, not lines,
are cut into words; every count is a two-step aggregate on hashes, and no list
is ever gathered but the positions of one document's dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmold.llm.common import row_key, stash, whole_rows
from logmold.session import ensure_checkpoint_dir

DEPTH = 3
MIN_DOCS = 3
#: Share of constant words, in hundredths, from which a line is generalised.
CONSTANT = 60
#: Share of a leaf's lines, in hundredths, from which a word is constant at its place.
SUPPORT = 1
#: Lines of fewer words are left alone: headings, and words on lines of their own.
MIN_WORDS = 3
#: Bits of the leaf filter: 2^17 words of 64 bits, 2 MB when broadcast.
FILTER_BITS = 1 << 23

WORD = r"[^\x20\x09-\x0D]+"
FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _masked(text: Column) -> Column:
    return F.regexp_replace(text, FIELD, "<*>")


def _count(line: Column) -> Column:
    """Words of a line: by its spaces where they are single and inside, which
    is many times cheaper, else by matching them."""
    plain = ~line.rlike(r"[\x09-\x0D]|\x20\x20|^\x20|\x20\z") & (line != "")
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(plain, spaces + 1).otherwise(F.regexp_count(line, F.lit(WORD)))


def _bit(leaf: str) -> tuple[Column, Column]:
    return F.expr(f"pmod({leaf}, {FILTER_BITS}L) div 64"), F.expr(f"shiftleft(1L, cast(pmod({leaf}, 64L) as int))")


def _lines(docs: DataFrame) -> DataFrame:
    """``k1, k2, o, pos, line, n, leaf`` of each line with enough words."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))

    def leaf(n: Column, line: Column) -> Column:
        head = F.regexp_extract(line, rf"{WORD}(?:[\x20\x09-\x0D]+{WORD}){{0,{DEPTH - 1}}}", 0)
        return F.xxhash64(n, F.regexp_replace(_masked(head), r"[\x20\x09-\x0D]+", " "))

    # Counted inside the array: a filter above the explode can't be pushed below
    # it, where the count would be made a second time.
    counted = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), _count(x).alias("n")))
    found = F.transform(counted, lambda x: F.struct(
        x["line"].alias("line"), x["n"].alias("n"), F.when(x["n"] >= MIN_WORDS, leaf(x["n"], x["line"])).alias("leaf")))
    return (docs.select(k1, k2, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("o"),
                        F.posexplode(found).alias("pos", "x"))
            .select("k1", "k2", "o", "pos", "x.line", "x.n", "x.leaf").where(F.col("leaf").isNotNull()))


def templates(docs: DataFrame) -> DataFrame:
    """``k1, k2, o, pos, template, n_docs, first`` of each line of a recurring
    template: its 128-bit template (``t1, t2``), in how many documents that
    occurs, and whether this is the first of them."""
    ensure_checkpoint_dir(docs.sparkSession)
    every = _lines(docs)
    often = every.groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") >= MIN_DOCS)
    word, mask = _bit("leaf")
    bitmap = often.groupBy(word.alias("w")).agg(F.bit_or(mask).alias("mask"))  # at most FILTER_BITS / 64 rows
    lines = stash(
        every.join(F.broadcast(bitmap), word == F.col("w")).where(F.col("mask").bitwiseAND(mask) != 0)
        .select("k1", "k2", "o", "pos", "n", "leaf",
                F.transform(F.regexp_extract_all(_masked(F.col("line")), F.lit(f"({WORD})")), lambda x: F.xxhash64(x)).alias("words"))
        .withColumns({"l1": F.xxhash64("leaf", "words"), "l2": F.xxhash64("words", "leaf", F.lit(3))}), "lines")

    # words of each distinct line after the first ones, with their support in the leaf
    distinct = stash(lines.groupBy("l1", "l2").agg(F.count("*").alias("m"), F.first("leaf").alias("leaf"),
                                                   F.first("n").alias("n"), F.first("words").alias("words")), "distinct")
    placed = distinct.select("l1", "l2", "leaf", "m", F.posexplode("words").alias("place", "word")).where(F.col("place") >= DEPTH)
    sizes = distinct.groupBy("leaf").agg(F.sum("m").alias("size"))
    constant = placed.groupBy("leaf", "place", "word").agg(F.sum("m").alias("support")).where(F.col("support") >= MIN_DOCS) \
        .join(sizes, "leaf").where(100 * F.col("support") >= SUPPORT * F.col("size"))
    fixed = placed.join(constant.select("leaf", "place", "word"), ["leaf", "place", "word"]).groupBy("l1", "l2").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("place", "word")).alias("x1"), F.bit_xor(F.xxhash64("word", "place", F.lit(5))).alias("x2"))
    whole = 100 * (F.least(F.col("n"), F.lit(DEPTH)) + F.coalesce("c", F.lit(0))) >= CONSTANT * F.col("n")
    named = distinct.select("l1", "l2", "leaf", "n").join(fixed, ["l1", "l2"], "left").select(
        "l1", "l2",
        F.when(whole, F.xxhash64("leaf", F.coalesce("c", F.lit(0)), "x1")).otherwise(F.col("l1")).alias("t1"),
        F.when(whole, F.xxhash64("leaf", "x2", F.lit(9))).otherwise(F.col("l2")).alias("t2"))

    used = lines.select("k1", "k2", "o", "pos", "l1", "l2").join(named, ["l1", "l2"]).select("k1", "k2", "o", "pos", "t1", "t2")
    recurring = used.groupBy("t1", "t2", "k1", "k2").agg(F.min("o").alias("o")).groupBy("t1", "t2").agg(
        F.count("*").alias("n_docs"), F.min("o").alias("o1")).where(F.col("n_docs") >= MIN_DOCS)
    return used.join(recurring, ["t1", "t2"]).select(
        "k1", "k2", "o", "pos", "t1", "t2", "n_docs", (F.col("o") == F.col("o1")).alias("first"))


def _cleaned(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``row, cleaned, gone`` of each row, and the columns of ``docs`` from it."""
    gone = templates(docs).where("not first").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    left = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    rows = whole_rows(docs).join(gone, ["k1", "k2"], "left").select("row", text.alias("cleaned"), "gone")
    return rows, [F.col("cleaned").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]


def drop_templates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns and rows; ``text`` without the lines of
    recurring templates; ``dropped_lines`` (array of line numbers from 0) is
    added (a column of that name is replaced), empty where nothing was dropped.

    Null and empty texts, blank lines and lines of fewer than ``MIN_WORDS``
    words stay as they are. Recurrence counts distinct (id, text) rows: one
    written twice is one document. Rows that share the smallest id all count
    as first; null ids come last. An empty table gives no rows.
    """
    rows, columns = _cleaned(docs.drop("dropped_lines"))
    return rows.select(*columns, F.coalesce("gone", F.array().cast("array<int>")).alias("dropped_lines"))


def without_templates(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, texts cleaned. A document of which
    nothing but white space is left goes; those that had no word stay."""
    rows, columns = _cleaned(docs)
    return rows.where(F.col("gone").isNull() | F.col("cleaned").rlike(WORD)).select(*columns)
