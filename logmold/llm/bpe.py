"""Byte-level BPE over a corpus: every distinct word is encoded once.

1. Pre-tokens (matches of the pattern in :func:`boundaries`) are counted in all texts.
   The most frequent ones, at most ``HOT_WORDS``, are the heavy keys of the
   join: they are encoded in a small table of their own and sent to all tasks.
   Which words are in it decides how they travel, never what comes out.
2. All other pre-tokens are exploded with their positions and shuffled by
   word; a task encodes each distinct word once for all its places, and the
   ids go back to their documents by row key.
3. Documents are reassembled by position. They travel as word numbers, not as
   text. Decoding looks each id up in the vocabulary's table of bytes.

Frequent words are looked up by a 64-bit hash, and then compared character by
character: a rare word with the hash of a frequent one goes the rare words' way.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmold.llm.common import STEP, frequent, map_batches, mix, prepare, run_hashes, stash, texts

#: Bound of the table of frequent words that is sent to all tasks.
HOT_WORDS = 800_000
#: A task passes its counts on after this many words; those that it saw less
#: often than this in them don't compete for the table of frequent ones.
FLUSH_WORDS, LEAST_SEEN = 2_000_000, 2
#: Characters that are split at a time.
GROUP = 1 << 19
#: Words up to this many bytes are merged by scanning, longer ones by a heap.
SHORT = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged, the
    leftmost first, until no pair is a token."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) <= SHORT:
        parts = [word[i:i + 1] for i in range(len(word))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]
    end = list(range(1, len(word) + 1))  # of the part that starts here; 0: no part starts here
    before = list(range(-1, len(word) - 1))
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        if not end[i] or (mid := end[i]) >= len(word) or end[mid] != j:
            continue  # one of the two parts has changed
        end[i], end[mid] = j, 0
        if j < len(word):
            before[j] = i
            if (r := ranks.get(word[i:end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:j])) is not None:
            heapq.heappush(heap, (r, h, j))
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes()


def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, or other."""
    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "?" for i in range(0x110000))
    out = np.zeros(len(every), np.uint8)
    for kind, expr in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(expr, every):
            out[m.start():m.end()] = kind
    return out


LETTER, NUMBER, SPACE, EDGE = 1, 2, 3, 4
CLASS = _classes()
VALUE = mix(np.arange(1, len(CLASS) + 1, dtype=np.uint64) * STEP)


def boundaries(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts laid end to end (code points), with one
    filler at ``edges`` behind each text: as matches of the pattern

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    do. A run of one class is a pre-token. Of white space before something
    else the last character stands alone, and if it is a space it joins what
    follows. An apostrophe that starts a match takes the ending behind it.
    """
    kind = CLASS[codes]
    kind[edges] = EDGE
    start = np.r_[True, kind[1:] != kind[:-1]]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE))
    start[last] = True
    start[last + 1] = codes[last] != 32
    at = np.flatnonzero((codes == 39) & start)
    at = at[at + 1 < len(codes)]
    at = at[(kind[at] != EDGE) & (kind[at + 1] == LETTER)]
    one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
    size = np.where(np.isin(one, [*map(ord, "stmd")]), 1, np.where(
        ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    start[at + 1 + size] = True
    start[edges] = True
    return start


def pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(row, text) in groups of about ``GROUP`` characters. A longer text is cut
    before a space between two other characters: a match never reaches over it."""
    held, size = [], 0
    for row, text in enumerate(texts):
        begin = 0
        while text and begin < len(text):
            end = begin + GROUP
            while 0 <= (end := text.find(" ", end)) and not (end + 1 < len(text) and not text[end - 1].isspace() and not text[end + 1].isspace()):
                end += 1
            end = len(text) if end < 0 else end
            held.append((row, text[begin:end]))
            size += end - begin
            begin = end
            if size >= GROUP:
                yield held
                held, size = [], 0
    if held:
        yield held


def pretokens(texts: list[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Characters, and row, start, end and 64-bit hash of each pre-token, group
    by group."""
    for group in pieces(texts):
        joined = "".join(t + "\n" for _, t in group)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([len(t) + 1 for _, t in group]) - 1
        start = np.flatnonzero(boundaries(codes, edges))
        end = np.r_[start[1:], len(codes)]
        of = np.searchsorted(edges, start)
        real = start != edges[of]
        start, end, of = start[real], end[real], of[real]
        yield joined, np.array([r for r, _ in group])[of], start, end, run_hashes(VALUE[codes], start, end)


class _Counting:
    """Words and how often a task saw them; those seen once in ``FLUSH_WORDS``
    words aren't spelled out."""

    def __init__(self):
        self.held: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []

    def __call__(self, batch: pa.RecordBatch) -> dict | None:
        self.held += [(text, start, end, h) for text, _, start, end, h in pretokens(batch["text"].to_pylist())]
        return self.finish() if sum(len(x[3]) for x in self.held) > FLUSH_WORDS else None

    def finish(self) -> dict | None:
        held, self.held = self.held, []
        h = np.concatenate([np.empty(0, np.uint64), *(x[3] for x in held)])
        ordered = np.sort(h)
        new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][:len(ordered)])
        n = np.diff(np.r_[new, len(ordered)])
        often = ordered[new[n >= LEAST_SEEN]]
        which = pd.Index(often).get_indexer(h)
        place = np.empty(len(often) + 1, np.int64)
        place[which[::-1]] = np.arange(len(h))[::-1]  # the first place of each is written last
        at = np.sort(place[:-1])
        times = dict(zip(place[:-1].tolist(), n[n >= LEAST_SEEN].tolist()))
        word, begin = [], 0
        for text, start, end, own in held:
            mine = at[(at >= begin) & (at < begin + len(own))] - begin
            word += [text[a:b] for a, b in zip(start[mine].tolist(), end[mine].tolist())]
            begin += len(own)
        return {"word": word, "n": [times[i] for i in at.tolist()]} if word else None


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes in bytes of the values of a column of text or bytes, and these end to end."""
    held = [np.frombuffer(c.buffers()[2] or b"", np.uint8)[(o := np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset))[0]:o[-1]]
            for c in column.chunks if len(c)]
    return pc.binary_length(column).to_numpy(), np.concatenate([np.empty(0, np.uint8), *held])


class Hot:
    """The frequent words, most frequent first: number by hash, ids and
    characters by number. Of words with equal hashes only the first is in it.
    Characters and hashes are built when a word is first looked up: tasks that
    only go from numbers to ids do without."""

    def __init__(self, size: np.ndarray, flat: np.ndarray, length: np.ndarray, text: bytes):
        self.size, self.flat, self.length, self.text = size, flat, length, text
        self.start, self.begin = ((np.cumsum(x) - x).astype(np.int32) for x in (size, length))

    @cached_property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)

    @cached_property
    def places(self) -> tuple[pd.Index, np.ndarray]:
        """Distinct hashes, and the number of the word at each, then -1."""
        hashed = run_hashes(VALUE[self.codes], self.begin, self.begin + self.length)
        once = np.sort(np.unique(hashed, return_index=True)[1])
        return pd.Index(hashed[once]), np.append(once, -1).astype(np.int32)

    def find(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Number of each word ``codes[start:end]`` with hash ``h``, -1 where it isn't in the table."""
        index, numbers = self.places
        n = numbers[index.get_indexer(h)]
        at = np.flatnonzero(n >= 0)
        at = at[self.length[n[at]] == (end - start)[at]]
        size = self.length[n[at]]
        differs = codes[spread(start[at], size)] != self.codes[spread(self.begin[n[at]], size)]
        out = np.full(len(n), -1, np.int32)
        if len(at):
            at = at[~np.logical_or.reduceat(differs, np.cumsum(size) - size)]
        out[at] = n[at]
        return out

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Row and number of each pre-token, -1 for those not in the table, and these words in order."""
        rows, numbers, others = [np.empty(0, np.int64)], [np.empty(0, np.int32)], []
        for text, row, start, end, h in pretokens(texts):
            n = self.find(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), start, end, h)
            others += [text[a:b] for a, b in zip(start[n < 0].tolist(), end[n < 0].tolist())]
            rows.append(row)
            numbers.append(n)
        return np.concatenate(rows), np.concatenate(numbers), others


_LOADED: list = [None, None]


def _loaded(shared) -> Hot:
    """A worker's copy of the table, built once."""
    arrays = shared.value
    if _LOADED[0] is not arrays:
        _LOADED[:] = arrays, Hot(*arrays)
    return _LOADED[1]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``[start, start + size)``, one after another."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def assemble(codes: np.ndarray, places: np.ndarray, sizes: np.ndarray, ids: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, and how many each word has, from the word
    numbers (below 0: not in the table) and the ids of the other words: the
    places of these, how many ids each has, and all of their ids."""
    known = codes >= 0
    size = np.empty(len(codes), np.int64)
    size[known] = hot.size[codes[known]]
    size[places] = sizes
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    out[spread(start[known], size[known])] = hot.flat[spread(hot.start[codes[known]], size[known])]
    out[spread(start[places], size[places])] = ids
    return out, size


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and start of each id's bytes (size -1: no such id), and all bytes."""
    size = np.full(max(ranks.values()) + 1, -1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    known = np.maximum(size, 0)
    return size, np.cumsum(known) - known, np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)


def decoder(size: np.ndarray, start: np.ndarray, data: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """From lists of ids to the bytes of their tokens, end to end."""

    def decoded(lists: pa.Array) -> pa.Array:
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or size[ids].min() < 0):
            raise ValueError("an id that the vocabulary lacks")
        each = np.r_[0, np.cumsum(size[ids])]
        upto = np.r_[0, np.cumsum([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()])].astype(np.int64)
        text = data[spread(start[ids], size[ids])].tobytes()
        ends = each[upto].tolist()
        return pa.array([text[a:b] if x else None for a, b, x in zip(ends, ends[1:], lists.is_valid().to_pylist())], pa.binary())

    return decoded


def encode(docs: DataFrame, ranks_path: str, with_decoded: bool = False) -> DataFrame:
    """``k1, k2, doc_id, ids array<int>`` for each row of ``docs (doc_id, text)``;
    ``with_decoded`` adds ``decoded`` as :func:`decode` does, in the same pass.

    Special tokens aren't recognised. Null and empty texts have no ids;
    repeated rows get the same ids; an empty table gives no rows. A text may
    be of any length: only its own words are in memory at a time. The rank
    file is read on the driver (its size is that of the vocabulary).
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = read_ranks(ranks_path)
    ranks = spark.sparkContext.broadcast(vocabulary)
    tokens = spark.sparkContext.broadcast(token_bytes(vocabulary)) if with_decoded else None
    rows = texts(docs)

    def encode_rows(key: str):
        def make():
            table = ranks.value
            last: list = [None, b""]

            def work(batch: pa.RecordBatch) -> dict:
                ids = []
                for word in batch["word"].to_pylist():
                    if word != last[0]:  # equal words lie side by side
                        last[:] = word, _pack(encode_word(word.encode(), table))
                    ids.append(last[1])
                return {c: batch[c] for c in key.split()} | {"ids": ids}

            return work

        return make

    counted = stash(map_batches(rows.select("text"), _Counting, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # The driver holds the table in arrays only, and sends words and ids; tasks hash the words.
    table = map_batches(frequent(counted, "n", HOT_WORDS), encode_rows("word n"), "word string, n long, ids binary").toArrow().sort_by([("n", "descending")])
    size, flat = _flat(table["ids"])
    hot = spark.sparkContext.broadcast(((size // 4).astype(np.int32), flat.view(np.uint32), pc.utf8_length(table["word"]).to_numpy().astype(np.int32),
                                        _flat(table["word"])[1].tobytes()))
    del table

    def cold():
        table = _loaded(hot)

        def work(batch: pa.RecordBatch) -> dict:
            row, numbers, others = table.numbers(batch["text"].to_pylist())
            place = np.arange(len(row)) - np.searchsorted(row, row)
            at = numbers < 0
            few = batch.select(["k1", "k2"]).take(pa.array(row[at]))
            return {"k1": few["k1"], "k2": few["k2"], "place": pa.array(place[at].astype(np.int32)), "word": others}

        return work

    def numbered():
        table, pack = _loaded(hot), zstandard.ZstdCompressor(level=3).compress

        def work(batch: pa.RecordBatch) -> dict:
            row, numbers, _ = table.numbers(batch["text"].to_pylist())
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            # low bytes, then high ones: those of frequent words are zero
            codes = [pack(np.ascontiguousarray(numbers[a:b].view(np.uint8).reshape(-1, 4).T).tobytes()) for a, b in zip(ends, ends[1:])]
            return {"k1": batch["k1"], "k2": batch["k2"], "doc_id": batch["doc_id"], "codes": codes}

        return work

    def whole():
        table, unpack = _loaded(hot), zstandard.ZstdDecompressor().decompress
        back = decoder(*tokens.value) if tokens else None

        def work(batch: pa.RecordBatch) -> dict:
            codes = [np.ascontiguousarray(np.frombuffer(unpack(x), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
                     for x in batch["codes"].to_pylist()]
            first = np.cumsum([0, *map(len, codes)])
            found = batch["found"].combine_chunks() if isinstance(batch["found"], pa.ChunkedArray) else batch["found"]
            of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
            each = found.flatten()
            # a row written twice gives each place twice
            places, once = np.unique(first[of] + each.field("place").to_numpy(zero_copy_only=False), return_index=True)
            other = each.field("ids").take(pa.array(once)).to_pylist()
            ids, size = assemble(np.concatenate([np.empty(0, np.int32), *codes]), places, np.array([len(x) // 4 for x in other], np.int64),
                                 np.frombuffer(b"".join(other), np.uint32), table)
            ends = np.r_[0, np.cumsum(size)][first].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
            out = {"k1": batch["k1"], "k2": batch["k2"], "doc_id": batch["doc_id"], "ids": lists}
            return out | {"decoded": back(lists)} if back else out

        return work

    others = map_batches(
        map_batches(rows.select("k1", "k2", "text"), cold, "k1 long, k2 long, place int, word string")
        .repartition("word").sortWithinPartitions("word"),
        encode_rows("k1 k2 place"), "k1 long, k2 long, place int, ids binary",
    ).repartition("k1", "k2").groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "ids")).alias("found"))
    joined = map_batches(rows, numbered, "k1 long, k2 long, doc_id long, codes binary").join(others, ["k1", "k2"], "left")
    return map_batches(joined, whole, "k1 long, k2 long, doc_id long, ids array<int>" + (", decoded binary" if with_decoded else ""))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): its ``ids`` through the table of
    token bytes, which is of the vocabulary's size. Null ``ids`` give null, no
    ids give no bytes; an id that the vocabulary lacks is an error."""
    spark = encoded.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(token_bytes(read_ranks(ranks_path)))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(*shared.value)
        for batch in batches:
            yield batch.append_column("decoded", back(batch["ids"]))

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    return encode(docs, ranks_path, with_decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
