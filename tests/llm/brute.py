"""Brute-force versions of the corpus operators: plain loops over all rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    w = words(lower(text or ""))
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_groups(docs: dict[int, str | None], least=85) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest doc_id reachable): every pair compared."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and len(sets[a]) * 100 >= least * len(sets[b]) and len(sets[b]) * 100 >= least * len(sets[a]):
                both = len(sets[a] & sets[b])
                if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def dropped_lines(docs: dict[int, str | None], depth=3, least=3, share=60, shortest=3) -> dict[int, list[int]]:
    """doc_id -> numbers of the lines that line-template dedup drops."""
    lines = []
    for d, text in docs.items():
        for pos, line in enumerate((text or "").split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in words(line)]
            if text is not None and len(w) >= shortest:
                lines.append((d, pos, w, (len(w), *w[:depth])))
    size = collections.Counter(x[3] for x in lines)
    support = collections.Counter((leaf, k, w[k]) for _, _, w, leaf in lines for k in range(depth, len(w)))
    template, where = {}, collections.defaultdict(set)
    for d, pos, w, leaf in lines:
        if size[leaf] >= least:
            fixed = tuple((k, w[k]) for k in range(depth, len(w)) if support[(leaf, k, w[k])] >= max(least, 0.01 * size[leaf]))
            whole = 100 * (min(depth, len(w)) + len(fixed)) >= share * len(w)
            template[d, pos] = t = (leaf, fixed) if whole else tuple(w)
            where[t].add(d)
    out = {d: [] for d in docs}
    for (d, pos), t in sorted(template.items()):
        if len(where[t]) >= least and d != min(where[t]):
            out[d].append(pos)
    return out


GAP = frozenset(" \t\r\x0b\x0c")


def sentence_list(text: str | None) -> list[str]:
    """A sentence ends behind a line's end, and behind the white space that follows ``.``, ``!`` or ``?``."""
    out, begin, stop, t = [], 0, False, text or ""
    for i, c in enumerate(t):
        if c == "\n" or (stop and c in GAP and t[i + 1:i + 2] not in GAP):
            out.append(t[begin:i + 1])
            begin, stop = i + 1, False
        elif c not in GAP:
            stop = c in (".", "!", "?")
    return out + [t[begin:]] * (begin < len(t))


def removed_sentences(docs: dict[int, str | None], least=2, least_words=24, long=50) -> dict[int, list[int]]:
    where = collections.defaultdict(list)
    for d in sorted(docs):
        full = [(i, w) for i, s in enumerate(sentence_list(docs[d])) if (w := words(lower(s)))]
        size = [len(w) for _, w in full]
        enough = lambda a, b: b - a >= least and sum(size[a:b]) >= least_words
        runs = set()
        for k in range(len(full)):
            ahead = next((b for b in range(k + 1, len(full) + 1) if size[k] >= long or enough(k, b)), None)
            behind = next((a for a in range(k, -1, -1) if size[k] >= long or enough(a, k + 1)), None)
            runs |= {(k, ahead)} if ahead is not None else set()
            runs |= {(behind, k + 1)} if behind is not None else set()
        if full and not runs:
            runs = {(0, len(full))}
        for a, b in sorted(runs):
            where[tuple(tuple(w) for _, w in full[a:b])].append((d, full[a][0], full[b - 1][0] + 1))
    gone = {d: set() for d in docs}
    for places in where.values():
        for d, a, b in places[1:]:
            gone[d].update(range(a, b))
    return {d: sorted(x) for d, x in gone.items()}


def quality_counts(text: str | None) -> dict:
    t = text or ""
    w = words(t)
    runs = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered, seen, again = set(), set(), 0
    for k in range(len(w) - 7):
        if runs[tuple(w[k:k + 8])] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in t.split("\n") if words(x)]
    for x in lines:
        again += x in seen
        seen.add(x)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_dup_lines": again, "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct": len(set(w)),
            "base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w)}


def robust_kept(rows: list[tuple], m) -> dict:
    """row number -> kept, by the estimator of module ``m`` on whole arrays.
    rows: (lang, source, text)."""
    counts = [quality_counts(t) for _, _, t in rows]
    def share(a, b):
        return math.asin(math.sqrt(min(a / max(b, 1), 1.0)))
    vec = np.array([[math.log(max(c["word_chars"], 1) / max(c["n_words"], 1)), share(c["n_symbols"], c["word_chars"]),
                     share(c["n_dup_lines"], c["n_lines"]), share(c["n_repeat_words"], c["n_words"]),
                     math.log(max(c["n_distinct"], 1) + 1) / math.log(max(c["n_words"], 1) + 1)] for c in counts])
    good = np.array([not c["base_failed"] for c in counts])
    floor2 = np.square(list(m.FEATURES.values()))
    kept = {}
    models = {}

    def middle(v):
        v = np.sort(v)
        return v[(len(v) + 1) // 2 - 1]

    def model(key, chosen):
        if key not in models:
            x = vec[chosen]
            grid = np.floor(np.abs(x) * m.GRID + 0.5) * np.sign(x)
            center = np.array([middle(grid[:, i]) for i in range(m.DIM)])
            mad = np.array([middle(np.abs(grid[:, i] - center[i])) for i in range(m.DIM)]) / m.GRID
            mean, inverse = center / m.GRID, np.diag(1 / ((1.4826 * mad) ** 2 + floor2))
            for step in range(m.STEPS):
                d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
                bins = np.floor(np.log2(1 + np.maximum(d, 0)) * 32)
                edge = np.sort(bins)[math.ceil(m.CORE * len(x)) - 1]
                core = x[bins <= edge]
                mean = core.mean(axis=0)
                scatter = core.T @ core / len(core) - np.outer(mean, mean)
                grow = max(1.0, (2.0 ** ((edge + 0.5) / 32) - 1) / m.CORE_CHI2) if step == m.STEPS - 1 else 1.0
                inverse = np.linalg.inv(grow * scatter + np.diag(floor2))
            models[key] = mean, inverse
        return models[key]

    for k, (lang, source, _) in enumerate(rows):
        kept[k] = bool(good[k])
        for key in ((lang, source), (lang,), ()):
            chosen = [i for i in range(len(rows)) if good[i] and (rows[i][0], rows[i][1])[:len(key)] == key]
            if good[k] and len(chosen) >= m.MIN_GROUP:
                mean, inverse = model(key, chosen)
                kept[k] = (vec[k] - mean) @ inverse @ (vec[k] - mean) <= m.CUTOFF
                break
    return kept


def local_alignment(a: list, b: list, match=2, mismatch=-1, gap=-1) -> int:
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, last[j] + (match if x == y else mismatch), last[j + 1] + gap, now[j] + gap))
        best, last = max(best, *now), now
    return best


def benchmark_words(text: str | None) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def leaks(docs: dict, items: dict) -> set:
    """(doc, item) whose local alignment is good enough: every pair aligned
    that shares enough of the item's words."""
    out = set()
    for i, item in items.items():
        w = benchmark_words(item)
        need = max(0.9 * len(w), 2 * min(len(w), 8))
        for d, text in docs.items():
            t = benchmark_words(text)
            if w and 2 * sum(x in set(t) for x in w) >= need and local_alignment(w, t) >= need:
                out.add((d, i))
    return out


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return sorted([(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
                  + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
                  + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def all_segmentations(word: str, pieces: dict[str, float]) -> float:
    """Summed probability of every way to cut a word into pieces."""
    if not word:
        return 1.0
    return sum(math.exp(pieces[word[:k]]) * all_segmentations(word[k:], pieces)
               for k in range(1, len(word) + 1) if word[:k] in pieces)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
