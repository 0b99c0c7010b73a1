"""Periodic runs of words by suffix trees and leaf lists.

For a batch of documents the suffixes of each one's words are sorted by prefix doubling; the common prefixes of neighbours
give the suffix trees: an inner node is an interval of suffixes and a depth D. Each node is visited with the leaf lists of
all its children but the largest, so a leaf is looked at a logarithmic number of times. A leaf i of such a list whose node
also holds i + D or i - D begins or ends a tandem repeat of two parts of D words; it is branching if the word after it does
not go on with the period. Branching repeats are rotated to the left word by word as long as the period holds, which gives
the maximal run, and those of the same run merge into the one with the smallest period.

Documents are independent of each other: a task takes the rows of its partition in batches of about BATCH_WORDS words. A
document of n words takes about 250 n bytes in the task that has it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_columns

#: Documents are worked on together until they have so many words.
BATCH_WORDS = 400_000
#: The least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: So many rounds of pointer jumping before the few places left are followed one by one.
JUMPS = 10

#: From a row's id and its number of words to (start, period) of the stretch to be made periodic, or None.
Plant = Callable[[int | None, int], tuple[int, int] | None]


def suffix_trees(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes, their ranks and common prefixes (``lcp[t]`` of the suffixes at t - 1 and t; 0 at both ends).

    ``x`` holds the words of all documents as numbers; ``ends`` the end of the document that each place is in. Suffixes of
    different documents have no common prefix.
    """
    n = len(x)
    key = ends.astype(np.int64) * (int(x.max()) + 1) + x
    sa = np.argsort(key)
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    split = np.where(new, 0, -1).astype(np.int8)  # the round that told the suffix from the one before
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = start
    levels, k = [], 1
    open_ = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(open_):
        levels.append(rank.copy())
        at = sa[open_]
        then = at + k
        inside = then < ends[at]
        second = np.where(inside, rank[np.where(inside, then, 0)], -1).astype(np.int64) + 1
        key = rank[at].astype(np.int64) * (n + 1) + second
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[open_] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh_ = new & (split[open_] < 0)
        split[open_[fresh_]] = len(levels)
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    lcp = np.zeros(n + 1, dtype=np.int32)
    active = np.flatnonzero(split > 0)
    if len(active):
        lcp[active] = 1 << (split[active].astype(np.int32) - 1)
        for m in range(len(levels) - 2, -1, -1):
            t = active[split[active] - 2 >= m]
            if not len(t):
                continue
            a, b, r = sa[t - 1] + lcp[t], sa[t] + lcp[t], levels[m]
            inside = (a < ends[sa[t]]) & (b < ends[sa[t]])
            same = inside & (r[np.where(inside, a, 0)] == r[np.where(inside, b, 0)])
            lcp[t[same]] += 1 << m
    return sa, rank, lcp


def nearest(v: np.ndarray, active: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each ``active`` place the nearest place before it with a smaller (or equal) value; ``v[0]`` is smaller than all."""
    p = np.arange(-1, len(v) - 1)
    passes = np.greater if or_equal else np.greater_equal
    left = active
    for _ in range(JUMPS):
        c = p[left]
        left = left[passes(v[c], v[left])]
        if not len(left):
            return p
        p[left] = p[p[left]]
    for t in left.tolist():
        c, value = int(p[t]), v[t]
        while passes(v[c], value):
            c = int(p[c])
        p[t] = c
    return p


def leaf_lists(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of leaves in the order of suffixes with their node's first and last place and depth, for all children of
    each inner node but its largest."""
    n = len(lcp) - 1
    t = np.flatnonzero(lcp > 0)
    if not len(t):
        return (np.zeros(0, dtype=np.int64),) * 4
    before, sibling = nearest(lcp, t, False)[t], nearest(lcp, t, True)[t]
    after = n - nearest(lcp[::-1], n - t[::-1], False)[n - t]
    depth = lcp[t].astype(np.int64)
    node = np.lexsort((t, depth, before))
    t, before, sibling, after, depth = t[node], before[node], sibling[node], after[node], depth[node]
    first = np.concatenate([[True], (before[1:] != before[:-1]) | (depth[1:] != depth[:-1])])
    last = np.concatenate([first[1:], [True]])
    number = np.cumsum(first) - 1
    # the child before each boundary, and the one after the last
    lo, hi = np.concatenate([sibling, t[last]]), np.concatenate([t, after[last]])
    of = np.concatenate([number, number[last]])
    order = np.lexsort((hi - lo, of))
    lo, hi, of = lo[order], hi[order], of[order]
    largest = np.concatenate([of[1:] != of[:-1], [True]])
    lo, hi, of = lo[~largest], hi[~largest], of[~largest]
    size = hi - lo
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    of = np.repeat(of, size)
    return place, before[first][of], after[last][of] - 1, depth[first][of]


def branching_repeats(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of every tandem repeat that the next word does not go on with."""
    sa, rank, lcp = suffix_trees(x, ends)
    place, low, high, depth = leaf_lists(lcp)
    leaf = sa[place]
    starts, halves = [], []
    for step in (depth, -depth):
        other = leaf + step
        inside = (other >= 0) & (other < ends[leaf])
        r = rank[np.where(inside, other, 0)]
        found = np.flatnonzero(inside & (r >= low) & (r <= high))
        a, b, d = leaf[found], other[found], depth[found]
        a, b = np.minimum(a, b), np.maximum(a, b)
        goes_on = (b + d < ends[b]) & (x[np.where(b + d < ends[b], b + d, 0)] == x[b])
        starts.append(a[~goes_on])
        halves.append(d[~goes_on])
    start, half = np.concatenate(starts), np.concatenate(halves)
    both = np.unique(np.stack([start, half]), axis=1)
    return both[0], both[1]


def runs_of(x: np.ndarray, begins: np.ndarray, ends: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of each maximal run of at least so many words and periods, in order."""
    if not len(x):
        return []
    start, half = branching_repeats(x, ends)
    begin, need = begins[start], np.maximum(least_words, least_periods * half) - 2 * half
    keep = start - need >= begin
    for i in range(1, 2 * least_periods + 1):  # most of what is no run ends within a few words
        start, half, begin, need = start[keep], half[keep], begin[keep], need[keep]
        far = start - np.minimum(i, need)
        keep = x[far] == x[far + half]
    start, half, begin, need = start[keep], half[keep], begin[keep], need[keep]
    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = {}
    for at in np.lexsort((half, start + 2 * half)).tolist():
        s, q, b = int(start[at]), int(half[at]), int(begin[at])
        end = s + 2 * q
        if any(q % p == 0 and s >= r for r, p in known.get(end, ())):
            continue  # a repeat of several periods of a run that is known
        step = 64
        while s > b:
            low = max(b, s - step)
            differ = np.flatnonzero(x[low:s] != x[low + q : s + q])
            if len(differ):
                s = low + int(differ[-1]) + 1
                break
            s, step = low, step * 4
        if end - s >= max(least_words, least_periods * q):
            found.setdefault((s, end), q)
            known.setdefault(end, []).append((s, q))
    return sorted((s, end - s, q) for (s, end), q in found.items())


def _described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    keep = np.ones(len(words), dtype=bool)
    for s, length, q in runs:
        keep[s + q : s + length] = False
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = words if not runs else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    milli = 1_000 * best[1] // best[2] if runs else None
    return len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), b" ".join(kept)


def batch_runs(rows: list[tuple[int | None, list[bytes]]], plant: Plant | None) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each row of a batch; places are word numbers of the row."""
    counts = np.array([len(w) for _, w in rows], dtype=np.int64)
    stops = np.cumsum(counts)
    flat = [w for _, words in rows for w in words]
    x = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
    texts = [w for _, w in rows]
    for i, (row, words) in enumerate(rows):
        where = plant(row, len(words)) if plant and words else None
        if where:
            a, p = where
            source = np.arange(len(words))
            source[a:] = a + (source[a:] - a) % p
            x[stops[i] - counts[i] : stops[i]] = x[stops[i] - counts[i] + source]
            texts[i] = [words[j] for j in source.tolist()]
    found: list[list] = [[] for _ in rows]
    begins, ends = np.repeat(stops - counts, counts), np.repeat(stops, counts)
    for s, length, q in runs_of(x, begins, ends):
        i = int(np.searchsorted(stops, s, side="right"))
        found[i].append((s - int(stops[i] - counts[i]), length, q))
    yield from zip(texts, found, strict=True)


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"


def collapse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: Plant | None = None, digest: bool = False) -> DataFrame:
    """``docs`` with each row's periodic runs of words and its text without their repetitions.

    New columns: ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest run (ties: smallest start,
    then period; null without runs); ``runs_sha256`` of all runs; ``collapsed``, the kept words joined by one space (its SHA-256 if
    ``digest``). A null or empty text has no words, so no runs and an empty ``collapsed``; texts of any length are taken whole;
    repeated rows get the same values each; an empty table gives an empty one. A null ``doc_id`` matters to ``plant`` only.
    Columns of ``docs`` stay; if one has a new column's name, the new one gets an underscore before it.
    """
    names = fresh(docs, *[c.split()[0] for c in COLUMNS.split(", ")])
    own = docs.select("*", *[F.lit(None).cast(c.split()[1]).alias(n) for n, c in zip(names, COLUMNS.split(", "), strict=True)]).schema
    i_text, i_id, width = docs.columns.index(text), docs.columns.index(doc_id), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                rows, size, first = [], 0, at
                while at < whole.num_rows and size < BATCH_WORDS:
                    # bytes split at exactly the ASCII white space
                    rows.append((whole.column(i_id)[at].as_py(), (whole.column(i_text)[at].as_py() or "").encode().split()))
                    size += len(rows[-1][1])
                    at += 1
                out = []
                for words, runs in batch_runs(rows, plant):
                    *values, kept = _described(words, runs)
                    out.append((*values, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
                part = whole.slice(first, at - first)
                new = [pa.array(v, pa.string() if k > 4 else pa.int64()) for k, v in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[f"c{k}" for k in range(width)])

    return map_columns(docs, run, own)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The stretch that the query makes periodic in a tenth of the documents, by a checksum of the id; a null id has none."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return collapse(docs, plant=planted, digest=True).drop("text").withColumnRenamed("collapsed", "collapsed_sha256")
