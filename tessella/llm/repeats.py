"""Passages that occur more than once, byte for byte, found by a column-wise collection Burrows-Wheeler transform.

A window is LENGTH consecutive bytes of a text. Its anchor is the first of its runs of ANCHOR bytes with the least hash, so equal
windows have equal anchors at equal places. Consecutive windows with the same anchor are a piece, a string of fewer than
2 * LENGTH bytes; its number is the anchor's hash. Equal pieces are one string with a count. Numbers with one string only
are settled by that count; the strings of the others, a few per cent of the text, are the documents of collections of bounded size.

In a collection all strings are aligned at their anchors, so equal windows begin in the same column. A task builds the transform
column by column from the right: each round puts one symbol of each string in front of its suffix; the new column's order is
the old one, stably sorted by that symbol, and the common prefix of two neighbours is one more than the least of those
between the two before. Suffixes that share LENGTH bytes with a neighbour are repeated windows. A column is built from the one
before by passes from front to back, as with the method's sequential files; these are arrays of the task, since a collection is
bounded and tasks have no folder of their own on a cluster.

A number whose different strings are too many for a collection is settled exactly by counting its windows by their 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import fresh, map_columns, save_table, small

LENGTH, ANCHOR = 400, 128
#: Texts are hashed together from so many bytes on; longer ones in parts of as many windows. Places take PLACE_BITS bits.
PART, PLACE_BITS = 1 << 19, 21
#: Texts that a task remembers, so as not to cut many copies of them; beyond, it cuts them all.
REMEMBERED = 200_000
#: Bytes of the strings of a collection, about, and of one number's strings at most.
COLLECTION, HOT = 4 << 20, 16 << 20

_BASE = 0x9E3779B97F4A7C15
_LARGEST = np.uint64(2**64 - 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def run_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k symbols at each place."""
    power, inverse = _powers(max(1 << 21, 1 << int(len(x)).bit_length()))
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], out=total[1:])
    h = (total[k:] - total[:-k]) * inverse[: len(x) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def least_within(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values: of the end of one block of w and the beginning of the next."""
    blocks = np.concatenate([v, np.full(-len(v) % w, _LARGEST)]).reshape(-1, w)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(v) - w + 1
    return np.minimum(back[:m], front[w - 1 : w - 1 + m])


def pieces_of(raw: bytes, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, the anchor's place after the first window's begin, and its hash, of each piece of
    texts laid end to end. ``ends``: the end of the text that each byte is in."""
    h = run_hashes(np.frombuffer(raw, dtype=np.uint8), anchor)
    places = np.uint64((1 << PLACE_BITS) - 1)
    least = least_within((h & ~places) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
    at = (least & places).astype(np.int64)
    m = len(at)
    valid = ends[:m] - np.arange(m) >= length
    new = np.ones(m, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, m))
    keep = valid[first]
    first, size = first[keep], size[keep]
    return first, size, at[first] - first, h[at[first]].view(np.int64)


def repeated_windows(strings: list[bytes], anchors: list[int], length: int) -> list[np.ndarray]:
    """For each string the places of the windows that another string has at the same distance from its anchor."""
    m = len(strings)
    lead, size = np.array(anchors, dtype=np.int64), np.array([len(s) for s in strings], dtype=np.int64)
    shift = int(lead.max()) - lead
    width = int((shift + size).max())
    # a column of symbols per row; 0, which no byte becomes, stands before and after a string (no byte of UTF-8 is 255)
    symbols = np.zeros((m, width), dtype=np.uint8)
    for i, (s, at) in enumerate(zip(strings, shift.tolist(), strict=True)):
        symbols[i, at : at + len(s)] = np.frombuffer(s, dtype=np.uint8)
        symbols[i, at : at + len(s)] += 1
    symbols = np.ascontiguousarray(symbols.T)
    flags = np.zeros((width, m), dtype=bool)
    order, common = np.arange(m), np.zeros(m + 1, dtype=np.int16)  # one more, for the end of the last range
    for x in range(width - 1, -1, -1):
        symbol = symbols[x][order]
        to = np.argsort(symbol, kind="stable")
        symbol, order = symbol[to], order[to]
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        # from back to front, so that what lies between two ranges is not looked at
        begin = to[same]
        back = np.argsort(-begin)
        ranges = np.empty(2 * len(same), dtype=np.int64)
        ranges[::2], ranges[1::2] = begin[back] + 1, to[same + 1][back] + 1
        now = np.zeros(m + 1, dtype=np.int16)
        if len(same):
            now[same[back] + 1] = np.minimum(np.minimum.reduceat(common, ranges)[::2], length - 1) + 1
        common = now
        long = np.flatnonzero(common[:m] == length)
        flags[x, order[long]] = True
        flags[x, order[long - 1]] = True
    out = []
    for i, (at, n) in enumerate(zip(shift.tolist(), size.tolist(), strict=True)):
        out.append(np.flatnonzero(flags[at : at + max(0, n - length + 1), i]))
    return out


def _ranges(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the stretches of consecutive places."""
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    begin = places[np.concatenate([[0], cut])] if len(places) else places
    return begin, np.diff(np.concatenate([[0], cut, [len(places)]])) if len(places) else places


def _digest(b: bytes) -> tuple[int, int]:
    d = xxh3_128_digest(b)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


PIECES = "key binary, first long, windows int, lead int, number long, d1 long, d2 long"


def pieces(docs: DataFrame, text: str, length: int, anchor: int) -> DataFrame:
    """The pieces of each text of at least ``length`` bytes; ``key`` is its MD5, ``d1`` and ``d2`` are the piece's digest.

    What matters of a piece's copies is whether there are several: a task cuts the same text twice at most.
    """
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def found(parts: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        raw = b"".join(p for _, _, p in parts)
        sizes = np.array([len(p) for _, _, p in parts])
        stops = np.cumsum(sizes)
        first, windows, lead, number = pieces_of(raw, np.repeat(stops, sizes), length, anchor)
        of = np.searchsorted(stops, first, side="right")
        digests = [_digest(raw[f : f + n]) for f, n in zip(first.tolist(), (windows + length - 1).tolist(), strict=True)]
        starts = first - (stops - sizes)[of] + np.array([s for _, s, _ in parts])[of]
        keys = [parts[i][0] for i in of.tolist()]
        d1, d2 = zip(*digests, strict=True) if digests else ((), ())
        columns = (keys, starts, windows.astype(np.int32), lead.astype(np.int32), number, d1, d2)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        once: set[bytes] = set()
        twice: set[bytes] = set()
        for batch in batches:
            for t in batch.column(0):
                raw = (t.as_py() or "").encode()
                if len(raw) < length:
                    continue
                key = hashlib.md5(raw).digest()
                if key in twice:
                    continue
                if key in once:
                    twice.add(key)
                elif len(once) < REMEMBERED:
                    once.add(key)
                for at in range(0, len(raw) - length + 1, PART):
                    held.append((key, at, raw[at : at + PART + length - 1]))
                    size += len(held[-1][2])
                    if size >= PART:
                        yield found(held)
                        held, size = [], 0
        if held:
            yield found(held)

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, PIECES)


def cut_strings(docs: DataFrame, text: str, wanted: DataFrame, length: int) -> DataFrame:
    """``number``, ``d1``, ``d2``, ``lead`` and ``string`` of the pieces ``wanted`` (with key, first, windows), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, cuts in zip(batch.column(0), batch.column(1), strict=True):
                raw, rows = t.as_py().encode(), cuts.as_py()
                columns = [[r[c] for r in rows] for c in ("number", "d1", "d2", "lead")] + [[raw[r["first"] : r["first"] + r["windows"] + length - 1] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["number", "d1", "d2", "lead", "string"])

    # these grow with the corpus, so they are joined by a shuffle at any size
    cuts = wanted.groupBy("key").agg(F.collect_list(F.struct("first", "windows", "lead", "number", "d1", "d2")).alias("cuts"))
    texts = docs.select(F.col(f"`{text}`").alias("t")).where(F.octet_length("t") >= length).withColumn("key", F.unhex(F.md5("t")))
    # of copies one is cut: each task leaves one of its own, so those of a text do not meet in a task
    texts = texts.groupBy("key").agg(F.first("t").alias("t"))
    return texts.join(cuts, "key").select("t", "cuts").mapInArrow(run, "number long, d1 long, d2 long, lead long, string binary")


def collected(strings: DataFrame, length: int) -> DataFrame:
    """``number``, ``d1``, ``d2``, ``begin`` and ``size``: stretches of repeated windows of each of ``strings``."""
    total = strings.agg(F.coalesce(F.sum(F.octet_length("string")), F.lit(0))).first()[0]
    count = max(1, -(-total // COLLECTION))

    def run(table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        keys = list(zip(*(table.column(c).to_pylist() for c in ("number", "d1", "d2")), strict=True))
        for key, places in zip(keys, repeated_windows(table.column("string").to_pylist(), table.column("lead").to_pylist(), length), strict=True):
            for begin, size in zip(*(x.tolist() for x in _ranges(places)), strict=True):
                for column, value in zip(out, (*key, begin, size), strict=True):
                    column.append(value)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("number", "d1", "d2", "begin", "size"), out, strict=True)})

    dealt = strings.withColumn("c", F.pmod(F.xxhash64("number"), F.lit(count)))
    return dealt.groupBy("c").applyInArrow(run, "number long, d1 long, d2 long, begin long, size long")


def counted(strings: DataFrame, length: int) -> DataFrame:
    """As ``collected``, for any number of strings: their windows are counted by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, d1, d2, s in zip(*(batch.column(c).to_pylist() for c in ("number", "d1", "d2", "string")), strict=True):
                digests = [_digest(s[i : i + length]) for i in range(len(s) - length + 1)]
                w1, w2 = zip(*digests, strict=True)
                columns = ([number] * len(w1), [d1] * len(w1), [d2] * len(w1), range(len(w1)), w1, w2)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["number", "d1", "d2", "begin", "w1", "w2"])

    windows = save_table(strings.mapInArrow(run, "number long, d1 long, d2 long, begin long, w1 long, w2 long"), "repeat-windows")
    often = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    return windows.join(often, ["w1", "w2"], "left_semi").select("number", "d1", "d2", "begin", F.lit(1).cast("long").alias("size"))


def repeated(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``key`` (MD5 of a text) and ``spans``: the bytes (begin, end) of the text covered by repeated windows, in order, apart."""
    found = save_table(pieces(docs, text, length, anchor), "repeat-pieces")
    by_number = found.groupBy("number").agg(F.count(F.lit(1)).alias("c"), *[f(c).alias(f"{n}_{c}") for c in ("d1", "d2") for n, f in (("least", F.min), ("most", F.max))])
    several = (F.col("least_d1") != F.col("most_d1")) | (F.col("least_d2") != F.col("most_d2"))
    by_number = save_table(by_number.where("c > 1").select("number", several.alias("several")), "repeat-numbers")
    # copies of a text have the same pieces: one row is kept of each, with their number
    # a text's place tells its piece, so these are grouped by place alone: Spark then deals them out anew, and can split the
    # join where a number is in very many texts
    same = [F.first(c).alias(c) for c in ("windows", "lead", "number", "d1", "d2", "several")]
    hit = found.join(by_number, "number").groupBy("key", "first").agg(*same, F.count(F.lit(1)).alias("c"))
    hit = save_table(hit, "repeat-hits")
    strings = hit.where("several").groupBy("number", "d1", "d2").agg(F.sum("c").alias("c"), F.min(F.struct("key", "first", "windows", "lead")).alias("p"))
    strings = save_table(strings.select("number", "d1", "d2", "c", "p.*"), "repeat-strings")
    cut = save_table(cut_strings(docs, text, strings, length), "repeat-cut")
    hot = save_table(cut.groupBy("number").agg(F.sum(F.octet_length("string")).alias("b")).where(F.col("b") > HOT).select("number"), "repeat-hot")
    stretches = collected(cut.join(small(hot), "number", "left_anti"), length)
    if hot.limit(1).count():
        stretches = stretches.union(counted(cut.join(small(hot), "number", "left_semi"), length))
    stretches = save_table(stretches, "repeat-stretches")
    # a piece that is there more than once repeats whole
    whole = strings.where("c > 1").select("number", "d1", "d2")
    own = hit.where("several").select("key", "first", "windows", "number", "d1", "d2")
    marks = hit.where("NOT several").select("key", "first", F.col("windows").cast("long").alias("size"))
    marks = marks.union(own.join(whole, ["number", "d1", "d2"]).select("key", "first", F.col("windows").cast("long")))
    marks = marks.union(own.join(stretches, ["number", "d1", "d2"]).select("key", F.col("first") + F.col("begin"), "size"))
    before = Window.partitionBy("key").orderBy("begin", "end")
    spans = marks.select("key", F.col("first").alias("begin"), (F.col("first") + F.col("size") + F.lit(length - 1)).alias("end"))
    apart = F.coalesce(F.col("begin") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("apart", apart.cast("long")).withColumn("i", F.sum("apart").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("key", "i").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return save_table(spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans")), "repeat-spans")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes (binary) that no repeated window covers.

    A window of ``length`` bytes is repeated if it also starts anywhere else, in the same text or another; all are judged on the
    input. So every copy of a text of at least ``length`` bytes goes whole. Null and empty texts have no bytes; shorter ones stay; texts of
    any length are taken whole; an empty table gives an empty one. ``kept`` may cut a character in two; with ``digest`` it
    is the SHA-256 of those bytes in lower-case hex. Columns of ``docs`` stay; if one has a new column's name, the new one gets an underscore
    before it.
    """
    found = repeated(docs, text, length, anchor)
    names = fresh(docs, "n_bytes", "n_removed", "n_spans", "kept")
    key, key2, spans = fresh(docs, "text_key", "text_key2", "spans")
    kinds = ("long", "long", "long", "string" if digest else "binary")
    schema = docs.select("*", *[F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)]).schema
    i_text, width = docs.columns.index(text), len(schema)
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    other = found.select(F.col("key").alias(key2), F.col("spans").alias(spans))
    joined = keyed.join(small(other), F.col(key) == F.col(key2), "left").select(*[F.col(f"`{c}`") for c in docs.columns], spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out: list[tuple] = []
                for t, s in zip(batch.column(i_text), batch.column(batch.num_columns - 1), strict=True):
                    raw, cuts = (t.as_py() or "").encode(), s.as_py() or []
                    kept, done = [], 0
                    for c in cuts:
                        kept.append(raw[done : c["begin"]])
                        done = c["end"]
                    rest = b"".join([*kept, raw[done:]])
                    out.append((len(raw), len(raw) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest() if digest else rest))
                new = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[f"c{i}" for i in range(width)])

    return map_columns(joined, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, digest=True).drop("text").withColumnRenamed("kept", "kept_sha256")
