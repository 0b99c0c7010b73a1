"""Byte-level BPE encoding and decoding over rank files.

A segment tree over a piece's byte positions holds, at each live position, the rank of the pair that starts there; the
root is the leftmost minimum. A merge changes the leaves of the merged position, its right neighbour and its left
neighbour, each by a point update along one path to the root. Short pieces are worked on many at a time, one tree per
row of an array; long ones one by one, in time n log n.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh
from .tokens import BATCH_IDS, PieceCache, chunks_of, list_array

NONE = np.int32(2**31 - 1)
#: Pieces of at most so many bytes are encoded together.
SHORT = 64
_SHIFT = 31


class Ranks:
    """A rank file's tables: the rank of each pair of tokens whose joined bytes are a token, and the tokens' bytes.

    The tables for encoding are made at once; those for long pieces and for decoding only where they are needed.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        if max(ranks.values()) >= 1 << 24:  # with a place of SHORT in 32 bits
            raise ValueError("more than 16,777,216 tokens")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        found = [((ranks[t[:i]] << _SHIFT) | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = (np.array(x, dtype=kind) for x, kind in zip(zip(*found, strict=True), (np.int64, np.int32), strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int32))
        self.bits = max(8, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # linear probing, all keys at once
            free = self.keys[at[todo]] < 0
            first = todo[free]
            self.keys[at[first]] = keys[first]  # of several keys for a slot, one stays
            won = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))

    @functools.cached_property
    def bytes_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length and start of each token's bytes in one array of them all."""
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        return lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1], np.frombuffer(b"".join(tokens), dtype=np.uint8)

    @functools.cached_property
    def decimal(self) -> np.ndarray:
        decimal = [str(i).encode() + b" " for i in range(max(self.ranks.values()) + 1)]
        width = max(map(len, decimal))
        return np.array([list(d.ljust(width, b"\0")) for d in decimal], dtype=np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << _SHIFT) | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[(found >= 0) & ~hit]
        return out

    def encode_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of 2 to ``width`` bytes, a power of two; one segment tree per row."""
        n, levels = len(pieces), width.bit_length() - 1
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        token = self.of_byte[raw]
        place = np.arange(width, dtype=np.int32)
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, dtype=np.int32)
        rows, cols = np.nonzero(place[None, :] < (sizes - 1)[:, None])
        ranks = self.pair_ranks(token[rows, cols], token[rows, cols + 1])
        # a leaf is rank and position in one number, so the least is the leftmost of the lowest rank
        tree[rows, width + cols] = np.where(ranks == NONE, NONE, (ranks << levels) | cols.astype(np.int32))
        for level in range(levels - 1, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
        live = np.flatnonzero(tree[:, 1] != NONE)

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            tree[row, leaf] = value
            for _ in range(levels):
                leaf = leaf >> 1
                tree[row, leaf] = np.minimum(tree[row, 2 * leaf], tree[row, 2 * leaf + 1])

        while len(live):
            best = tree[live, 1]
            at, rank = best & (width - 1), best >> levels
            gone = after[live, at]
            token[live, at] = rank
            follow = after[live, gone]
            after[live, at] = follow
            more = follow < sizes[live]
            before[live[more], follow[more]] = at[more]
            put(live, width + gone, np.full(len(live), NONE))
            value = np.full(len(live), NONE)
            r = self.pair_ranks(rank[more], token[live[more], follow[more]])
            value[more] = np.where(r == NONE, NONE, (r << levels) | at[more])
            put(live, width + at, value)
            prior = before[live, at]
            has = prior >= 0
            if has.any():
                row, p = live[has], prior[has]
                r = self.pair_ranks(token[row, p], rank[has])
                put(row, width + p, np.where(r == NONE, NONE, (r << levels) | p))
            # merged away: marks for the end
            token[live, gone] = -1
            live = live[tree[live, 1] != NONE]
        kept = (token >= 0) & (place[None, :] < sizes[:, None])
        ends = np.cumsum(kept.sum(axis=1)) * 4
        flat = token[kept].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_long(self, piece: bytes) -> bytes:
        """One piece of any length, with the same tree in plain lists."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        token = [int(self.of_byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = (int(NONE), n)
        get = self.pairs.get
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = get((token[i] << _SHIFT) | token[i + 1])
            if r is not None:
                tree[width + i] = (r, i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int | None) -> None:
            leaf = width + i
            tree[leaf] = none if rank is None else (rank, i)
            while leaf > 1:
                leaf >>= 1
                a, b = tree[2 * leaf], tree[2 * leaf + 1]
                tree[leaf] = a if a <= b else b

        while tree[1] is not none:
            rank, i = tree[1]
            gone = after[i]
            token[i], token[gone] = rank, -1
            after[i] = follow = after[gone]
            put(gone, None)
            if follow < n:
                before[follow] = i
                put(i, get((rank << _SHIFT) | token[follow]))
            else:
                put(i, None)
            if (p := before[i]) >= 0:
                put(p, get((token[p] << _SHIFT) | rank))
        return np.array([t for t in token if t >= 0], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        raw = [p.encode("utf-8") for p in pieces]
        for i, b in enumerate(raw):
            rank = self.ranks.get(b)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(b) > SHORT:
                out[i] = self.encode_long(b)
            else:
                by_width.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(i)
        for width, all_at in by_width.items():
            for k in range(0, len(all_at), step := max(1, (1 << 20) // width)):
                at = all_at[k : k + step]
                for i, ids in zip(at, self.encode_short([raw[i] for i in at], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, one after the other."""
        lengths, starts, flat = self.bytes_of
        sizes = lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return b""
        shift = np.repeat(starts[ids] - (ends - sizes), sizes)
        return flat[shift + np.arange(ends[-1])].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        wide = self.decimal[ids].ravel()
        return wide[wide != 0].tobytes()[:-1]


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})


@functools.lru_cache(maxsize=4)
def _cache(path: str) -> PieceCache:
    return PieceCache(load_ranks(path).encode_pieces)


def encode_texts(texts: list[str], path: str, pattern: str) -> list[np.ndarray]:
    split = regex.compile(pattern).findall
    pieces = [split(t) for t in texts]
    known = _cache(path).load(p for ps in pieces for p in ps)
    return [np.frombuffer(b"".join([known[p] for p in ps]), dtype="<u4") for ps in pieces]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without ``text``, with the ids of each whole text in ``out`` (array of int).

    Each match of ``pattern`` is encoded by itself; characters that no match covers give no ids. No special tokens:
    their strings are ordinary text. A null text counts as empty and has no ids. Repeated rows stay, an empty table
    gives an empty one, and a column named ``out`` is replaced. ``path`` is the rank file's place on every executor.
    """
    rest = [f for f in docs.schema.fields if f.name.lower() not in (text.lower(), out.lower())]
    schema = StructType([*rest, StructField(out, ArrayType(IntegerType()))])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, at = batch.select(names), 0
            held, size, begin = [], 0, 0
            for part in chunks_of(batch.column(text).to_pylist()):
                held += encode_texts(part, path, pattern)
                at += len(part)
                size += sum(map(len, held[-len(part) :]))
                if size >= BATCH_IDS or at == batch.num_rows:
                    cols = [*others.slice(begin, at - begin).columns, list_array(held, pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, out])
                    held, size, begin = [], 0, at

    return docs.select(*[f"`{n}`" for n in names], F.col(text)).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for in ``out`` (binary); null ids give null."""
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower()])
    schema = StructType.fromJson(df.schema.jsonValue()).add(out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            column = batch.column(ids)
            got = pa.array([ranks.decode(s.values.to_numpy(zero_copy_only=False)) if s.is_valid else None for s in column], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def digest_of(ranks: Ranks, ids: np.ndarray) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids, and of the bytes decoded from them."""
    return len(ids), hashlib.sha256(ranks.decimals(ids)).hexdigest(), hashlib.sha256(ranks.decode(ids)).hexdigest()


def _digest_schema(docs: DataFrame, key: str) -> StructType:
    n, a, b = fresh(docs.select(key), "n_tokens", "ids_sha256", "decoded_sha256")
    return StructType([docs.schema[key], StructField(n, LongType()), StructField(a, StringType()), StructField(b, StringType())])


def _digest_batch(schema: StructType, keys: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names)


def digest(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row of an encoded table: ``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, of which one that is
    also ``key``'s name gets an underscore."""
    schema = _digest_schema(df, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            column = batch.column(ids)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            yield _digest_batch(schema, batch.column(key), [digest_of(ranks, flat[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])

    return df.select(key, ids).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``digest(encode(docs))`` in one pass: the ids stay in the task that made them, which also decodes them."""
    schema = _digest_schema(docs, key)
    (t,) = fresh(docs.select(key), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            rows = [digest_of(ranks, ids) for part in chunks_of(batch.column(t).to_pylist()) for ids in encode_texts(part, path, pattern)]
            yield _digest_batch(schema, batch.column(key), rows)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias(t)).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
