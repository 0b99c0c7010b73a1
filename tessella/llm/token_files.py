"""Token-id files with a shared Zstandard dictionary.

One dictionary is trained on serialized id arrays of a bounded sample. Documents are compressed one by one with it, so
that a short document costs little and can be read alone. A file has, in this order: MAGIC, the dictionary's SHA-256
(32 bytes), its length (uint32) and bytes; the documents' frames; the index (five arrays with an entry per document:
end of its frame, int64; ids, int64; doc_id, int64; whether doc_id is null, uint8; first id's place in the file, int64); the index's
place and the number of documents (uint64 each), and MAGIC again. Ids are serialized as two byte planes of little-endian
uint16 where all fit, else four planes of uint32 (first byte 2 or 4), which compresses better than whole numbers.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import hash_sample, passage, running_totals, save_table, scratch_path
from .files import open_input, open_output
from .tokens import PieceCache, chunks_of

MAGIC = b"TESSIDS1"
END_ID = 2
#: The dictionary is trained on so many different documents, the least by a hash, and a passage of so many
#: characters of each, from a place that a hash gives.
SAMPLE_DOCS, SAMPLE_CHARS = 1_000, 4_096
DICT_BYTES = 112_640
LEVEL = 3
#: Texts of about so many characters are encoded together.
CHUNK_CHARS = 4_000_000
MANIFEST = "path string, part int, n_docs long, n_ids long, bytes long, dict_sha256 string"


def serialize(ids: np.ndarray) -> bytes:
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    planes = ids.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T
    return bytes([wide]) + np.ascontiguousarray(planes).tobytes()


def deserialize(raw: bytes) -> np.ndarray:
    wide = raw[0]
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel().astype("<u4")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str, special: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    return t


#: Fixed by the tokenizer: its split of a lower-case word, and the printable characters that stand for bytes.
_PARTS = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Words of printable ASCII and of letters that have one spelling in Unicode and one lower case letter each.
_PLAIN = r"^[!-~À-ÖØ-öø-ÿ]*$"
#: Fixed by the tokenizer file: the normalizer and pre-tokenizer for which the split above is right.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


@functools.lru_cache(maxsize=4)
def splits_here(path: str) -> bool:
    """Whether the file's tokenizer splits and lowers words as is done here; any other is asked for whole texts."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    parts = [(found.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    added = all(t["special"] and not t["normalized"] and t["content"].startswith("<|") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in found.get("added_tokens") or [])
    whole = not (found.get("truncation") or found.get("padding")) and (found.get("model") or {}).get("type") == "BPE"
    return parts == [_NORMALIZER, _PRE_TOKENIZER] and added and whole


def _encode_parts(path: str, special: bool, parts: list[str]) -> list[bytes]:
    """Each part of a plain word by the library's model."""
    tokenize, out = _tokenizer(path, special).model.tokenize, []
    for p in parts:
        t = [x.id for x in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_CHARS))]
        out.append(struct.pack(f"<{len(t)}I", *t))
    return out


def _encode_odd(path: str, special: bool, words: list[str]) -> list[bytes]:
    """Each word by the whole library."""
    out: list[bytes] = []
    for k in range(0, len(words), 20_000):
        part = words[k : k + 20_000]
        e = _tokenizer(path, special).encode(part, is_pretokenized=True, add_special_tokens=False)
        at = np.array(e.word_ids, dtype=np.int64)
        ends = (np.searchsorted(at, np.arange(len(part)), side="right") * 4).tolist()
        flat = np.array(e.ids, dtype="<u4").tobytes()
        out += [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return out


@functools.lru_cache(maxsize=4)
def _cache(path: str, special: bool, plain: bool) -> PieceCache:
    return PieceCache(functools.partial(_encode_parts if plain else _encode_odd, path, special), (40 if plain else 8) << 20)


def _runs_of(cache: PieceCache, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' ids one after the other, and how many each has."""
    known = cache.load(pieces)
    ids = [known[p] for p in pieces]
    return np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2


def _gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` holds runs of ``sizes``: those at ``at`` one after the other, and where they begin and end."""
    n = sizes[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    starts = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])], ends


def _split(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """At spaces: where each string's pieces begin and end, each piece's number, and the different pieces."""
    lists = pc.split_pattern(strings, " ")
    coded = lists.flatten().dictionary_encode()
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), coded.indices.to_numpy(), coded.dictionary


def encode_texts(texts: list[str], path: str, special: bool = True) -> list[np.ndarray]:
    """The library's ids of each text. A tokenizer that ``splits_here`` is asked once per word, any other for whole texts.

    With ``special``, the library's default, the strings of special tokens in a text give their ids; else they are
    ordinary text. Arrow splits texts and words and numbers the different ones, of which only those that are not known yet
    go to the library; numpy puts the texts' ids together.
    """
    if not splits_here(path):
        return [np.array(e.ids, dtype="<u4") for e in _tokenizer(path, special).encode_batch(texts, add_special_tokens=False)]
    if not texts:
        return []
    text_ends, word_at, words = _split(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "))
    is_plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
    plain = pc.replace_substring_regex(pc.utf8_lower(words.filter(is_plain)), _PARTS, r"\1 ")
    word_ends, part_at, parts = _split(plain)
    flat, ends = _gather(*_runs_of(_cache(path, special, True), parts.to_pylist()), part_at)
    odd_flat, odd_sizes = _runs_of(_cache(path, special, False), words.filter(pc.invert(is_plain)).to_pylist())
    sizes = np.concatenate([np.diff(ends[word_ends]), odd_sizes])
    mask = is_plain.to_numpy(zero_copy_only=False)
    place = np.where(mask, np.cumsum(mask) - 1, mask.sum() + np.cumsum(~mask) - 1)
    ids, ends = _gather(np.concatenate([flat, odd_flat]), sizes, place[word_at])
    cuts = ends[text_ends].tolist()
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def train_dictionary(docs: DataFrame, path: str, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, size: int = DICT_BYTES) -> bytes:
    """A dictionary from at most ``sample_docs`` documents; raw content where there is too little to train on."""
    order = F.xxhash64(F.lit(17), F.col(text))
    sample = hash_sample(docs.where(F.col(text).isNotNull()).select(passage(text, sample_chars, 19).alias("t"), order.alias("h")), sample_docs)
    arrays = [serialize(ids) for ids in encode_texts([r["t"] for r in sample], path)] if sample else []
    try:
        return zstandard.train_dictionary(size, arrays, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(arrays)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_token_files(docs: DataFrame, folder: str, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Encodes each whole text (null: empty), appends ``end_id``, and writes the ids by ascending doc_id.

    Returns the manifest, a row per file. Null ids come first; documents with the same id are in the order of their
    texts' hashes, so a hot id is spread over files. Repeated rows stay. An empty table gives an empty manifest. Other
    columns of ``docs``, whatever their names, are left out.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, path, text)
    shared = spark.sparkContext.broadcast(raw)  # bounded by DICT_BYTES
    sha = hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, frame_ends, counts, keys, nulls, size = TaskContext.get().partitionId(), None, [], [], [], [], 0
        dictionary = _dictionary(shared.value)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True).compress
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            ids_at = 0
            keys_of = batch.column("k").to_pylist()
            for texts in chunks_of(batch.column("t").to_pylist(), CHUNK_CHARS):
                if out is None:
                    name, out = open_output(folder, f"ids-{part:06d}", ".tid")
                    head = MAGIC + bytes.fromhex(sha) + struct.pack("<I", len(shared.value)) + shared.value
                    out.write(head)
                    size = len(head)
                encoded = encode_texts(texts, path)
                frames = [compress(serialize(np.concatenate([ids, end]))) for ids in encoded]
                out.write(b"".join(frames))
                for ids, frame in zip(encoded, frames, strict=True):
                    size += len(frame)
                    frame_ends.append(size)
                    counts.append(len(ids) + 1)
                for k in keys_of[ids_at : ids_at + len(texts)]:
                    keys.append(0 if k is None else k)
                    nulls.append(k is None)
                ids_at += len(texts)
        if out is None:
            return
        n = np.array(counts, dtype="<i8")
        index = b"".join(a.tobytes() for a in (np.array(frame_ends, dtype="<i8"), n, np.array(keys, dtype="<i8"), np.array(nulls, dtype=np.uint8), np.cumsum(n) - n))
        out.write(index + struct.pack("<QQ", size, len(counts)) + MAGIC)
        out.close()
        row = {"path": name, "part": part, "n_docs": len(counts), "n_ids": int(n.sum()), "bytes": size + len(index) + 24, "dict_sha256": sha}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64()), ("dict_sha256", pa.string())]))

    tie = F.xxhash64(F.col("t"))
    # ranges of ids; the sort keeps them in order inside each file
    ordered = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t")).withColumn("h", tie)
    ordered = ordered.repartitionByRange(F.col("k").asc_nulls_first(), "h").sortWithinPartitions(F.col("k").asc_nulls_first(), "h")
    return save_table(ordered.mapInArrow(run, MANIFEST), "token-manifest")


class TokenFile:
    """A token file's index; ``document(i)`` reads one document alone."""

    def __init__(self, path: str):
        self.file = open_input(path)
        place, self.n = struct.unpack("<QQ", self.file.read_at(24, self.file.size() - 24)[:16])
        head = self.file.read_at(len(MAGIC) + 36, 0)
        tail = self.file.read_at(self.file.size() - place, place)
        if head[: len(MAGIC)] != MAGIC or tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        length = struct.unpack("<I", head[-4:])[0]
        self.first = len(head) + length
        raw = self.file.read_at(length, len(head))
        self.dict_sha256 = hashlib.sha256(raw).hexdigest()
        if self.dict_sha256 != head[len(MAGIC) : -4].hex():
            raise ValueError(f"the dictionary does not have its hash: {path}")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        n = self.n
        self.ends = np.frombuffer(tail, "<i8", n)
        self.counts = np.frombuffer(tail, "<i8", n, 8 * n)
        keys, nulls = np.frombuffer(tail, "<i8", n, 16 * n), np.frombuffer(tail, np.uint8, n, 24 * n).astype(bool)
        self.keys = pa.array(keys, mask=nulls)
        self.starts = np.frombuffer(tail, "<i8", n, 25 * n)

    def frames(self, i: int, j: int) -> list[bytes]:
        begin = self.first if i == 0 else int(self.ends[i - 1])
        block = self.file.read_at(int(self.ends[j - 1]) - begin, begin)
        at = [0, *(self.ends[i:j] - begin).tolist()]
        return [block[a:b] for a, b in zip(at, at[1:], strict=False)]

    def document(self, i: int) -> np.ndarray:
        return self.documents(i, i + 1)[0]

    def documents(self, i: int, j: int) -> list[np.ndarray]:
        return [deserialize(self.decompressor.decompress(f)) for f in self.frames(i, j)]


def read_token_files(manifest: DataFrame, step: int = 2_000) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and its ids' CRC-32.

    The CRC is over the ids as little-endian uint32.
    """
    # one row per file
    starts = running_totals(manifest, [F.col("part"), F.col("path")], "n_ids", "file_start").select("path", "file_start")
    schema = StructType([StructField("doc_id", LongType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType()), StructField("dict_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(row["path"])
                for i in range(0, f.n, step):
                    j = min(f.n, i + step)
                    crcs = [zlib.crc32(ids.tobytes()) for ids in f.documents(i, j)]
                    cols = [f.keys.slice(i, j - i), pa.array(f.starts[i:j] + row["file_start"]), pa.array(f.counts[i:j]), pa.array(crcs, pa.int64()), pa.array([f.dict_sha256] * (j - i))]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    files = save_table(starts, "token-starts")
    n = max(1, files.count())
    return files.repartition(n, F.col("path")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_token_files(docs, scratch_path(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest)
