"""What the two tokenizer operators share: a bounded cache of pieces and ragged id columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

#: A list column is handed on in batches of about so many ids.
BATCH_IDS = 2_000_000


#: What an entry of a cache takes besides its piece and ids: two objects' heads and a place in a dictionary.
ENTRY_BYTES = 200


class PieceCache:
    """Ids of pieces of text as little-endian uint32 bytes, in two generations of about ``generation`` bytes each.

    When the young generation is full it becomes the old one, so common pieces stay. Both are bounded by bytes, however
    long or short the pieces are, but for the pieces of a single call.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], generation: int = 24 << 20):
        self.encode, self.generation = encode, generation
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def load(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """A mapping that has all ``pieces``."""
        wanted = set(pieces)
        if self.size > self.generation:
            self.old, self.young, self.size = self.young, {}, 0
        missing = wanted - self.young.keys()
        if missing:
            known = missing & self.old.keys()
            new = {p: self.old[p] for p in known}
            rest = list(missing - known)
            new.update(zip(rest, self.encode(rest), strict=True))
            self.young.update(new)
            self.size += sum(map(len, new)) + sum(map(len, new.values())) + ENTRY_BYTES * len(new)
        return self.young


def chunks_of(texts: list[str | None], chars: int = 2_000_000) -> Iterable[list[str]]:
    """Runs of texts (null: empty) of about ``chars`` characters."""
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def list_array(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)).cast(kind))
