"""Records of a text that arrives in pieces, each given out once, as soon as its end mark is there.

The state of a conversation is what follows the last end mark, the number of records so far, and the number of the last piece.
Text that can't become a record is not kept, so the state is bounded by one record, however long the conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.generated import RECORD_END
from ..functions.text import BLANKS


class Scanner:
    """Splits a text at end marks, piece by piece. Of a part that does not begin with a brace only what may be the beginning of an
    end mark is kept."""

    def __init__(self, tail: str = "", skips: bool = False, end: str = RECORD_END):
        self.tail, self.skips, self.end = tail, skips, end

    def feed(self, piece: str) -> list[str]:
        """The records that this piece completes."""
        # an end mark that is found begins in the tail at the earliest where it could not end before
        text, look = self.tail + piece, max(0, len(self.tail) - len(self.end) + 1)
        out, at = [], 0
        while (found := text.find(self.end, look)) >= 0:
            part = text[at:found].strip(BLANKS)
            if not self.skips and part.startswith("{"):
                out.append(part.removesuffix(",").rstrip(BLANKS) if part.endswith(",") else part)
            at = look = found + len(self.end)
            self.skips = False
        self.tail = text[at:]
        begun = self.tail.lstrip(BLANKS)
        if not self.skips and begun and not begun.startswith("{"):
            self.skips = not self._may_end(begun)
        if self.skips:
            self.tail = self.tail[-(len(self.end) - 1) :]
        elif not begun:
            self.tail = ""
        return out

    def _may_end(self, begun: str) -> bool:
        """Whether what was begun can still turn out to be nothing but the end mark."""
        return self.end.startswith(begun)


class Records(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "tail string, skips boolean, n long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        tail, skips, n, last = self.state.get() if self.state.exists() else ("", False, 0, None)
        scanner = Scanner(tail, skips)
        for r in sorted(rows, key=lambda r: r.seq):
            if last is not None and r.seq <= last:
                continue  # a piece that came before
            last = r.seq
            for record in scanner.feed(r.text or ""):
                yield Row(conv_id=key[0], place=n, record=record)
                n += 1
        self.state.update((scanner.tail, scanner.skips, n, last))

    def close(self) -> None:
        pass


def new_records(pieces: DataFrame) -> DataFrame:
    """A stream of the records (conv_id, place, record) that a stream of pieces (conv_id, seq, text) completes, each once.

    The pieces of a conversation come in the order of ``seq``, one that isn't larger than the last is a repeat; a null text is
    an empty one, and rows without conv_id or seq are left out. Run it in ``retry.keyed_state``.
    """
    known = pieces.where(F.col("conv_id").isNotNull() & F.col("seq").isNotNull()).select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), "text")
    return known.groupBy("conv_id").transformWithState(Records(), "conv_id long, place long, record string", "Append", "None")
