"""Packing into training windows by the sum-of-squares rule (operator 6).

Each task packs the documents it reads, as they come, and holds only its open windows. A document's full windows are cut
off first. The rest, of size s, goes to the fill level h for which the sum over levels of N(h) squared is least afterwards, N(h)
being the number of windows open at level h: moving one window from h to h + s changes that sum by
2 (N(h + s) - N(h)) + 2, opening one by 2 N(s) + 1, and filling one up by 1 - 2 N(h). The counts stand in an array with an
entry for each level, so the choice is one vector expression. The open windows are bounded by ``most_open``: beyond that,
and at the end of the task, they are drained. Draining pours the emptiest windows into the fullest, cutting pieces where a
window is full; what is left, less than one window, is cut into sequences whose lengths are powers of two, so nothing is padded.

Defined results: a null text is empty and takes one id (the end id); equal rows are packed one by one; an empty table gives
an empty table; other columns are ignored. Sequence ids are unique: the task's number times 2**40, plus a count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import in_chunks, tidied, utf8
from ledgerlens.llm.tokens import CACHE_BYTES, END_ID, encoder

WINDOW = 4096
MOST_OPEN = 4096
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: doc_id, start in the document, ids as bytes, ids of the document
Piece = tuple[int, int, bytes, int]


class LevelArray:
    """Open windows by fill level, and the sum-of-squares choice among them."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def choose(self, size: int) -> int:
        """The level (0: a new window) that takes ``size`` with the least sum of squares; ties go to the fullest."""
        top = self.window - size
        own, after = self.counts[1 : top + 1], self.counts[1 + size : self.window + 1]
        change = 2 * (after - own) + 2
        if top > 0:
            change[-1] = 1 - 2 * own[-1]  # full windows leave the count
        change = np.where(own > 0, change, np.iinfo(np.int64).max)[::-1]
        best = int(change.argmin()) if top > 0 else 0
        return top - best if top > 0 and change[best] <= 2 * self.counts[size] + 1 else 0

    def take(self, level: int) -> list[Piece]:
        """One window of that level, no longer open."""
        if not level:
            return []
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def put(self, level: int, pieces: list[Piece]) -> None:
        self.counts[level] += 1
        self.n_open += 1
        self.open.setdefault(level, []).append(pieces)

    def drained(self) -> Iterator[list[Piece]]:
        """All open windows, filled up from the emptiest ones; the last is cut at powers of two."""
        windows = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.counts[:] = 0
        self.open, self.n_open = {}, 0
        low = len(windows)
        spare: list[Piece] = []
        spare_size = 0
        for k, (level, pieces) in enumerate(windows):
            if k >= low:
                break
            room = self.window - level
            while room and (spare_size or low - 1 > k):
                if not spare_size:
                    low -= 1
                    spare_size, spare = windows[low][0], windows[low][1][::-1]
                piece, rest = cut(spare.pop(), room)
                pieces.append(piece)
                room -= len(piece[2]) // 4
                spare_size -= len(piece[2]) // 4
                if rest:
                    spare.append(rest)
            if room:
                spare, spare_size = pieces[::-1], self.window - room
                break
            yield pieces
        while spare_size:  # less than a window
            size = 1 << (spare_size.bit_length() - 1)
            spare_size -= size
            out: list[Piece] = []
            while size:
                piece, rest = cut(spare.pop(), size)
                out.append(piece)
                size -= len(piece[2]) // 4
                if rest:
                    spare.append(rest)
            yield out


def cut(piece: Piece, room: int) -> tuple[Piece, Piece | None]:
    """The first ``room`` ids of a piece, and what is left."""
    doc_id, start, ids, total = piece
    if len(ids) <= 4 * room:
        return piece, None
    return (doc_id, start, ids[: 4 * room], total), (doc_id, start + room, ids[4 * room :], total)


def packed(documents: Iterable[tuple[int, bytes]], window: int = WINDOW, most_open: int = MOST_OPEN) -> Iterator[list[Piece]]:
    """Windows of one stream of (doc_id, ids)."""
    levels = LevelArray(window)
    for doc_id, ids in documents:
        total = len(ids) // 4
        whole = total // window * window
        for start in range(0, whole, window):
            yield [(doc_id, start, ids[4 * start : 4 * (start + window)], total)]
        size = total - whole
        if not size:
            continue
        level = levels.choose(size)
        pieces = levels.take(level)
        pieces.append((doc_id, whole, ids[4 * whole :], total))
        if level + size == window:
            yield pieces
        else:
            levels.put(level + size, pieces)
            if levels.n_open > most_open:
                yield from levels.drained()
    yield from levels.drained()


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, most_open: int = MOST_OPEN, by_word: bool = True, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Pack ``docs`` (doc_id long, text string) into sequences of ``window`` ids; one row per piece, ids included.

    There is no shuffle: texts are read, encoded and packed in one pass, and a lost task packs the same rows again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, by_word, cache_bytes).encode
        end = np.array([END_ID], "<u4").tobytes()
        base = 0

        def documents() -> Iterator[tuple[int, bytes]]:
            nonlocal base
            for batch in in_chunks(iter(batches), "text", 2 << 20):
                base = batch["_task"][0].as_py() << 40
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(utf8(batch["text"])), strict=True):
                    yield doc_id, ids + end

        rows: list[tuple] = []
        held = 0
        for number, pieces in enumerate(packed(documents(), window, most_open)):
            offset = 0
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids) // 4, ids, total, base + number, offset))
                offset += len(ids) // 4
            held += offset
            if held > 1 << 20:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text", F.spark_partition_id().alias("_task")).mapInArrow(tidied(run), PIECES)
