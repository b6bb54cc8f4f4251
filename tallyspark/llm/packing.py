"""Sum-of-squares packing of tokenised documents into fixed windows.

Each input partition packs its own documents in one pass, without a shuffle.
A document longer than the window is cut; its full windows stand alone and the
rest is placed online into the fill level that makes the sum of the squared
counts of partly filled windows smallest, the counts held in a level array. At
the end of a partition the windows still open are merged: pieces of the
emptiest are cut to fill the gaps of the fullest, and the one window that may be left
over becomes sequences whose lengths are powers of two. So no sequence is padded.

Only the pieces of open windows are held; full windows leave at once.

Defined results: a null or empty text is one piece holding the end id alone;
repeated rows are packed once each; an empty table gives no pieces; a null id
passes through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens


class SumOfSquares:
    """Online placement by the sum-of-squares rule over window fill levels."""

    def __init__(self, window: int, first_number: int):
        self.window, self.next = window, first_number
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}  # fill level -> numbers of its windows
        self.held: dict[int, list[tuple]] = {}  # window number -> (document, ids, start) in order

    def choose(self, size: int) -> int:
        """The level to place ``size`` at; 0 opens a window."""
        n, top = self.level, self.window - size
        some = np.flatnonzero(n[1 : top + 1]) + 1
        best, cost = 0, 2 * int(n[size]) + 1
        if len(some):
            change = 2 * (n[some + size] - n[some]) + 2
            if some[-1] == top:  # this one would be full and leave
                change[-1] = 1 - 2 * n[top]
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= cost:
                best = int(some[k])
        return best

    def place(self, document, ids: np.ndarray, start: int) -> Iterator[tuple]:
        """Place a piece shorter than a window; yields a window once it is full."""
        size = len(ids)
        at = self.choose(size)
        if at:
            self.level[at] -= 1
            number = self.open[at].pop()
        else:
            number, self.next = self.next, self.next + 1
            self.held[number] = []
        self.held[number].append((document, ids, start))
        if at + size == self.window:
            yield number, self.held.pop(number)
        else:
            self.level[at + size] += 1
            self.open.setdefault(at + size, []).append(number)

    def close(self) -> Iterator[tuple]:
        """Merge the open windows by cutting pieces of the emptiest ones."""
        left = sorted(self.held.items(), key=lambda x: (sum(len(p[1]) for p in x[1]), x[0]))
        low, high = 0, len(left) - 1
        while low < high:
            number, pieces = left[high]
            gap = self.window - sum(len(p[1]) for p in pieces)
            while gap and low < high:
                document, ids, start = left[low][1].pop()
                cut = max(0, len(ids) - gap)
                if cut:
                    left[low][1].append((document, ids[:cut], start))
                pieces.append((document, ids[cut:], start + cut))
                gap -= len(ids) - cut
                if not left[low][1]:
                    low += 1
            yield number, pieces
            high -= 1
        if low == high:
            yield from self.powers(*left[low])

    def powers(self, number: int, pieces: list[tuple]) -> Iterator[tuple]:
        """The last window as sequences whose lengths are powers of two, which need no padding."""
        size = sum(len(p[1]) for p in pieces)
        rest = pieces[::-1]
        for bit in range(size.bit_length() - 1, -1, -1):
            room, out = size & (1 << bit), []
            while room:
                document, ids, start = rest.pop()
                out.append((document, ids[:room], start))
                if len(ids) > room:
                    rest.append((document, ids[room:], start + room))
                room -= len(out[-1][1])
            if out:
                yield number, out
                number, self.next = self.next, self.next + 1


def _pack(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []
        size = 0

        def emit(number: int, pieces: list[tuple]) -> None:
            nonlocal size
            at = 0
            for (name, total), ids, start in pieces:
                out.append((name, start, len(ids), ids.tobytes(), total, number, at))
                at += len(ids)
            size += at

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 7
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = pa.int64()
        for b in batches:
            id_type = b.column("_id").type
            names = b.column("_id").to_pylist()
            for first, last, flat, offsets in tokens.encoder(path).encode(b.column("_text")):
                for k in range(first, last):
                    ids = np.append(flat[offsets[k - first] : offsets[k - first + 1]], np.uint32(end_id)).astype("<u4")
                    document = (names[k], len(ids))
                    whole = len(ids) // window * window
                    for at in range(0, whole, window):
                        emit(packer.next, [(document, ids[at : at + window], at)])
                        packer.next += 1
                    if whole < len(ids):
                        for full in packer.place(document, ids[whole:], whole):
                            emit(*full)
                if size > 1_000_000:
                    yield batch()
                    out.clear()
                    size = 0
        for full in packer.close():
            emit(*full)
            if size > 1_000_000:
                yield batch()
                out.clear()
                size = 0
        if out:
            yield batch()

    return run


def packed(documents: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents with their place in a sequence of at most ``window`` ids.

    Columns: the id, ``start`` and ``length`` (in the document's ids), ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.
    """
    source = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    out = source.mapInArrow(_pack(tokenizer, window, end_id), f"_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)
