"""Packing of token documents into fixed windows by best-fit decreasing.

Each task tokenises its rows and packs them block by block, so ids never leave the task that made them and memory is
bounded by the block, not by the partition. In a block, a document longer than a window is first cut into full windows;
the pieces, longest first, then go to the tightest open window, found in a segment tree indexed by remaining capacity.
If a block's padding still exceeds a share of its tokens, its emptiest windows are dissolved into the gaps of the
others, cutting pieces where needed. A block leaves one open window at most of any size beyond that share.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released
from .words import forget

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Open windows under a segment tree over remaining capacity 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the least room of at least need, which is no longer open then."""
        counts, node = self.counts, need + self.leaves
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces, none longer than capacity."""
    open_, windows = Windows(capacity), []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        found = open_.take(piece[2])
        room, window = found or (capacity, len(windows))
        if not found:
            windows.append([])
        windows[window].append(piece)
        if room > piece[2]:
            open_.add(room - piece[2], window)
    return windows


def fill_gaps(windows: list[list[tuple[int, int, int]]], capacity: int, max_padding: float) -> list[list[tuple[int, int, int]]]:
    """Dissolves the emptiest windows into the gaps of the fullest until padding is at most max_padding of the tokens or one gap is left."""
    rooms = sorted(((capacity - sum(p[2] for p in w), w) for w in windows), key=lambda x: x[0])
    spare, tokens = sum(r for r, _ in rooms), sum(p[2] for w in windows for p in w)
    while len(rooms) > 1 and spare > max_padding * tokens and spare >= capacity:
        room, emptiest = rooms.pop()
        spare -= capacity
        at = len(rooms) - 1
        for doc, start, length in emptiest:
            while length:
                while not rooms[at][0]:
                    at -= 1
                gap, window = rooms[at]
                n = min(gap, length)
                window.append((doc, start, n))
                rooms[at] = (gap - n, window)
                start, length = start + n, length - n
        rooms.sort(key=lambda x: x[0])
    return [w for _, w in rooms]


def pack(
    docs: DataFrame,
    tokenizer: Callable[[], Callable[[list[str]], list[bytes]]],
    capacity: int = 2048,
    end_id: int = 1,
    block_tokens: int = 4_000_000,
    max_padding: float = 0.01,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per packed piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer() is called once a worker and gives the function from texts to little-endian unsigned 32-bit ids. Every
    document gets end_id after its ids, so null and empty texts are one token. A row is a document of its own, also if
    its id is null or repeated; other columns are not carried; an empty table gives no rows. Pieces cover every id once;
    offsets in a sequence are gapless from 0. sequence_id joins the partition's number and a counter, so that a lost
    task, run again, replaces all sequences it had made.
    """
    end = np.array([end_id], "<u4").tobytes()

    def packed(ids: list, tokens: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(t) // 4 for t in tokens]
        pieces = [(d, s, min(capacity, n - s)) for d, n in enumerate(lengths) for s in range(0, n, capacity)]
        windows = fill_gaps(best_fit_decreasing(pieces, capacity), capacity, max_padding)
        rows = []
        for k, window in enumerate(windows):
            offset = 0
            for d, s, n in window:
                rows.append((ids[d], s, n, zlib.crc32(tokens[d][4 * s : 4 * (s + n)]), lengths[d], first + k, offset))
                offset += n
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names), len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        sequence = TaskContext.get().partitionId() << 32
        ids, tokens, held = [], [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, raw in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids.append(i)
                tokens.append(raw + end)
                held += len(raw) // 4 + 1
                if held >= block_tokens:
                    out, n = packed(ids, tokens, sequence)
                    yield out
                    sequence, ids, tokens, held = sequence + n, [], [], 0
        if ids:
            yield packed(ids, tokens, sequence)[0]
        ids, tokens = [], []
        forget()
        released()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
