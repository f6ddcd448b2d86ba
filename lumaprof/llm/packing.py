"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Each task packs its own rows, in batches of bounded size, so nothing is shuffled
and no key can be hot. A document's whole windows are cut off first. What is left
of the documents of a batch, cut to an eighth of a window at most, is balanced over
the windows: partial partitions with opposing imbalances are merged, the largest difference first, until one partition
with near-equal windows remains. If a window is over capacity, the window count
rises (and pieces are cut finer where raising it alone would leave much padding).
The last tokens of a task that fill no window go to sequences whose lengths are
powers of two, which need no padding.

A batch ends by cutting a document where its windows are full but for ``margin``
tokens; the rest of the document opens the next batch.

Null texts count as empty (the end id alone); null ids and repeated rows are
packed like any other row; an empty table gives no piece. Long texts are read whole
and fill as many windows as they need. Only the id and text
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumaprof.llm.common import slices
from lumaprof.llm.word_ids import word_ids

#: Windows that one differencing run balances.
BATCH_WINDOWS = 256
#: Tokens left free per window on average, so that small imbalances fit.
MARGIN = 6
#: Pieces that are balanced hold at most this fraction of a window, so that they fit together.
FINEST = 8
#: Pieces that are collected before they become rows: about as many as a differencing run gives.
PIECES = 2_000

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each size, by multiway differencing of all sizes into ``windows`` windows."""
    count = len(sizes)
    if windows == 1:
        return np.zeros(count, np.int64)
    heap = [(-size, node) for node, size in enumerate(sizes)]
    heapq.heapify(heap)
    loads: dict[int, np.ndarray] = {}
    merged: list[tuple[int, int, np.ndarray]] = []

    def load(node: int) -> np.ndarray:
        if node >= count:
            return loads.pop(node)
        one = np.zeros(windows, np.int64)
        one[-1] = sizes[node]
        return one

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = load(a) + load(b)[::-1]
        order = np.argsort(total, kind="stable")
        total = total[order]
        total -= total[0]
        node = count + len(merged)
        loads[node] = total
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(total[-1]), node))

    places = {heap[0][1]: np.arange(windows)}
    window_of = np.zeros(count, np.int64)
    for node in range(count + len(merged) - 1, count - 1, -1):
        a, b, order = merged[node - count]
        slots = np.empty(windows, np.int64)
        slots[order] = places.pop(node)
        for child, own in ((a, slots), (b, slots[::-1])):
            if child < count:
                window_of[child] = own[-1]
            else:
                places[child] = own
    if not merged:
        window_of[0] = 0
    return window_of


class Packer:
    """Packs the pieces of one task; ``out`` gets (piece, sequence, offset)."""

    def __init__(self, capacity: int, batch_windows: int, margin: int):
        self.capacity, self.goal = capacity, capacity - min(margin, capacity // 8)
        self.batch = batch_windows * self.goal
        self.pieces: list[list] = []
        self.tokens = 0
        self.sequence = 0
        self.out: list[tuple[list, int, int]] = []

    def place(self, pieces: list[list]) -> None:
        at = 0
        for piece in pieces:
            self.out.append((piece, self.sequence, at))
            at += piece[2]
        self.sequence += 1

    def add(self, doc, ids: bytes) -> None:
        """A piece is [document, start, length, all ids of the document]."""
        count, start = len(ids) // 4, 0
        while count - start >= self.capacity:
            self.place([[doc, start, self.capacity, ids]])
            start += self.capacity
        if count > start:
            self.pieces.append([doc, start, count - start, ids])
            self.tokens += count - start
        if self.tokens >= self.batch:
            self.balance(self.taken(self.batch))

    def taken(self, tokens: int) -> list[list]:
        """Pieces with exactly so many tokens; the last one is cut."""
        got, held = [], 0
        for n, piece in enumerate(self.pieces):
            if held + piece[2] >= tokens:
                doc, start, length, ids = piece
                fits = tokens - held
                got.append([doc, start, fits, ids])
                rest = [[doc, start + fits, length - fits, ids]] if length > fits else []
                self.pieces = rest + self.pieces[n + 1:]
                self.tokens -= tokens
                return got
            got.append(piece)
            held += piece[2]
        self.pieces, self.tokens = [], 0
        return got

    def balance(self, pieces: list[list]) -> None:
        total = sum(p[2] for p in pieces)
        windows = -(-total // self.goal)
        finest = max(1, self.capacity // FINEST)
        while True:
            cut = [[d, s + at, min(finest, n - at), ids] for d, s, n, ids in pieces for at in range(0, n, finest)]
            window_of = difference([p[2] for p in cut], windows)
            loads = np.bincount(window_of, [p[2] for p in cut], minlength=windows)
            if loads.max() <= self.capacity:
                break
            windows += 1
            if windows > (total / self.goal) * 1.01 + 1 and finest > 16:
                finest, windows = max(16, finest // 4), -(-total // self.goal) + 1
        grouped: list[list] = [[] for _ in range(windows)]
        for piece, window in zip(cut, window_of):
            grouped[window].append(piece)
        for group in grouped:
            if group:
                self.place(group)

    def finish(self) -> None:
        whole = self.tokens // self.goal
        if whole:
            self.balance(self.taken(whole * self.goal))
        while self.tokens:
            self.place(self.taken(1 << (self.tokens.bit_length() - 1)))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False,
         batch_windows: int = BATCH_WINDOWS, margin: int = MARGIN) -> DataFrame:
    """One row per piece of a document: where it starts, its sequence and its offset there.

    ``with_ids`` adds the piece's ids as little-endian unsigned 32-bit integers.
    A sequence id is the task's number in the high half and a counter in the low one.
    """
    end = end_id.to_bytes(4, "little")
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(tokenizer_path), Packer(capacity, batch_windows, margin)
        base = TaskContext.get().partitionId() << 32

        def rows() -> pa.RecordBatch:
            found, packer.out = packer.out, []
            ids = [p[3][4 * p[1]:4 * (p[1] + p[2])] for p, _, _ in found]
            columns = [[p[0] for p, _, _ in found], [p[1] for p, _, _ in found], [p[2] for p, _, _ in found],
                       [crc32(i) for i in ids], [len(p[3]) // 4 for p, _, _ in found],
                       [base + s for _, s, _ in found], [at for _, _, at in found]]
            arrays = [pa.array(c, pa.int64()) for c in columns] + ([pa.array(ids, pa.binary())] if with_ids else [])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays(arrays, names + (["ids"] if with_ids else []))

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, ids in zip(part.column("doc_id").to_pylist(), words.encode_all(part.column("text"))):
                    packer.add(doc, ids + end)
                    if len(packer.out) >= PIECES:
                        yield rows()
        packer.finish()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
