"""Operator 6: packing token pieces by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import encoder

#: Remainders that are packed together, and the size at which halving ends.
POOL, FINEST = 512, 32
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Splits ``sizes`` in ``ways`` groups of near-equal sum; lists of indices.

    Every size begins as a partial partition with one loaded way. The two
    partitions with the greatest spread merge, heaviest way to lightest way,
    until one is left. Ties go to the partition made first.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    joined: list[tuple[int, int]] = []
    heap = []
    for i, s in enumerate(sizes):
        sums, held = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[0], held[0] = s, i
        heap.append((-s if ways > 1 else 0, i, sums, held))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        b, in_b = b[::-1], in_b[::-1]
        both = np.flatnonzero((in_a >= 0) & (in_b >= 0))
        held = np.where(in_a >= 0, in_a, in_b)
        for way in both.tolist():
            joined.append((int(in_a[way]), int(in_b[way])))
            held[way] = len(sizes) + len(joined) - 1
        sums = a + b
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made, sums, held))
        made += 1
    groups = []
    for top in heap[0][3].tolist():
        group, todo = [], [top] if top >= 0 else []
        while todo:
            x = todo.pop()
            if x < len(sizes):
                group.append(x)
            else:
                todo.extend(joined[x - len(sizes)])
        groups.append(sorted(group))
    return groups


def halves(size: int, least: int = FINEST) -> list[int]:
    """``size`` cut in half, one half again, and so on down to ``least``."""
    out = []
    while size > 2 * least:
        out.append(size - size // 2)
        size //= 2
    return [*out, size]


def pack_pool(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, from, length) with at most ``capacity`` each.

    The window count begins at the least that the total needs and rises by one
    while differencing exceeds the capacity, so it ends when each size has a
    window of its own at the latest. Differencing balances with small sizes
    what large ones leave uneven; as many of the largest sizes as there are
    windows are therefore cut in halves first. Cuts of one size that meet in a
    window again are joined.
    """
    least = max(1, -(-sum(sizes) // capacity))
    parts: list[tuple[int, int, int]] = []
    for rank, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        at = 0
        for length in halves(sizes[i]) if rank < least and least > 1 else [sizes[i]]:
            parts.append((i, at, length))
            at += length
    for ways in itertools.count(least):
        groups = difference([p[2] for p in parts], ways)
        if all(sum(parts[g][2] for g in group) <= capacity for group in groups):
            break
    windows = []
    for group in groups:
        window: list[tuple[int, int, int]] = []
        for i, at, length in sorted(parts[g] for g in group):
            if window and window[-1][0] == i and window[-1][1] + window[-1][2] == at:
                window[-1] = (i, window[-1][1], window[-1][2] + length)
            else:
                window.append((i, at, length))
        if window:
            windows.append(window)
    return windows


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, pool: int = POOL, spaces: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of at most ``capacity`` ids.

    A document's full multiples of ``capacity`` are sequences of their own; the
    remainders of ``pool`` documents at a time are packed by differencing.
    Pieces are packed where the table is read: no shuffle, and a task holds one
    pool and one text. Null and empty texts are the end id alone; repeated rows
    are packed each for itself, and null doc_ids like any other; an empty table
    gives no rows. A text of any length is cut like the others; other columns are
    not read. ``sequence_id`` is unique,
    made of the task's number and a count, with gaps.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(tokenizer, spaces), np.uint32(end_id).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def emit(doc_id, blob: bytes, start: int, length: int, offset: int, shift: int) -> None:
            rows.append((doc_id, start, length, zlib.crc32(blob[4 * (start - shift) : 4 * (start - shift + length)]), shift + len(blob) // 4, sequence, offset))

        def drain() -> None:
            nonlocal sequence
            for window in pack_pool([len(w[1]) // 4 for w in waiting], capacity):
                offset = 0
                for i, at, length in window:
                    doc_id, blob, shift = waiting[i]
                    emit(doc_id, blob, shift + at, length, offset, shift)
                    offset += length
                sequence += 1
            waiting.clear()

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blob = tokens.encode(text) + end
                n = len(blob) // 4
                for start in range(0, n - capacity + 1, capacity):
                    emit(doc_id, blob, start, capacity, 0, 0)
                    sequence += 1
                if rest := n % capacity:
                    waiting.append((doc_id, blob[4 * (n - rest) :], n - rest))
                if len(waiting) >= pool:
                    drain()
            if len(rows) >= 4096:
                yield out()
        if waiting:
            drain()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(pieces, PACKED)
