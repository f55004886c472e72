"""Operator 3: token-ID binary output in patched frame-of-reference files.

A file set is a table of segments in the shared folder. A segment holds whole
documents in order and is decoded alone; its payload is::

    magic "PFR1", number of ids, number of blocks        (4 bytes each)
    start of every block in the body, one more at the end (u4 each)
    minimum of every block (u4), its width (u1)
    body: the block's low bits packed in 64-bit words, then the number of
    exceptions (u4), their places (u1) and high parts (u4)

Blocks have 128 ids, the last one filled with its own last id. Each block
subtracts its minimum; its width is the bits of the 90th, 95th, 98th or last
percentile of what is left, whichever gives the smallest block, and what does
not fit goes to the exception list.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .tokens import encoder

BLOCK = 128
PERCENTILES = (90, 95, 98, 100)
SEGMENT_IDS = 1 << 20
_MAGIC = 0x31524650


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """The payload of one segment; ``ids`` are unsigned 32-bit integers."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = np.array([_MAGIC, n, blocks], "<u4").tobytes()
    if not n:
        return head + np.zeros(1, "<u4").tobytes()
    full = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], np.uint32)]).reshape(blocks, BLOCK).astype(np.uint64)
    low = full.min(axis=1)
    rest = full - low[:, None]
    ordered = np.sort(rest, axis=1)
    width, cost = np.zeros(blocks, np.int64), np.full(blocks, 1 << 40)
    for p in PERCENTILES:
        w = _bits(ordered[:, p * (BLOCK - 1) // 100])
        size = 16 * w + 5 * (rest >= (np.uint64(1) << w.astype(np.uint64))[:, None]).sum(axis=1)
        width, cost = np.where(size < cost, w, width), np.minimum(size, cost)
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        columns = np.ascontiguousarray(rest[of].T)
        words = np.zeros((2 * int(w), len(of)), np.uint64)
        mask = np.uint64((1 << int(w)) - 1)
        for i in range(BLOCK if w else 0):
            word, shift = divmod(i * int(w), 64)
            value = columns[i] & mask
            words[word] |= value << np.uint64(shift)
            if shift + w > 64:
                words[word + 1] |= value >> np.uint64(64 - shift)
        packed = np.ascontiguousarray(words.T).astype("<u8")
        block, place = np.nonzero(rest[of] > mask)
        high = (rest[of][block, place] >> np.uint64(w)).astype("<u4")
        cut = np.searchsorted(block, np.arange(len(of) + 1))
        for j, b in enumerate(of):
            s, e = cut[j], cut[j + 1]
            bodies[b] = packed[j].tobytes() + np.uint32(e - s).tobytes() + place[s:e].astype(np.uint8).tobytes() + high[s:e].tobytes()
    starts = np.zeros(blocks + 1, "<u4")
    np.cumsum([len(b) for b in bodies], out=starts[1:])
    return b"".join([head, starts.tobytes(), low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), *bodies])


def unpack(payload: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of blocks ``first_block`` up to ``last_block`` (not included)."""
    magic, n, blocks = np.frombuffer(payload, "<u4", 3)
    if magic != _MAGIC:
        raise ValueError("not a token segment")
    blocks = int(blocks)
    starts = np.frombuffer(payload, "<u4", blocks + 1, 12).astype(np.int64)
    low = np.frombuffer(payload, "<u4", blocks, 16 + 4 * blocks).astype(np.uint64)
    width = np.frombuffer(payload, np.uint8, blocks, 16 + 8 * blocks)
    body = np.frombuffer(payload, np.uint8, offset=16 + 9 * blocks)
    last_block = blocks if last_block is None else min(last_block, blocks)
    out = np.zeros((max(0, last_block - first_block), BLOCK), np.uint64)
    for w in np.unique(width[first_block:last_block]).tolist():
        of = first_block + np.flatnonzero(width[first_block:last_block] == w)
        raw = body[starts[of][:, None] + np.arange(16 * w)] if w else np.zeros((len(of), 0), np.uint8)
        words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T) if w else None
        mask = np.uint64((1 << w) - 1)
        values = np.zeros((BLOCK, len(of)), np.uint64)
        for i in range(BLOCK if w else 0):
            word, shift = divmod(i * w, 64)
            value = words[word] >> np.uint64(shift)
            if shift + w > 64:
                value = value | (words[word + 1] << np.uint64(64 - shift))
            values[i] = value & mask
        out[of - first_block] = values.T
    for b in np.flatnonzero(starts[first_block + 1 : last_block + 1] - starts[first_block:last_block] > 16 * width[first_block:last_block].astype(np.int64) + 4):
        w = int(width[first_block + b])
        at = int(starts[first_block + b]) + 16 * w
        many = int(body[at : at + 4].view("<u4")[0])
        place = body[at + 4 : at + 4 + many]
        high = np.frombuffer(body[at + 4 + many : at + 4 + 5 * many].tobytes(), "<u4").astype(np.uint64)
        out[b, place] |= high << np.uint64(w)
    out += low[first_block:last_block, None]
    end = int(n) - first_block * BLOCK if last_block == blocks else out.size
    return out.reshape(-1)[:end].astype(np.uint32)


SEGMENTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, segment_ids: int = SEGMENT_IDS, spaces: bool = True) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and writes segments in doc_id order.

    Returns the written table (schema ``SEGMENTS``): segments of range
    ``part`` hold smaller doc_ids than those of ``part + 1``, and
    ``part_start`` counts the ids before a segment in its part. Null and empty
    texts have the end id alone; a null doc_id sorts first; rows that share a
    doc_id stand next to each other, by text. A text of any length is one entry of one
    segment. An empty table gives no segments, which read back as no rows. Only the two columns are read, whatever else the table holds.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(tokenizer, spaces), np.uint32(end_id).tobytes()
        part, written = TaskContext.get().partitionId(), 0
        names: list = []
        lengths: list[int] = []
        blobs: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(blobs), "<u4"))
            row = [[part], [written], [held], [names], [lengths], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=SEGMENTS.names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blob = tokens.encode(text) + end
                names.append(doc_id)
                lengths.append(len(blob) // 4)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= segment_ids:
                    yield flush()
                    written, names, lengths, blobs, held = written + held, [], [], [], 0
        if names:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(segments, SEGMENTS), "token_files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Decodes segments: (doc_id, start, n_tokens, ids_crc32) per document.

    ``start`` counts the ids of all documents before it; null doc_ids come first,
    rows of one doc_id are documents of their own, and a null or empty text has
    its end id. No segments give no rows. The totals of the
    parts (one short row each, as many as the writer had tasks) are summed in
    order and sent to every reader.
    """
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("t")).collect()
    before, base = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        before[row["part"]], base = base, base + row["t"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, _, doc_ids, lengths, payload = (batch.column(k)[i] for k in range(6))
                n = np.array(lengths.values.to_numpy(), np.int64)
                ends = np.cumsum(n)
                ids = unpack(payload.as_py()).astype("<u4").tobytes()
                crc = [zlib.crc32(ids[4 * (e - k) : 4 * e]) for k, e in zip(n.tolist(), ends.tolist(), strict=True)]
                first = before[part.as_py()] + start.as_py()
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select(*SEGMENTS.names).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
