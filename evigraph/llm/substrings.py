"""Operator 5: removal of word windows that repeat anywhere in the corpus.

Documents are dealt to chunks by a hash of their content. A chunk rolls a
Rabin-Karp hash over every window of its documents and sends each hash once to
the bucket that owns its range; a bucket counts and answers each chunk with the
places of hashes that other chunks sent too. Chunks then merge repeated windows
to maximal intervals and cut them. A passage in every document is sent once by
each chunk, so no bucket grows with a passage's copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix

#: Odd multiplier of the rolling polynomial modulo 2**64, and its inverse.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Most rows and bytes of a chunk and of a bucket, on average.
CHUNK_DOCS, CHUNK_BYTES = 1000, 8 << 20
BUCKET_DOCS, BUCKET_BYTES = 4000, 32 << 20
_LONG_WORD = 64


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word's bytes, eight bytes at a time."""
    padded = np.concatenate([words.bytes, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(words.bytes) + 1,), "<u8", padded, strides=(1,))
    size = words.end - words.start
    out = mix(size.astype(np.uint64) * np.uint64(MULTIPLIER))
    todo = np.flatnonzero(size <= _LONG_WORD)
    for at in range(0, _LONG_WORD, 8):
        todo = todo[size[todo] > at]
        lane = lanes[words.start[todo] + at]
        short = (np.uint64(8) - np.minimum(size[todo] - at, 8).astype(np.uint64)) * np.uint64(8)
        lane = (lane << short) >> short
        out[todo] = mix(out[todo] ^ mix(lane + np.uint64(at + 1)))
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(words.bytes[words.start[i] : words.end[i]].tobytes())
    return out


def window_hashes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window that lies within one document."""
    n = len(words.start)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up = np.multiply.accumulate(np.full(n, MULTIPLIER, np.uint64))
    down = np.multiply.accumulate(np.full(n, INVERSE, np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes(words) * up, out=sums[1:])
    last = np.repeat(words.first[1:], np.diff(words.first))
    begin = np.flatnonzero(last - np.arange(n) >= window)
    return mix((sums[begin + window] - sums[begin]) * down[begin]), begin


def cut(words: Words, drop: np.ndarray) -> list[str]:
    """Every text's words but those in ``drop``, joined by one space."""
    edge = np.zeros(len(words.bytes) + 1, np.int8)
    kept = ~drop
    np.add.at(edge, words.start[kept], 1)
    np.add.at(edge, words.end[kept] + 1, -1)
    size = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(np.where(kept, words.end - words.start + 1, 0), out=size[1:])
    copy = words.bytes.copy()
    copy[words.end] = 0x20
    whole = copy[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
    ends = size[words.first].tolist()
    return [whole[s : max(s, e - 1)].decode() for s, e in zip(ends[:-1], ends[1:], strict=True)]


def _chunk(table: pa.Table) -> tuple[list, Words]:
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0], r[1] is None, r[1]))
    return [r[0] for r in rows], Words([(r[1] or "").encode() for r in rows])


def dedup_substrings(docs: DataFrame, window: int = 35) -> DataFrame:
    """Removes each word of ``docs(doc_id, text)`` in a window seen elsewhere.

    Returns doc_id, n_words, n_removed and kept_text (kept words joined by one
    space) for every row. A window is ``window`` consecutive words of one
    document; it goes if its words also start anywhere else, the same document
    included, judged on the input. Rows with one id and one text meet in one
    chunk. Null and empty texts have no words and keep ""; a repeated row counts as a repetition; documents shorter than a window
    stay whole. A text of any length is taken whole; an empty table gives no
    rows; other columns are not read. Windows are told apart by a 64-bit hash: for n windows about
    n * n / 2**65 pairs of different windows are expected to be taken as equal.
    """
    rows, held = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks, buckets = max(8, -(-rows // CHUNK_DOCS), -(-held // CHUNK_BYTES)), max(16, -(-rows // BUCKET_DOCS), -(-held // BUCKET_BYTES))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))

    def owners(unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that some of the sorted hashes fall into, and where each
        begins; the last entry is the end."""
        full, begin = np.unique(((unique >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), return_index=True)
        return full.astype(np.int64), np.append(begin, len(unique))

    def send(table: pa.Table) -> pa.Table:
        _, words = _chunk(table)
        unique = np.unique(window_hashes(words, window)[0])
        full, at = owners(unique)
        chunk = table.column("chunk")[0].as_py()
        parts = [unique[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "hashes": pa.array(parts, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        every = np.concatenate(sent)
        order = np.argsort(every, kind="stable")
        same = np.zeros(len(every) + 1, bool)
        ordered = every[order]
        same[1:-1] = ordered[1:] == ordered[:-1]
        seen = np.zeros(len(every), bool)
        seen[order] = same[1:] | same[:-1]
        ends = np.cumsum([len(s) for s in sent])
        answers = [np.flatnonzero(seen[e - len(s) : e]).astype(np.uint32) for s, e in zip(sent, ends, strict=True)]
        some = pa.array([i for i, a in enumerate(answers) if len(a)], pa.int64())
        return pa.table({"chunk": table.column("chunk").take(some), "bucket": table.column("bucket").take(some), "places": pa.array([a.tobytes() for a in answers if len(a)], pa.binary())})

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        doc_ids, words = _chunk(table)
        hashes, begin = window_hashes(words, window)
        unique, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        gone, (full, at) = times > 1, owners(unique)
        for bucket, places in zip(answers.column("bucket").to_pylist(), answers.column("places"), strict=True):
            gone[at[np.searchsorted(full, bucket)] + np.frombuffer(places.as_buffer(), np.uint32).astype(np.int64)] = True
        begin = begin[gone[which]]
        edge = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + window, -1)
        drop = np.cumsum(edge[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(drop)])[words.first]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_words": pa.array(np.diff(words.first), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "kept_text": pa.array(cut(words, drop), pa.string())})

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "chunk int, bucket int, places binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")
