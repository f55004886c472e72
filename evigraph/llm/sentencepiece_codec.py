"""Operator 1: SentencePiece encoding and decoding, in batches of words.

Words of one length form a matrix of code points and advance together. Prefix
sums of a polynomial give the hash of every substring; sorted piece keys are
probed for it. ``viterbi`` fills best scores and backpointers column by column;
that is how unigram models encode. Models of type BPE define their ids by
merges, which no sum of piece scores reproduces, so for those ``merge`` joins
each word's best neighbours, again for all words of a length at once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix

SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longer words are merged one by one, with a heap.
_LONG = 512
_UNKNOWN_PENALTY = 10.0


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))])


class PieceModel:
    """The pieces of a .model file, as sorted hash keys with ids and scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.bpe = _is_bpe(f.read())
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        usual = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in usual}
        self.split = self._splitter().findall
        self.longest = max(map(len, self.ids), default=1)
        self.shown = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        keys = np.array([self._key(self.pieces[i]) for i in usual], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(usual)[order]
        self.key_scores = np.array([model.get_score(i) for i in usual])[order]
        self.scores = {self.pieces[i]: model.get_score(i) for i in usual}
        self.worst = float(self.key_scores.min()) - _UNKNOWN_PENALTY
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a key")

    def _splitter(self) -> re.Pattern:
        """Cuts texts where no piece reaches across: before spaces, and before
        runs of those marks that follow only each other within pieces."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile("(?s).+")
        pairs = {(b, c) for p in self.ids for b, c in zip(p, p[1:]) if b != SPACE}
        free = {c for p in self.ids for c in p if not (c.isalpha() or c in "0123456789") and c != SPACE}
        while bad := {c for b, c in pairs if c in free and b not in free}:
            free -= bad
        own = "".join(map(re.escape, sorted(free)))
        return re.compile(f"{SPACE}*[{own}]+[^{SPACE}{own}]*|{SPACE}*[^{SPACE}{own}]+|{SPACE}+" if own else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @staticmethod
    def _key(piece: str) -> int:
        codes = np.array([*map(ord, piece)], np.uint64)
        return int(mix((codes * _powers(_BASE, len(codes))[: len(codes)]).sum()[None] + np.uint64(len(codes)))[0])

    def probe(self, sums: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, down: np.ndarray) -> np.ndarray:
        """Place among the sorted keys of each substring, or -1."""
        key = mix((sums[row, end] - sums[row, start]) * down[start] + (end - start).astype(np.uint64))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (end - start <= self.longest), at, -1)

    def _prefix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, length).astype(np.uint64)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum(codes * _powers(_BASE, length)[:length], axis=1, out=sums[:, 1:])
        return sums, _powers(_BASE_INVERSE, length)

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The segmentation with the greatest sum of scores, of words of one
        length: at each piece's first character its end and its id (or -1), at
        other places 0. Ties go to the longer last piece."""
        sums, down = self._prefix(words)
        n, length = len(words), len(words[0])
        every = np.arange(n)
        best, back, piece = np.full((n, length + 1), -np.inf), np.zeros((n, length + 1), np.int64), np.full((n, length + 1), -1)
        best[:, 0] = 0
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - self.longest), end)
            row, start = np.repeat(every, len(starts)), np.tile(starts, n)
            at = self.probe(sums, row, start, np.full(len(row), end), down).reshape(n, -1)
            score = np.where(at >= 0, self.key_scores[at], -np.inf)
            score[:, -1] = np.where(at[:, -1] >= 0, score[:, -1], self.worst)
            total = best[:, starts] + score
            pick = total.argmax(axis=1)
            best[:, end], back[:, end] = total[every, pick], starts[pick]
            chosen = at[every, pick]
            piece[:, end] = np.where(chosen >= 0, self.key_ids[chosen], -1)
        ends = np.zeros((n, length), np.int64)
        ids = np.full((n, length), -1)
        row, end = every, np.full(n, length)
        while len(row):
            start = back[row, end]
            ends[row, start], ids[row, start] = end, piece[row, end]
            row, end = row[start > 0], start[start > 0]
        return ends, ids

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like ``viterbi``, after joining, again and again, each word's
        neighbours whose join is the piece of greatest score, leftmost first."""
        sums, down = self._prefix(words)
        n, length = len(words), len(words[0])
        ends = np.tile(np.arange(1, length + 1), (n, 1))
        before = np.tile(np.arange(-1, length), (n, 1))
        score = np.full((n, length), -np.inf)

        def rate(row: np.ndarray, start: np.ndarray) -> None:
            middle = ends[row, start]
            inner = middle < length
            row, start, middle = row[inner], start[inner], middle[inner]
            at = self.probe(sums, row, start, ends[row, middle], down)
            score[row, start] = np.where(at >= 0, self.key_scores[at], -np.inf)

        row, start = np.divmod(np.arange(n * (length - 1)), max(1, length - 1))
        rate(row, start)
        active = np.arange(n)
        while len(active) and length > 1:
            start = score[active].argmax(axis=1)
            some = score[active, start] > -np.inf
            active, start = active[some], start[some]
            middle = ends[active, start]
            end = ends[active, middle]
            ends[active, start], ends[active, middle] = end, 0
            score[active, middle] = score[active, start] = -np.inf
            before[active, end] = start
            rate(active, start)
            earlier = before[active, start]
            rate(active[earlier >= 0], earlier[earlier >= 0])
        row, start = np.nonzero(ends)
        at = self.probe(sums, row, start, ends[row, start], down)
        ids = np.full((n, length), -1)
        ids[row, start] = np.where(at >= 0, self.key_ids[at], -1)
        return ends, ids

    def merge_long(self, word: str) -> list[tuple[int, int, int]]:
        """``merge`` of one word by a heap of neighbours."""
        n = len(word)
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        heap: list[tuple[float, int, int]] = []

        def offer(start: int) -> None:
            if start >= 0 and ends[start] < n and (s := self.scores.get(word[start : ends[ends[start]]])) is not None:
                heapq.heappush(heap, (-s, start, ends[ends[start]]))

        for i in range(n):
            offer(i)
        while heap:
            _, start, end = heapq.heappop(heap)
            if ends[start] and ends[start] < n and ends[ends[start]] == end:
                middle = ends[start]
                ends[start], ends[middle] = end, 0
                before[end] = start
                offer(start)
                offer(before[start])
        spans, start = [], 0
        while start < n:
            spans.append((start, ends[start], self.ids.get(word[start : ends[start]], -1)))
            start = ends[start]
        return spans

    def _blob(self, word: str, spans: list[tuple[int, int, int]]) -> bytes:
        ids: list[int] = []
        for start, end, i in spans:
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in word[start:end].encode())
            else:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def encode_words(self, words: list[str], viterbi: bool) -> dict[str, bytes]:
        """The ids of every word, little-endian unsigned 32-bit."""
        by_length: dict[int, list[str]] = {}
        out = {}
        for w in words:
            if len(w) > _LONG and not viterbi:
                out[w] = self._blob(w, self.merge_long(w))
            else:
                by_length.setdefault(len(w), []).append(w)
        run: Callable = self.viterbi if viterbi else self.merge
        for length, same in by_length.items():
            step = max(1, 400_000 // (length * (min(length, self.longest) if viterbi else 1)))
            for i in range(0, len(same), step):
                part = same[i : i + step]
                ends, ids = run(part)
                used = ends > 0
                cut = np.concatenate([[0], np.cumsum(used.sum(axis=1))]) * 4
                blob, at = ids[used].astype("<u4").tobytes(), cut.tolist()
                out.update(zip(part, map(lambda s, e: blob[s:e], at[:-1], at[1:]), strict=True))
                for j in np.flatnonzero((used & (ids < 0)).any(axis=1)).tolist():
                    start = np.flatnonzero(used[j])
                    out[part[j]] = self._blob(part[j], list(zip(start.tolist(), ends[j, start].tolist(), ids[j, start].tolist(), strict=True)))
        return out

    def decode(self, blob: bytes) -> str:
        """The text of ids; the space that encoding put first is taken off."""
        shown = self.shown
        text = b"".join([shown[i] for i in np.frombuffer(blob, "<u4").tolist()]).decode("utf-8", "replace")
        return text.removeprefix(" ")


def _is_bpe(model: bytes) -> bool:
    """trainer_spec.model_type (field 2, then 3) of a model file is BPE (2)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                value |= (data[at] & 0x7F) << shift
                at, shift = at + 1, shift + 7
                if not data[at - 1] & 0x80:
                    return value

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                many = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, data[at : at + many]
                at += many

    trainer = next((v for k, v in fields(model) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1) == 2


_models: dict[str, tuple[PieceModel, dict[bool, dict[str, bytes]]]] = {}
KEEP = 600_000
#: Documents that are encoded together.
STEP = 512


def _loaded(path: str) -> tuple[PieceModel, dict[bool, dict[str, bytes]]]:
    if path not in _models:
        _models[path] = (PieceModel(path), {False: {}, True: {}})
    return _models[path]


def split_texts(texts: list[str | None], path: str) -> list[list[str]]:
    """Every text's words, spaces shown; none for null and ""."""
    split = _loaded(path)[0].split
    return [split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]


def encode_texts(texts: list[str | None], path: str, viterbi: bool, words: list[list[str]] | None = None) -> list[bytes]:
    """The ids of every text; words met before are remembered by the worker.
    ``words`` are the texts' words, if they are split already."""
    model, memory = _loaded(path)
    known = memory[viterbi]
    words = split_texts(texts, path) if words is None else words
    if len(known) > KEEP:
        known.clear()
    new = model.encode_words(list(dict.fromkeys(w for ws in words for w in ws if w not in known)), viterbi)
    known.update((w, b) for w, b in new.items() if len(w) <= 64)
    return [b"".join([known[w] if w in known else new[w] for w in ws]) for ws in words]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, viterbi_ids) of ``docs(doc_id, text)``.

    ``ids`` are what the model's own algorithm gives: merges for BPE, Viterbi
    for unigram models; ``viterbi_ids`` the path of greatest total score. Both
    are little-endian unsigned 32-bit integers. The text gets one space in
    front and spaces are written as U+2581; other normalisation than identity
    is not applied. Characters without a piece become byte pieces, or the
    unknown id. Null and empty texts have no ids. Rows are encoded where they
    are read, without a shuffle; repeated rows repeat, and ids may tie or be
    null. A text of any length is encoded whole, its words in batches. An empty
    table gives no rows; other columns are not read.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                yield _encoded(batch.slice(at, STEP), model)

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids binary, viterbi_ids binary")


def _encoded(part: pa.RecordBatch, model: str) -> pa.RecordBatch:
    texts = part.column(1).to_pylist()
    words = split_texts(texts, model)
    viterbi = encode_texts(texts, model, True, words)
    ids = encode_texts(texts, model, False, words) if _loaded(model)[0].bpe else viterbi
    return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(viterbi, pa.binary())], names=["doc_id", "ids", "viterbi_ids"])


def _decoded(part: pa.RecordBatch, model: str) -> pa.RecordBatch:
    pieces = _loaded(model)[0]
    texts = [pa.array([None if b is None else pieces.decode(b) for b in part.column(c).to_pylist()], pa.string()) for c in (1, 2)]
    return pa.RecordBatch.from_arrays([*part.columns, *texts], names=["doc_id", "ids", "viterbi_ids", "text", "viterbi_text"])


_TEXTS = "doc_id long, ids binary, viterbi_ids binary, text string, viterbi_text string"


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded(doc_id, ids, viterbi_ids)`` with the texts that both stand
    for; null ids decode to null."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                yield _decoded(batch.slice(at, STEP), model)

    return encoded.select("doc_id", "ids", "viterbi_ids").mapInArrow(decoded, _TEXTS)


def round_trip_documents(docs: DataFrame, model: str) -> DataFrame:
    """``decode_documents(encode_documents(docs))`` in one Python worker, so
    that ids do not pass through the JVM in between. Nulls, empty and long texts,
    repeated rows, empty tables and other columns are as there."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                yield _decoded(_encoded(batch.slice(at, STEP), model), model)

    return docs.select("doc_id", "text").mapInArrow(both, _TEXTS)
