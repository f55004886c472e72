"""Operator 11: product codes of vectors by Yinyang Lloyd in integers.

Lloyd's rounds assign every part of a vector to the nearest entry of its part's
codebook. Here entries are clustered into groups first, and a row keeps one
lower bound for each group: how near any entry of it, its own left out, can be.
After a round a bound falls by how far the group's entries have moved at most;
only groups whose bound no longer exceeds the exact distance to the row's own
entry are scanned. Bounds are rounded so that they never claim too much, and
whatever is scanned, ties among them, is settled by integer distances, so the
codes are those of plain Lloyd.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, small, stored
from .neighbours import matrix

#: Parts of a vector, entries of a codebook, rounds, and what components are
#: multiplied with before they are rounded down.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of a codebook, which is the number of bounds a row keeps for a part.
GROUPS = 16
#: Rows that are assigned together.
BLOCK = 4096


@dataclass
class Books:
    """Codebooks (part, entry, component) of integers as ``kind``, float64 where
    all sums stay below 2**52 and int64 beyond, the group of each entry, and how
    far each group's entries have moved at most since the round before."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def moved(self, entries: np.ndarray) -> Books:
        way = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)
        drift = np.zeros_like(self.drift)
        for p, of in enumerate(self.group):
            np.maximum.at(drift[p], of, way[p])
        return Books(entries, self.group, drift)


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> Books:
    """``entries`` with their groups, by k-means among them; any grouping gives
    the same codes."""
    of = np.zeros(entries.shape[:2], np.int64)
    for p, book in enumerate(entries.astype(np.float64)):
        centres = book[np.linspace(0, len(book) - 1, min(groups, len(book))).astype(int)]
        for _ in range(rounds):
            of[p] = ((book[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
            for g in np.unique(of[p]):
                centres[g] = book[of[p] == g].mean(axis=0)
    return Books(entries, of, np.zeros((len(entries), groups)))


def _squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``book``."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)


def _down(bound: np.ndarray) -> np.ndarray:
    return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


def assign(x: np.ndarray, own: np.ndarray | None, bounds: np.ndarray | None, book: np.ndarray, group: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, bounds, squared distance, distances computed) of rows of one part.

    ``own`` and ``bounds`` are the entries and bounds of the round before, None
    in the first. Nearest is the exact smallest distance, ties to the lower index.
    """
    n = len(x)
    most = np.inf if x.dtype.kind == "f" else np.iinfo(np.int64).max
    if own is None:
        own, at_own = np.full(n, -1), np.full(n, most, x.dtype)
        low = np.full((n, len(drift)), -np.inf)
    else:
        at_own = ((x - book[own]) ** 2).sum(axis=1)
        low = bounds.astype(np.float64) - drift
    best, best_at, work = own.copy(), at_own.copy(), n
    reach = np.sqrt(at_own.astype(np.float64)) * (1 + 1e-12)
    second = np.full(n, most, x.dtype)
    for g in range(len(drift)):
        members = np.flatnonzero(group == g)
        if not len(members):
            low[:, g] = np.inf
            continue
        near = np.flatnonzero(low[:, g] <= reach)
        if not len(near):
            continue
        far = _squared(x[near], book[members])
        work += far.size
        # a row's own entry is known already
        far[members == own[near][:, None]] = most
        first = far.argmin(axis=1)
        least = far[np.arange(len(near)), first]
        low[near, g] = np.sqrt(least.astype(np.float64))
        far[np.arange(len(near)), first] = most
        index = members[first]
        wins = (least < best_at[near]) | ((least == best_at[near]) & ((index < best[near]) | (best[near] < 0)) & (least < most))
        won = near[wins]
        best[won], best_at[won] = index[wins], least[wins]
        second[won] = far[wins].min(axis=1)
    changed = np.flatnonzero(best != own)
    # the new own entry leaves its group's bound to the group's next, and the
    # old one joins its group's bound
    low[changed, group[best[changed]]] = np.sqrt(second[changed].astype(np.float64))
    known = changed[own[changed] >= 0]
    old = group[own[known]]
    low[known, old] = np.minimum(low[known, old], np.sqrt(at_own[known].astype(np.float64)))
    return best, _down(low), best_at, work


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            yield whole.slice(at, BLOCK)


def _integers(column: pa.Array, scale: int, kind: str) -> np.ndarray:
    return np.floor(matrix(column) * scale).astype(kind)


@dataclass
class Codes:
    """``rows`` has vec_id, label, code (one byte for each part) and error;
    ``books`` the final entries (part, entry, component), as integers."""

    rows: DataFrame
    books: np.ndarray


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, groups: int = GROUPS) -> Codes | None:
    """Codes of ``vectors(vec_id, embedding, label)``; None if no row is left.

    Rows whose vector is null, empty, of another length than most, or holds
    null or non-finite components are dropped. Components become
    floor(``scale`` * x). A part's codebook starts as that part of the rows with
    the ``entries`` smallest vec_ids (ties by the vector, null ids last; with
    fewer rows it has fewer entries), and each of ``rounds`` rounds assigns all
    rows and replaces entries by the floor of their rows' mean, unused ones
    excepted. Repeated rows count each; labels may be null. Other columns are
    not read. A round reads the rows with their entries and bounds from a
    table and writes the next one, which replaces it; sums come back as one
    short row for each entry. Vectors whose length is no multiple of ``parts``
    are refused, and so are components so large that a squared distance
    might exceed a long.
    """
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where(F.coalesce(whole, F.lit(False)) & (F.size("embedding") > 0))
    largest = F.max(F.array_max(F.transform("embedding", lambda c: F.abs(c.cast("double")))))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), largest.alias("largest")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return None
    d, bound = sizes["d"], 4 * sizes["d"] * (sizes["largest"] * scale + 1) ** 2
    if d % parts:
        raise ValueError(f"vectors of {d} components have no {parts} equal parts")
    if bound >= 2**62:
        raise ValueError("components are too large: squared distances might exceed a long")
    kind = "f8" if bound < 2**52 else "i8"
    rows = rows.where(F.size("embedding") == d)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    start = _integers(first.column("embedding"), scale, kind)
    books = grouped(np.stack(np.split(start, parts, axis=1)), groups)

    names = ["vec_id", "label", "embedding", "own", "bounds", "error"]
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], vectors.schema["embedding"], T.StructField("own", T.BinaryType()), T.StructField("bounds", T.BinaryType()), T.StructField("error", T.LongType())])

    def assigned(table: DataFrame, known, last: bool) -> DataFrame:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = known.value
            for batch in _rows(batches):
                n = batch.num_rows
                x = np.split(_integers(batch.column("embedding"), scale, kind), parts, axis=1)
                own, bounds = [None] * parts, [None] * parts
                if "own" in batch.schema.names:
                    own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(n, parts).T.astype(np.int64)
                    bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float32).reshape(n, parts, -1).transpose(1, 0, 2)
                found = [assign(x[p], own[p], bounds[p], now.entries[p], now.group[p], now.drift[p]) for p in range(parts)]
                code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                kept = np.stack([f[1] for f in found], axis=1).reshape(n, -1)
                error = sum(f[2].astype(np.int64) for f in found)
                out = [batch.column("vec_id"), batch.column("label"), batch.column("embedding"), pa.array([r.tobytes() for r in code], pa.binary())]
                out += [pa.nulls(n, pa.binary()) if last else pa.array([r.tobytes() for r in kept], pa.binary()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=names)

        return table.mapInArrow(of, schema)

    width = d // parts

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in _rows(batches):
            x = np.split(_integers(batch.column("embedding"), scale, "i8"), parts, axis=1)
            own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                order = np.argsort(own[:, p], kind="stable")
                used, begin = np.unique(own[order, p], return_index=True)
                sums[p, used] += np.add.reduceat(x[p][order], begin, axis=0)
                counts[p] += np.bincount(own[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    table = rows
    for _ in range(rounds):
        before, table = table, stored(assigned(table, spark.sparkContext.broadcast(books), False), "vector_rounds")
        forget(before)
        partial = table.select("embedding", "own").mapInArrow(summed, "part int, entry int, n long, s array<long>")
        total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
        fresh = books.entries.copy()
        for r in total.collect():
            fresh[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        books = books.moved(fresh)
    coded = stored(assigned(table, spark.sparkContext.broadcast(books), True).select("vec_id", "label", F.col("own").alias("code"), "error"), "vector_codes")
    forget(table)
    return Codes(coded, books.entries.astype(np.int64))


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The integer vectors that ``codes`` (row, part) stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows(label, error)`` and whatever else, with label_error: the errors of
    all rows of its label summed; null labels are one label."""
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(small(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
