"""Operator 10: nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

#: Codebooks, entries of each, and the beam of the encoder.
BOOKS, ENTRIES, BEAM = 16, 256, 4
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 16_384
#: Rows that are encoded and scored together, and the share that is reranked.
BLOCK, RERANK = 4096, 0.08
#: Queries that are scored together.
TOGETHER = 32
#: Queries that are sent to all executors together (8 bytes a component).
QUERY_BLOCK = 16_384


def fit(sample: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Full-dimensional residual codebooks (books, entries, dimension): k-means
    on what the books before leave of the sample. Entry 0 is the zero vector,
    so a further book never makes a vector worse."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float64)
    out = np.zeros((books, entries, sample.shape[1]))
    for m in range(books):
        many = min(entries - 1, len(rest))
        centres = np.concatenate([np.zeros((1, rest.shape[1])), rest[rng.choice(len(rest), many, replace=False)]])
        for _ in range(rounds):
            near = (2 * rest @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            counts = np.bincount(near, minlength=len(centres))
            some = counts > 0
            some[0] = False
            centres[some] = sums[some] / counts[some, None]
        out[m, : len(centres)] = centres
        rest = rest - centres[(2 * rest @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)]
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norms of what the codes stand for) by beam search: for
    each book the ``beam`` best sums so far try every entry."""
    n, (many, entries, _) = len(x), books.shape
    codes = np.zeros((n, 1, 0), np.int64)
    rest = x[:, None, :].astype(np.float64)
    for m in range(many):
        width = rest.shape[1]
        error = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest.reshape(n * width, -1) @ books[m].T).reshape(n, width, entries) + (books[m] ** 2).sum(axis=1)
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
        way, entry = np.divmod(best, entries)
        row = np.arange(n)[:, None]
        codes = np.concatenate([codes[row, way], entry[:, :, None]], axis=2)
        rest = rest[row, way] - books[m][entry]
    best = (rest**2).sum(axis=2).argmin(axis=1)
    codes = codes[np.arange(n), best].astype(np.uint16)
    stands = sum(books[m][codes[:, m]] for m in range(many))
    return codes, (stands**2).sum(axis=1)


def _valid(vectors: DataFrame, dimension: int) -> DataFrame:
    whole = F.col("embedding").isNotNull() & (F.size("embedding") == dimension) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull()).where(F.coalesce(whole, F.lit(False))).where(F.exists("embedding", lambda c: c != 0))


def _encoded(valid: DataFrame, learnt) -> DataFrame:
    """``valid`` with every row's code (one 16-bit entry for each codebook) and
    the squared norm of what the code stands for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                codes, norms = encode(matrix(batch.column(1)), learnt.value)
                code = pa.array([row.tobytes() for row in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), code, pa.array(norms)], names=["vec_id", "embedding", "code", "norm"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), valid.schema["embedding"], T.StructField("code", T.BinaryType()), T.StructField("norm", T.DoubleType())])
    return valid.mapInArrow(of, schema)


def search(vectors: DataFrame, divisor: int = 100, k: int = 10, rerank: float = RERANK, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest rows of every query, over ``vectors(vec_id, embedding)``.

    Queries are the rows whose vec_id is divisible by ``divisor``, against all
    other rows. Returns query_id, rank (from 1), vec_id and score, the Euclidean
    distance in double precision; ties go to the smaller vec_id. Every row is
    encoded once, and written with its code and norm; codebooks are fitted on at most ``sample`` rows, those with the
    smallest hashes of vec_id. Rows are scored in blocks of ``BLOCK`` from
    look-up tables, the best ``rerank`` of a block (64 at least, and all that tie
    with the last) by the exact distance; of equal vectors only the smallest
    ids take places. So quality does not depend on the table's size. Queries go out
    ``QUERY_BLOCK`` at a time, each such block in a pass over the table. Vectors
    that are null, zero, of another length than most, or with null or
    non-finite components, or without a vec_id take no part; rows that share a
    vec_id are rows of their own, but none is a candidate of a query of that
    vec_id. No rows give no result. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    valid = _valid(vectors, sizes["d"])
    picked = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], schema)
    learnt = spark.sparkContext.broadcast(fit(matrix(picked.column("embedding"))))
    coded = stored(_encoded(valid, learnt), "vector_codes")
    asked = coded.where(F.col("vec_id") % divisor == 0).select("vec_id", "embedding")
    blocks = -(-asked.count() // QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], schema)
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = part.orderBy("vec_id").toArrow()
        if got.num_rows:
            found = _scored(coded, learnt, spark.sparkContext.broadcast((got.column("vec_id").to_numpy(), matrix(got.column("embedding")))), k, rerank)
            out = found if out is None else out.union(found)
    order = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _first_copies(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that may be among the ``k`` nearest: of equal vectors
    those of the ``k + 1`` smallest ids, as one may be the query's, and ``k`` of each id."""
    vector = np.unique(np.ascontiguousarray(rows + 0.0).view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, vector))
    vector, ids, at = vector[order], ids[order], np.arange(len(ids))
    first = np.append(True, vector[1:] != vector[:-1])
    fresh = first | np.append(True, ids[1:] != ids[:-1])
    number = np.cumsum(fresh)
    of_vector = number - np.maximum.accumulate(np.where(first, number, 0))
    of_id = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return order[(of_vector <= k) & (of_id < k)]


def _scored(coded: DataFrame, learnt, asked, k: int, rerank: float) -> DataFrame:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                parts.append((batch.column(0).to_numpy(), matrix(batch.column(1)), codes, batch.column(3).to_numpy()))
                held += batch.num_rows
            if held >= BLOCK:
                yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                parts, held = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*parts, strict=True)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, (query_ids, queries) = learnt.value, asked.value
        best_id = np.full((len(query_ids), 0), -1)
        best = np.zeros((len(query_ids), 0))
        for ids, rows, codes, norms in blocks(batches):
            short = max(64, k + 1, int(rerank * len(ids)))
            some = _first_copies(ids, rows, k)
            ids, rows, codes, norms, short = ids[some], rows[some], codes[some], norms[some], min(len(some), short)
            new_id, new = np.full((len(queries), k), -1), np.full((len(queries), k), np.inf)
            for at in range(0, len(queries), TOGETHER):
                some = queries[at : at + TOGETHER]
                score = np.tile(norms, (len(some), 1))
                for m in range(len(books)):
                    # a query's table: its inner product with each entry of the book
                    score -= (2 * some @ books[m].T)[:, codes[:, m]]
                # rows that tie with the last place are all in
                last = np.partition(score, short - 1, axis=1)[:, short - 1]
                for q, (own, limit) in enumerate(zip(score, last, strict=True), at):
                    near = np.flatnonzero(own <= limit)
                    exact = np.sqrt(((rows[near] - queries[q]) ** 2).sum(axis=1))
                    exact[ids[near] == query_ids[q]] = np.inf
                    order = np.lexsort((ids[near], exact))[:k]
                    new_id[q, : len(order)], new[q, : len(order)] = ids[near][order], exact[order]
            best_id, best = np.concatenate([best_id, new_id], axis=1), np.concatenate([best, new], axis=1)
            order = np.lexsort((best_id, best), axis=1)[:, :k]
            best_id, best = np.take_along_axis(best_id, order, axis=1), np.take_along_axis(best, order, axis=1)
        if best.size:
            real = np.isfinite(best).ravel()
            row = np.repeat(np.arange(len(query_ids)), best.shape[1])[real]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(row.astype(np.int64)), pa.array(best_id.ravel()[real]), pa.array(best.ravel()[real])], names=["query_id", "query_row", "vec_id", "score"])

    return coded.select("vec_id", "embedding", "code", "norm").mapInArrow(find, "query_id long, query_row long, vec_id long, score double")
