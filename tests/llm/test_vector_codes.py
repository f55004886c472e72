import hashlib
import math

import numpy as np
import pytest

from evigraph.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute(rows, entries=256, rounds=4, parts=4):
    """Plain Lloyd in Python integers: {row number: (code, error)} and entries."""
    kept = [(n, i, [math.floor(1024 * float(np.float32(x))) for x in v]) for n, (i, v, _) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v))]
    width = len(kept[0][2]) // parts
    start = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    x = np.array([r[2] for r in kept], object)
    cut = lambda m, p: m[:, p * width : (p + 1) * width]
    books = [cut(np.array([r[2] for r in start], object), p) for p in range(parts)]
    codes, errors = [], 0
    for turn in range(rounds + 1):
        codes, errors = [], 0
        for p in range(parts):
            far = ((cut(x, p)[:, None, :] - books[p][None]) ** 2).sum(axis=2)
            near = far.argmin(axis=1)
            codes.append(near)
            errors = errors + far[np.arange(len(x)), near]
            if turn < rounds:
                for e in set(near.tolist()):
                    own = cut(x, p)[near == e]
                    books[p][e] = [int(s) // len(own) for s in own.sum(axis=0)]
    found = {r[0]: ("".join(f"{c[k]:02x}" for c in codes), int(errors[k])) for k, r in enumerate(kept)}
    return found, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_query_equals_plain_lloyd(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    wanted, digest = brute(rows)
    of_label = {}
    for n, (_, error) in wanted.items():
        of_label[rows[n][2]] = of_label.get(rows[n][2], 0) + error
    got = sorted(tuple(r) for r in queries.op11_codes(spark, sf_dir).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == sorted((rows[n][0], c, e, of_label[rows[n][2]], digest) for n, (c, e) in wanted.items())


@pytest.mark.parametrize("scale", [0.01, 1.0, 60_000.0])
def test_odd_rows_and_ties(spark, scale):
    """Coarse vectors make ties; large ones go by 64-bit integers."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in np.float32(scale * rng.integers(-3, 4, size=8) / 1.5)], [None, 0, 1][i % 3]) for i in rng.permutation(900)]
    odd = [(5, rows[5][1], 1), (7000, None, 1), (7001, [None] * 8, 1), (7002, [float("nan")] * 8, None), (7003, [1.0] * 7 + [float("-inf")], 1), (7004, [], 1), (None, rows[3][1], None)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows + odd], SCHEMA).repartition(5)
    made = vector_codes.compress(frame)
    wanted, digest = brute(rows + odd)
    got = vector_codes.with_label_error(made.rows).collect()
    assert hashlib.sha256(",".join(map(str, made.books.ravel().tolist())).encode()).hexdigest() == digest
    assert sorted((str(r.vec_id), bytes(r.code).hex(), r.error) for r in got) == sorted((str((rows + odd)[n][0]), c, e) for n, (c, e) in wanted.items())
    for label in (None, 0, 1):
        own = [r for r in got if r.label == label]
        assert own and {r.label_error for r in own} == {sum(r.error for r in own)}


def test_few_rows_and_none(spark):
    rows = [(i, [0.1 * i, 1.0, -0.5, 0.25 * i], None) for i in range(5)]
    frame = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    made = vector_codes.compress(frame)
    assert made.books.shape == (4, 5, 1)
    wanted, _ = brute(rows)
    assert sorted((r.vec_id, bytes(r.code).hex(), r.error) for r in made.rows.collect()) == sorted((rows[n][0], *w) for n, w in wanted.items())
    assert vector_codes.compress(frame.limit(0)) is None
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(frame, parts=3)
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1, "", "")], SCHEMA))


def test_bounds_spare_distances():
    """After the first round most groups of clustered rows are left unscanned,
    and what is found is what a full scan finds."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 16))).astype(float)
    books, own, bounds, work = vector_codes.grouped(x[None, :256].copy(), 16), None, None, []
    for _ in range(5):
        own, bounds, error, done = vector_codes.assign(x, own, bounds, books.entries[0], books.group[0], books.drift[0])
        far = vector_codes._squared(x, books.entries[0])
        assert (own == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        work.append(done)
        fresh = books.entries.copy()
        for e in np.unique(own):
            fresh[0, e] = np.floor(x[own == e].mean(axis=0))
        books = books.moved(fresh)
    assert work[0] >= 4000 * 256
    assert max(work[1:]) < 0.5 * work[0]
