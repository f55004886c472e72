import numpy as np

from evigraph.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=10):
    out = []
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for i, v in good:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in good if j != i)[:k]
            out += [(i, r, j, s) for r, (s, j) in enumerate(near, 1)]
    return out


def test_search_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(1100, [0.0] * 16), (1200, None), (1300, [None] + [1.0] * 15), (1400, [float("nan")] * 16), (1500, [float("inf")] * 16), (1600, [1.0]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted(map(tuple, neighbours.search(df, rerank=1.0).collect()))
    wanted = sorted(brute(rows))
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert np.allclose([g[3] for g in got], [w[3] for w in wanted], rtol=0, atol=1e-12)
    assert neighbours.search(df.limit(0)).collect() == []
    assert neighbours.search(df.where("vec_id = 1200")).collect() == []
    few = neighbours.search(df.where("vec_id < 4 or vec_id = 100")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(q, r) for q in (0, 100) for r in range(1, 5)]


def test_query_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i * 50, [float(x) for x in rng.normal(size=16)], "") for i in range(80)], SCHEMA)
    one = sorted(map(tuple, neighbours.search(df).collect()))
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, neighbours.search(df).collect())) == one


def test_recall_on_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    x = np.array(df.toPandas().sort_values("vec_id").embedding.tolist(), np.float64)
    books = neighbours.fit(x)
    codes, norms = neighbours.encode(x, books)
    stands = sum(books[m][codes[:, m]] for m in range(len(books)))
    assert np.allclose((stands**2).sum(axis=1), norms) and ((x - stands) ** 2).sum() < 0.5 * (x**2).sum()
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 20 and hits >= 0.95 * 10 * len(got)
