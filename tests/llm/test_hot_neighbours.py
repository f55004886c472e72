import numpy as np

from evigraph.llm import neighbours


def test_copies_at_the_production_rerank(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    copies = np.sort(rng.permutation(6000)[:2000])
    x[copies] = x[copies[0]]
    df = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in rng.permutation(6000).tolist()], "vec_id long, embedding array<float>").repartition(1)
    got = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hot = [q for q in got if q in set(copies.tolist())]
    assert len(hot) > 5
    assert all(got[q] == [c for c in copies.tolist() if c != q][:10] for q in hot)
