from evigraph import queries


def recall(spark, sf_dir):
    """Share of the true five nearest by Euclidean distance that knn_cells finds."""
    import numpy as np

    got = queries.QUERIES["knn_cells"](spark, sf_dir).select("query_id", "vec_id").collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    found = {(r.query_id, r.vec_id) for r in got}
    hits = wanted = 0
    for q in np.flatnonzero(ids % 100 == 0):
        near = ids[np.lexsort((ids, ((x - x[q]) ** 2).sum(axis=1)))[:5]]
        wanted += len(near)
        hits += sum((ids[q], i) in found for i in near)
    return hits / wanted


def test_cells_find_nine_in_ten(spark):
    assert recall(spark, "/root/testdata/sf0.1") >= 0.9
