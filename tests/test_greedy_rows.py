from evigraph.operators import match


def test_greedy_takes_equal_rows_once_and_leaves_rows_without_an_end(spark):
    rows = [(0, 1, 1, 0.5), (0, 1, 1, 0.5), (0, 1, 2, 0.9), (0, 2, 1, 0.4), (0, None, 3, 0.9), (1, 1, 1, 0.1)]
    got = match.greedy_one_to_one(spark.createDataFrame(rows, "pair int, u int, v int, score double"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 2, 0.9), (0, 2, 1, 0.4), (1, 1, 1, 0.1)]
