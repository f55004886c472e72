from evigraph.operators import graph, token_paths


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_path_rounds_are_read_as_one_table(spark):
    rows = [(0, e, v) for e in range(6) for v in (e, e + 1)]
    found = graph.shortest_hyperpaths(spark.createDataFrame(rows, "graph long, edge long, vertex long"), spark.createDataFrame([(0, 0), (0, 3)], "graph long, src long"))
    assert "Union" not in _plan(found)
    assert {(r["src"], r["dst"], tuple(r["path"])) for r in found.collect()} == {(s, d, tuple(range(s, d)) if d > s else tuple(range(s - 1, d - 1, -1))) for s in (0, 3) for d in range(7) if s != d}


def test_root_paths_are_read_as_one_table_and_end_in_a_ring(spark):
    heads = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 2), (0, 5, None)], "graph long, idx long, head long")
    found = token_paths.root_paths(heads, heads.select("graph", "idx"))
    assert "Union" not in _plan(found)
    assert sorted((r["anc"], r["depth"]) for r in found.where("idx = 1").collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
