from evigraph.operators import dependency


def test_current_nodes_are_hashed(spark):
    edges = spark.createDataFrame([(0, 1, 2, 5, "a"), (0, 2, 2, 5, "b")], "graph long, edge long, start long, end long, source string")
    members = spark.createDataFrame([(0, 1, 7), (0, 2, 7), (0, 2, 8)], "graph long, edge long, vertex_id long")
    nodes = spark.createDataFrame([(0, 7, 1, "a"), (0, 7, 3, "c"), (0, 7, 9, "b"), (0, 8, 6, "c"), (0, 8, 4, "c")], "graph long, vertex_id long, idx long, source string")
    got = dependency.current_nodes(edges, members, nodes)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 7, 1), (0, 2, 7, 9), (0, 2, 8, 4)]
