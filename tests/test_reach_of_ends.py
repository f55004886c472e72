from evigraph.operators import simulation


def test_only_paths_from_and_to_ends_of_query_arcs_are_walked(spark, monkeypatch):
    walked = []
    reach = simulation.bounded_reach
    monkeypatch.setattr(simulation, "bounded_reach", lambda arcs, bound, starts=None: walked.append((sorted(map(tuple, arcs.collect())), sorted(map(tuple, starts.collect())))) or reach(arcs, bound, starts))
    allowed = spark.createDataFrame([(1, "q", "a"), (1, "r", "c"), (1, "s", "b"), (2, "q", "a"), (2, "s", "a"), (3, "q", "a"), (3, "r", "b"), (3, "s", "b")], "instance int, u string, v string")
    query = spark.createDataFrame([(i, "q", "r") for i in (1, 2, 3)], "instance int, src string, dst string")
    arcs = [(i, x, y) for i in (1, 2, 3) for x, y in (("a", "b"), ("b", "c"), ("c", "d"))]
    found = simulation.bounded_simulation(allowed, query, spark.createDataFrame(arcs, "instance int, src string, dst string"), 2)
    # instance 2 has no match of r, and s has no arc
    assert sorted(map(tuple, found.collect())) == [(1, "q", "a"), (1, "r", "c"), (1, "s", "b"), (2, "s", "a"), (3, "q", "a"), (3, "r", "b"), (3, "s", "b")]
    assert walked == [([a for a in arcs if a[0] != 2], [(1, "a"), (2, "a"), (3, "a")])]


def test_words_of_a_sentence_are_shuffled_once(spark):
    from evigraph.operators import build

    rows = [(1, "Word other WORD 12 who is it. Other word"), (1, "Next word other"), (2, None), (3, "a b."), (4, "Seen seen")]
    vertices, edges = build.rule_graph(spark.createDataFrame(rows, "graph long, text string"))
    names = {(r.graph, r.vertex_id): r.text for r in vertices.collect()}
    got = [(r.graph, r.edge, r.pos, names[r.graph, r.vertex_id]) for r in edges.orderBy("graph", "edge", "pos").collect()]
    assert got == [(1, 0, 0, "next"), (1, 0, 1, "word"), (1, 0, 2, "other"), (1, 0, 3, "12"), (1, 0, 4, "who"), (1, 1, 0, "other"), (1, 1, 1, "word"), (4, 0, 0, "seen")]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1
