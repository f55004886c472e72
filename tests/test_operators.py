import random
from collections import deque

import pytest

from evigraph.operators import build, fusion, graph, match, metrics, retrieval, simulation


def hypergraph(rng):
    return {e: rng.sample(range(8), rng.randint(1, 3)) for e in range(rng.randint(1, 9))}


def bfs(edges, src):
    far, todo = {src: 0}, deque([src])
    while todo:
        v = todo.popleft()
        for members in edges.values():
            if v in members:
                for w in members:
                    if w not in far:
                        far[w] = far[v] + 1
                        todo.append(w)
    return {v: n for v, n in far.items() if v != src}


def test_hyperpaths_equal_bfs(spark):
    rng = random.Random(1)
    graphs = {g: hypergraph(rng) for g in range(6)}
    rows = [(g, e, v, e % 2) for g, edges in graphs.items() for e, vs in edges.items() for v in vs]
    inc = spark.createDataFrame(rows, "graph int, edge long, vertex long, source int")
    starts = spark.createDataFrame([(g, v) for g in graphs for v in range(8)], "graph int, src long")
    found = {(r.graph, r.src, r.dst): r for r in graph.shortest_hyperpaths(inc, starts).collect()}
    wanted = {(g, v, w): n for g, edges in graphs.items() for v in range(8) for w, n in bfs(edges, v).items()}
    assert {k: r.length for k, r in found.items()} == wanted
    for (g, src, dst), r in found.items():
        reach = {src}
        for e in r.path:
            assert reach & set(graphs[g][e])
            reach = set(graphs[g][e])
        assert dst in reach
    near = graph.neighbours_within(inc, starts, 1).collect()
    assert {(r.graph, r.src, r.dst) for r in near} == {k for k, n in wanted.items() if n == 1}
    local = {(r.graph, r.src, r.dst): r.length for r in graph.shortest_hyperpaths(inc, starts, local=True).collect()}
    by_source = {}
    for g, edges in graphs.items():
        for s in (0, 1):
            for v in range(8):
                for w, n in bfs({e: m for e, m in edges.items() if e % 2 == s}, v).items():
                    by_source[g, v, w] = min(n, by_source.get((g, v, w), n))
    assert local == by_source


def test_closure_components_and_trees(spark):
    arcs = [(1, 2), (2, 3), (3, 1), (4, 5), (6, 6)]
    closed = graph.transitive_closure(spark.createDataFrame(arcs, "src int, dst int")).collect()
    assert {tuple(r) for r in closed} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b} | {(4, 5)}
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    assert {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (9, None)], "node int, parent int")
    pairs = spark.createDataFrame([(4, 3), (4, 2), (4, 9), (1, 1)], "a int, b int")
    assert {(r.a, r.b): r.lca for r in graph.lowest_common_ancestors(tree, pairs).collect()} == {(4, 3): 1, (4, 2): 2, (4, 9): None, (1, 1): 1}
    assert {r.node: r.root for r in graph.ultimate_roots(tree).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def brute_bounded(allowed, query, data, bound):
    reach = set(data)
    for _ in range(bound - 1):
        reach |= {(a, d) for a, b in reach for c, d in data if b == c}
    now = set(allowed)
    while True:
        keep = {(u, v) for u, v in now if all(any((v, w) in reach and (x, w) in now for w in range(10)) for a, x in query if a == u)}
        if keep == now:
            return now
        now = keep


def test_bounded_simulation_equals_brute_force(spark):
    rng = random.Random(5)
    for bound in (1, 2):
        query = {(rng.randrange(3), rng.randrange(3)) for _ in range(3)}
        data = {(rng.randrange(10), rng.randrange(10)) for _ in range(14)}
        allowed = {(rng.randrange(3), rng.randrange(10)) for _ in range(18)}
        df = lambda rows, names: spark.createDataFrame([(0, *r) for r in rows], f"instance int, {names}")
        got = simulation.bounded_simulation(df(allowed, "u int, v int"), df(query, "src int, dst int"), df(data, "src int, dst int"), bound)
        pairs = {(r.u, r.v) for r in got.collect()}
        assert pairs == brute_bounded(allowed, query, data, bound) and pairs <= allowed


def test_edge_simulation_rule(spark):
    edges = spark.createDataFrame([(0, 1, "a"), (0, 1, "b"), (0, 2, "b"), (0, 2, "c")], "instance int, edge int, u string")
    matches = spark.createDataFrame([(0, 1, 10, "a", 1), (0, 1, 10, "b", 2), (0, 2, 20, "b", 2), (0, 2, 20, "c", 3)], "instance int, edge int, sc int, u string, v int")
    pairs = lambda rows: spark.createDataFrame([(0, *r) for r in rows], "instance int, u string, v int")
    run = lambda rows, **k: {(r.u, r.v) for r in simulation.edge_simulation(pairs(rows), edges, matches, **k).collect()}
    full = [("a", 1), ("b", 2), ("c", 3)]
    assert run(full) == run(full, strict=True) == set(full)
    assert run([("a", 1), ("b", 2)]) == {("a", 1), ("b", 2)}
    assert run([("a", 1), ("b", 2)], strict=True) == set()
    assert run([("a", 1)]) == set()


def test_matching(spark):
    pairs = spark.createDataFrame([(0, "q", v, s) for v, s in ((1, 0.5), (2, 0.9), (3, 0.5))], "instance int, u string, v int, score double")
    assert [(r.v, r["rank"]) for r in match.top_b(pairs, 2).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    slices = spark.createDataFrame([(0, "x", "a"), (0, "y", "a"), (0, "z", "b"), (0, "z", "a")], "instance int, slice string, u string")
    need = spark.createDataFrame([(0, "a")], "instance int, u string")
    assert {r.slice for r in match.rank_slices(slices, need, 1).collect()} == {"x", "y", "z"}
    assert match.rank_slices(slices, need, 0).collect() == []
    assert {r.hits for r in match.rank_slices(slices, None, 1).collect()} == {1}
    both = spark.createDataFrame([(0, "a"), (0, "b")], "instance int, u string")
    assert {r.slice: r.consistent for r in match.slice_consistency(slices, both).collect()} == {"x": False, "y": False, "z": True}
    scores = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.9), (1, 2, 1, 0.8), (1, 2, 2, 0.7)], "pair int, u int, v int, score double")
    assert {(r.u, r.v) for r in match.greedy_one_to_one(scores).collect()} == {(1, 1), (2, 2)}
    rows = spark.createDataFrame([(1, 1, 1, p, s) for p, s in ((0, 0.5), (0, 0.9), (1, 0.7))], "pair int, u int, v int, place int, score double")
    assert match.dmatch_scores(rows, 0.7).first().score == pytest.approx(0.8)
    assert match.dmatch_scores(rows, 0.8).collect() == []


def test_fusion(spark):
    vertices = spark.createDataFrame([(1, 0, "Rome", "GPE"), (2, 1, "Rome ", "COUNTRY"), (3, 1, "Ann", "PERSON")], "vertex_id long, source int, text string, type string").selectExpr("*", "array('GPE') AS ents", "array('PROPN') AS poses")
    links = fusion.merge_edges(vertices)
    inc = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (7, 2, 3)], "edge long, pos int, vertex long")
    mapped, merged, edges = fusion.merge_graphs(vertices, inc, links)
    assert {r.vertex_id: r.merged for r in mapped.collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.merged: (r.provenance, r.type) for r in merged.collect()} == {1: ([0, 1], "COUNTRY"), 3: ([1], "PERSON")}
    assert {(r.vertex, r.pos) for r in edges.collect()} == {(1, 0), (3, 2)}


def test_metrics_and_retrieval(spark):
    gold = spark.createDataFrame([(True, True), (True, False), (False, True), (False, None)], "p boolean, g boolean")
    r = metrics.confusion(gold, "p", "g").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.f1, r.negative_f1) == (1, 1, 1, 0, 0.5, 0.5, 0.0)
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b")], "n int, k string")
    assert sorted(x.n for x in metrics.keep_first(rows, "k", "n").collect()) == [1, 3, 4, 5]
    ctx = spark.createDataFrame([("q", c, i) for i, c in enumerate("abc", 1)] + [("r", "b", 1)], "question string, ctx string, rank int")
    rel = spark.createDataFrame([("q", "a", "b"), ("q", "c", "a")], "question string, i string, j string")
    assert {(x.question, x.ctx) for x in retrieval.trim_contexts(ctx, rel).collect()} == {("q", "a"), ("q", "c"), ("r", "b")}
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "query_id int, rank int, doc string")
    judged = spark.createDataFrame([(1, "y", 1)], "query_id int, doc string, gain int")
    d = retrieval.dcg_metrics(ranked, judged, 2).first()
    assert (d.recall, d.average_precision) == (1.0, 0.5) and d.ndcg == pytest.approx(0.6309, abs=1e-3)


def test_build(spark):
    body = "One here. Two there! Three now? Four then."
    docs = spark.createDataFrame([(1, body, "clash"), (2, "no end", None), (3, "", "")], "doc int, text string, ends string")
    for n in (2, 3):
        got = {r.doc: r.chunks for r in build.split_chunks(docs, "text", n).collect()}
        assert "".join(got[1]) == body and len(got[1]) == n
        assert got[2] == ["no end"] and got[3] == [""]
    lines = spark.createDataFrame([('("entity", "A, b", "t", "d");("relationship", "A, b", "C", "r", "x");("attribute", "k", "v", "d", "C");<END_OUTPUT>("entity", "z", "t", "d");',)], "text string")
    nodes, edges = build.parse_records(lines)
    assert {r.name for r in nodes.collect()} == {"A, b", "k=v"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("A, b", "C"), ("C", "k=v")}
    vertices, incidence = build.rule_graph(spark.createDataFrame([(1, "Who wrote Hamlet? William wrote 3 plays.")], "graph int, text string"))
    assert {r.text: r.query_type for r in vertices.collect()} == {"who": "PERSON", "wrote": None, "hamlet": None, "william": None, "3": None, "plays": None}
    assert incidence.count() == 7
