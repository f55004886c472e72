import random
from collections import deque

import pytest

from evigraph.operators import dependency, graph, token_paths


def chain(head, start):
    out = []
    while start is not None and start not in out:
        out.append(start)
        start = head.get(start)
    return out


def plain_path(head, nodes, roots, v, w):
    """The path of one pair in one graph, by search: {(step, idx)}."""
    def top(r):
        way = chain(head, r)
        last = head.get(way[-1])
        return min(way[way.index(last) :]) if last in way else way[-1]

    group = {e: top(r) for e, r in roots.items()}
    tokens, owner = {}, {}
    for e, x, i in sorted(nodes):
        tokens.setdefault(group[e], set()).add(i)
        owner.setdefault((x, group[e]), i)
    mine = lambda x: {g for y, g in owner if y == x}
    best = None
    queue = deque((g,) for g in sorted(mine(v)))
    seen = {}
    while queue:
        level = sorted(queue)
        queue = deque()
        for route in level:
            if route[-1] not in seen:
                seen[route[-1]] = route
                queue += [(*route, g) for g in tokens if g != route[-1] and tokens[g] & tokens[route[-1]]]
    found = [(len(seen[g]), seen[g]) for g in mine(w) if g in seen]
    if not found:
        return set()
    route = min(found)[1]
    points = [owner[v, route[0]], *(min(tokens[a] & tokens[b]) for a, b in zip(route, route[1:])), owner[w, route[-1]]]
    out = set()
    for step, (g, a, b) in enumerate(zip(route, points, points[1:])):
        if a == b:
            out.add((step, a))
            continue
        held = lambda t, g=g: [roots[e] for e, _, i in nodes if i == t and group[e] == g]
        options = [(chain(head, ra).index(c) + chain(head, rb).index(c), c) for ra in held(a) for rb in held(b) for c in chain(head, ra) if c in chain(head, rb)]
        if not options:
            return set()
        root = min(options)[1]
        for t in (a, b):
            way = chain(head, t)
            if root not in way:
                via = min((chain(head, r).index(root), r) for r in held(t) if root in chain(head, r))[1]
                way = [t, *chain(head, via)]
            out |= {(step, x) for x in way[: way.index(root) + 1]}
    return out


def test_token_paths_equal_a_plain_search(spark):
    """Random forests with bridges between trees, a cycle in some, heads outside
    the table in others."""
    rng = random.Random(12)
    heads, nodes, roots, pairs, wanted = [], [], [], [], set()
    for g in range(40):
        n = 24
        head = {i: (rng.randrange(max(0, i - 6), i) if i % 6 else None) for i in range(n)}
        if g % 5 == 0:
            head[6] = 8
            head[8] = 7
            head[7] = 6
        if g % 7 == 0:
            head[12] = 99
        own_roots, own_nodes = {}, []
        for e in range(9):
            r = rng.randrange(n)
            own_roots[e] = r
            children = [i for i in range(n) if head[i] == r]
            extra = [rng.randrange(n)] if rng.random() < 0.5 else []
            own_nodes += [(e, i % 10, i) for i in {r, *children, *extra}]
        asked = {(rng.randrange(11), rng.randrange(11)) for _ in range(12)}
        heads += [(g, i, h) for i, h in head.items()]
        nodes += [(g, *x) for x in own_nodes]
        roots += [(g, e, r) for e, r in own_roots.items()]
        pairs += [(g, v, w) for v, w in asked]
        known = {i: h for i, h in head.items() if h != 99}
        for v, w in asked:
            wanted |= {(g, v, w, *x) for x in plain_path({**known, 12: 99} if g % 7 == 0 else known, own_nodes, own_roots, v, w)}
    got = token_paths.token_paths(
        spark.createDataFrame(heads, "graph int, idx int, head int"), spark.createDataFrame(nodes, "graph int, edge int, vertex int, idx int"),
        spark.createDataFrame(roots, "graph int, edge int, idx int"), spark.createDataFrame(pairs, "graph int, v int, w int"),
    )
    rows = [tuple(r) for r in got.select("graph", "v", "w", "step", "idx").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == wanted
    assert len({r[:3] for r in wanted}) > 100 and max(r[3] for r in wanted) >= 1


def test_chain_of_three_groups(spark):
    """0<-1<-2, 10<-11<-12, 20<-21: edge 1 also holds 11, edge 2 holds 21."""
    heads = [(0, i, h) for i, h in ((0, None), (1, 0), (2, 1), (10, None), (11, 10), (12, 11), (20, None), (21, 20))]
    nodes = [(0, 1, 100, 2), (0, 1, 101, 11), (0, 2, 101, 11), (0, 2, 102, 12), (0, 2, 103, 21), (0, 3, 104, 20), (0, 3, 103, 21)]
    roots = [(0, 1, 1), (0, 2, 10), (0, 3, 20)]
    got = token_paths.token_paths(
        spark.createDataFrame(heads, "graph int, idx int, head int"), spark.createDataFrame(nodes, "graph int, edge int, vertex int, idx int"),
        spark.createDataFrame(roots, "graph int, edge int, idx int"), spark.createDataFrame([(0, 100, 104), (0, 100, 999), (0, 104, 100)], "graph int, v int, w int"),
    )
    rows = sorted(tuple(r) for r in got.select("v", "w", "step", "idx").collect())
    # 2-1, and 11 by the edge's root 1; 11-10, and 21 by the edge's root 10; 21-20
    there = [(0, 1), (0, 2), (0, 11), (1, 10), (1, 11), (1, 21), (2, 20), (2, 21)]
    assert rows == [(100, 104, *x) for x in there] + sorted((104, 100, 2 - s, i) for s, i in there)


def test_no_tokens_no_paths(spark):
    empty = lambda s: spark.createDataFrame([], s)
    got = token_paths.token_paths(empty("graph int, idx int, head int"), empty("graph int, edge int, vertex int, idx int"), empty("graph int, edge int, idx int"), spark.createDataFrame([(0, 1, 2)], "graph int, v int, w int"))
    assert got.collect() == []


@pytest.mark.parametrize("n", [3, 4])
def test_head_chains_end_on_cycles(spark, n):
    """Heads in a ring, a tail that runs into it, and a head outside the table."""
    rows = [(i, (i + 1) % n) for i in range(n)] + [(10, 0), (11, 10), (20, None), (21, 20), (30, 99), (31, 31)]
    got = {r.node: r.root for r in graph.ultimate_roots(spark.createDataFrame(rows, "node int, parent int")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 10: 0, 11: 0, 20: 20, 21: 20, 30: 99, 31: 31}
    lost = {r.node for r in graph.unreached_nodes(spark.createDataFrame(rows, "node int, parent int")).collect()}
    assert lost == {*range(n), 10, 11, 30}


def test_compressed_dependencies_end_on_rings_and_chains(spark):
    """A chain of forty words under one vertex, a ring without a vertex with a
    vertex under it, a head outside the table."""
    rows = [(0, 0, None, True)] + [(0, i, i - 1, i == 40) for i in range(1, 41)]
    rows += [(1, 0, 1, False), (1, 1, 2, False), (1, 2, 0, False), (1, 3, 0, True), (1, 4, 3, True), (2, 0, 9, True), (2, 1, 0, True)]
    tokens = spark.createDataFrame(rows, "graph int, idx int, head int, is_vertex boolean")
    got = {tuple(r) for r in dependency.compress_dependencies(tokens).select("graph", "idx", "pred", "skipped").collect()}
    assert got == {(0, 40, 0, 39), (1, 4, 3, 0), (2, 0, 9, 0), (2, 1, 0, 0)}
