"""Hypergraph reachability as rounds of joins over incidence tables.

``incidence`` is (graph, edge, vertex), with ``source`` where paths must keep
to one source. Rounds stop when nothing is new; plans are cut by checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Rounds, cut


def star_edges(edge_vertices: DataFrame) -> DataFrame:
    """(graph, src, dst): from each edge's root (pos 0) to its other vertices."""
    root = edge_vertices.where("pos = 0").select("graph", "edge", F.col("vertex").alias("src"))
    rest = edge_vertices.where("pos > 0").select("graph", "edge", F.col("vertex").alias("dst"))
    return root.join(rest, ["graph", "edge"]).where("src <> dst").select("graph", "src", "dst").distinct()


def shortest_hyperpaths(incidence: DataFrame, starts: DataFrame, max_hops: int = -1, local: bool = False) -> DataFrame:
    """(graph, src, dst, length, path) for every vertex in reach of the starts
    (graph, src): path is the array of edge ids, of equal ones the smallest.
    ``local`` keeps a path to edges of one source. Without ``max_hops`` the
    search ends when a round reaches nothing new. A step leads at most one round
    back, so what is new is told by the last two."""
    keys = ["graph", "src", "dst"] + (["source"] if local else [])
    inc = incidence.select("graph", "edge", "vertex", *(["source"] if local else [])).distinct()
    frontier = starts.select("graph", "src", F.col("src").alias("dst"), F.array().cast("array<bigint>").alias("path")).distinct()
    if local:
        frontier = frontier.join(inc.select("graph", F.col("vertex").alias("dst"), "source").distinct(), ["graph", "dst"])
    inc, rounds = cut(inc), Rounds(incidence.sparkSession)
    frontier, before, hops = rounds.add(frontier.select(*keys, "path")), None, 0
    while max_hops < 0 or hops < max_hops:
        hops += 1
        on = ["graph", "vertex"] + (["source"] if local else [])
        edges = frontier.withColumnRenamed("dst", "vertex").join(inc, on).select(*[k for k in keys if k != "dst"], "edge", "path")
        edges = edges.where(~F.array_contains("path", F.col("edge"))).groupBy(*[k for k in keys if k != "dst"], "edge").agg(F.min("path").alias("path"))
        on = ["graph", "edge"] + (["source"] if local else [])
        reached = edges.join(inc, on).select(*[k if k != "dst" else F.col("vertex").alias("dst") for k in keys], F.concat("path", F.array(F.col("edge").cast("bigint"))).alias("path"))
        known = frontier.select(keys) if before is None else frontier.select(keys).unionByName(before.select(keys))
        fresh = reached.groupBy(*keys).agg(F.min("path").alias("path")).join(known, keys, "left_anti")
        before, frontier = frontier, rounds.add(fresh)
        if frontier.isEmpty():
            break
    found = rounds.all().where("src <> dst").withColumn("length", F.size("path"))
    best = F.min(F.struct("length", "path")).alias("b")
    return found.groupBy("graph", "src", "dst").agg(best).select("graph", "src", "dst", "b.length", "b.path")


def neighbours_within(incidence: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(graph, src, dst, hop): vertices at most ``hops`` edges away, level by
    level; -1 for all in reach."""
    near = shortest_hyperpaths(incidence, starts, hops)
    return near.select("graph", "src", "dst", F.col("length").alias("hop"))


def paths_up_to(incidence: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """All simple paths (graph, src, dst, path) of at most ``max_hops`` edges."""
    inc = incidence.select("graph", "edge", "vertex").distinct()
    frontier = starts.select("graph", "src", F.col("src").alias("vertex"), F.array().cast("array<bigint>").alias("path"), F.array("src").alias("met"))
    out = None
    for _ in range(max_hops):
        step = frontier.join(inc, ["graph", "vertex"]).where(~F.array_contains("path", F.col("edge"))).select("graph", "src", "edge", "path", "met")
        step = step.join(inc, ["graph", "edge"]).where(~F.array_contains("met", F.col("vertex")))
        frontier = cut(step.select("graph", "src", "vertex", F.concat("path", F.array(F.col("edge").cast("bigint"))).alias("path"), F.concat("met", F.array("vertex")).alias("met")))
        rows = frontier.select("graph", "src", F.col("vertex").alias("dst"), "path")
        out = rows if out is None else out.unionByName(rows)
    return out


def transitive_closure(arcs: DataFrame) -> DataFrame:
    """(src, dst) in reach by one or more arcs, self loops left out."""
    arcs = arcs.select("src", "dst").where("src <> dst").distinct()
    seen = frontier = cut(arcs)
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("dst", "mid").join(arcs.withColumnRenamed("src", "mid"), "mid").select("src", "dst").where("src <> dst").distinct()
        frontier = cut(step.join(seen, ["src", "dst"], "left_anti"))
        # each round's rows are written once, and read from where they are
        seen = seen.unionByName(frontier)
    return seen


def ancestors(parents: DataFrame) -> DataFrame:
    """(node, anc, depth) of every node, itself at depth 0, from (node, parent)."""
    nodes = parents.select("node").union(parents.where("parent is not null").select("parent")).distinct()
    arcs = parents.where("parent is not null").select(F.col("node").alias("anc"), F.col("parent").alias("up"))
    out = frontier = cut(nodes.select("node", F.col("node").alias("anc"), F.lit(0).alias("depth")))
    while not frontier.isEmpty():
        frontier = cut(frontier.join(arcs, "anc").select("node", F.col("up").alias("anc"), (F.col("depth") + 1).alias("depth")).join(out, ["node", "anc"], "left_anti"))
        out = out.unionByName(frontier)
    return out


def lowest_common_ancestors(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lca) with the least summed depth, the smaller id of equals; null
    in different trees."""
    up = ancestors(parents)
    side = lambda n: up.select(F.col("node").alias(n), "anc", F.col("depth").alias(f"d{n}"))
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "anc"])
    best = met.groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("far"), "anc")).alias("m"))
    return pairs.select("a", "b").distinct().join(best, ["a", "b"], "left").select("a", "b", F.col("m.anc").alias("lca"))


def common_prefix(a, b):
    """(concept, depth) at the end of two root paths' common start; ("", -1)
    if the roots differ."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    end = F.array_position(same, F.lit(False)).cast("int")
    n = F.when(end == 0, F.size(same)).otherwise(end - 1)
    return F.when(n > 0, F.struct(F.get(a, n - 1).alias("concept"), (n - 1).alias("depth"))).otherwise(F.struct(F.lit("").alias("concept"), F.lit(-1).alias("depth")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component), the smallest id reached over (a, b): each vertex takes
    its neighbours' least label, and labels jump to their own label. Joins are
    shuffled: a broadcast passes the driver whole."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a")).where("id is not null and to is not null").distinct()
    both = cut(both)
    labels = cut(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("to"), "label").hint("merge"), "to").groupBy("id").agg(F.min("label").alias("near"))
        low = cut(labels.join(near.hint("merge"), "id").select("id", "label", F.least("label", "near").alias("low")))
        if low.where("low <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
        labels = cut(low.join(low.select(F.col("id").alias("low"), F.col("low").alias("jump")).hint("merge"), "low", "left").select("id", F.least("low", F.coalesce("jump", "low")).alias("label")))
    raise RuntimeError(f"components not settled after {rounds} rounds")


def ultimate_roots(heads: DataFrame) -> DataFrame:
    """(node, root) at the top of each head chain, by pointer jumping: pointers
    double their reach, so as many rounds as the longest chain has binary digits
    end it. A head that has no row of its own is a top. A chain that runs into a
    ring has the ring's smallest node as its root."""
    own = F.coalesce("parent", "node")
    up = cut(heads.select("node", own.alias("root"), own.alias("least"), (own == F.col("node")).alias("done")))
    for _ in range(max(1, up.count()).bit_length() + 1):
        if up.where("not done").isEmpty():
            return up.select("node", "root")
        over = up.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        met, moves = up.join(over, "root", "left"), ~F.col("done") & F.col("next").isNotNull()
        done = F.col("done") | F.coalesce("_done", F.lit(True))
        up = cut(met.select("node", F.when(moves, F.col("next")).otherwise(F.col("root")).alias("root"), F.when(moves, F.least("least", "_least")).otherwise(F.col("least")).alias("least"), done.alias("done")))
    # what still moves circles a ring and has gone round it, so the least that
    # is seen from where it stands is the ring's
    rings = up.select(F.col("node").alias("root"), F.col("least").alias("ring"))
    return up.join(rings, "root", "left").select("node", F.when(F.col("done"), F.col("root")).otherwise(F.col("ring")).alias("root"))


def unreached_nodes(heads: DataFrame) -> DataFrame:
    """Nodes whose head chain never ends at a root (no parent): a check."""
    own = heads.select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"))
    roots = own.where("parent is null").select(F.col("node").alias("anc"))
    return own.select("node").distinct().join(ancestors(own).join(roots, "anc").select("node").distinct(), "node", "left_anti")
