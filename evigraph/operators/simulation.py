"""Greatest-fixpoint simulation between query and data graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Rounds, cut, saved


def _until_stable(pairs: DataFrame, keep) -> DataFrame:
    """``keep(pairs)`` again and again, until it keeps all. Removal only
    shrinks the relation, hence this ends, at the greatest fixpoint."""
    now = saved(pairs)
    left = now.count()
    while True:
        now = saved(keep(now))
        n = now.count()
        if n == left:
            return now
        left = n


def edge_simulation(allowed: DataFrame, query_edges: DataFrame, d_match: DataFrame, strict: bool = False) -> DataFrame:
    """The pairs (instance, u, v) of ``allowed`` that stay supported.

    ``query_edges`` is (instance, edge, u), ``d_match`` (instance, edge, sc, u,
    v): the matches of each cluster pair sc that covers a query edge. The rule
    is an assumption, reconstructed from the graph-simulation literature: a
    pair is supported at an edge by a cluster pair whose matches hold it, if
    every other query vertex of the edge that these matches mention still has
    one of its matches in the relation. It stays if some edge of u supports it,
    or, if ``strict``, every edge does. Without ``strict`` one round is the
    fixpoint: cluster pairs that are whole keep all pairs that make them so, and
    others do not become whole as pairs go.
    """
    pairs = allowed.select("instance", "u", "v").distinct()
    on_edge = query_edges.select("instance", "edge", "u").distinct()
    matches = d_match.select("instance", "edge", "sc", "u", "v").distinct().join(on_edge, ["instance", "edge", "u"])
    if not strict:
        marked = matches.join(pairs.withColumn("live", F.lit(True)), ["instance", "u", "v"], "left")
        marked = cut(marked.select("instance", "edge", "sc", "u", "v", F.coalesce("live", F.lit(False)).alias("live")))
        each = marked.groupBy("instance", "edge", "sc", "u").agg(F.bool_or("live").alias("live"))
        whole = each.groupBy("instance", "edge", "sc").agg(F.bool_and("live").alias("whole")).where("whole").select("instance", "edge", "sc")
        return marked.where("live").join(whole, ["instance", "edge", "sc"], "left_semi").select("instance", "u", "v").distinct()
    matches = cut(matches)
    mentioned = cut(matches.groupBy("instance", "edge", "sc").agg(F.count_distinct("u").alias("all_u")))
    degree = on_edge.groupBy("instance", "u").agg(F.count(F.lit(1)).alias("degree"))

    def keep(r: DataFrame) -> DataFrame:
        live = matches.join(r, ["instance", "u", "v"])
        alive = live.groupBy("instance", "edge", "sc").agg(F.count_distinct("u").alias("live_u"))
        whole = alive.join(mentioned, ["instance", "edge", "sc"]).where("live_u = all_u").select("instance", "edge", "sc")
        supported = live.join(whole, ["instance", "edge", "sc"]).select("instance", "edge", "u", "v").distinct()
        full = supported.groupBy("instance", "u", "v").agg(F.count(F.lit(1)).alias("n")).join(degree, ["instance", "u"]).where("n = degree")
        return r.join(full.select("instance", "u", "v").distinct(), ["instance", "u", "v"], "left_semi")

    return _until_stable(pairs, keep)


def bounded_reach(arcs: DataFrame, bound: int, starts: DataFrame | None = None) -> DataFrame:
    """(instance, v, w) joined by a non-empty path of at most ``bound`` arcs,
    from all v or from ``starts`` (instance, v) only. Each round writes what it
    finds, alone."""
    arcs = saved(arcs.select("instance", F.col("src").alias("v"), F.col("dst").alias("w")).distinct())
    over, rounds = arcs.select("instance", F.col("v").alias("mid"), "w"), Rounds(arcs.sparkSession)
    front = rounds.add(arcs if starts is None else arcs.join(starts, ["instance", "v"], "left_semi"))
    for _ in range(bound - 1):
        step = front.select("instance", "v", F.col("w").alias("mid")).join(over, ["instance", "mid"]).select("instance", "v", "w").distinct()
        front = rounds.add(step.join(rounds.all(), ["instance", "v", "w"], "left_anti"))
        if front.isEmpty():
            break
    return rounds.all()


def bounded_simulation(allowed: DataFrame, query_arcs: DataFrame, data_arcs: DataFrame, bound: int = 5) -> DataFrame:
    """The greatest bounded simulation in ``allowed(instance, u, v)``: for each
    query arc u to x, v has a path of at most ``bound`` data arcs to some y
    with (x, y) in the relation. Bound 1 is plain simulation."""
    need = query_arcs.select("instance", F.col("src").alias("u"), F.col("dst").alias("x")).distinct()
    allowed = saved(allowed.select("instance", "u", "v").distinct())
    # only paths from a match of an arc's begin to one of an arc's end can matter
    of = lambda end: allowed.join(need.select("instance", F.col(end).alias("u")).distinct(), ["instance", "u"], "left_semi").select("instance", "v").distinct()
    starts, ends = of("u"), of("x").withColumnRenamed("v", "w")
    held = data_arcs.join(starts.select("instance").distinct(), "instance", "left_semi").join(ends.select("instance").distinct(), "instance", "left_semi")
    reach = saved(bounded_reach(held, bound, starts).join(ends, ["instance", "w"], "left_semi"))

    def keep(r: DataFrame) -> DataFrame:
        wanted = r.join(need, ["instance", "u"])
        met = reach.join(r.select("instance", F.col("u").alias("x"), F.col("v").alias("w")), ["instance", "w"]).select("instance", "v", "x").distinct()
        broken = wanted.join(met, ["instance", "v", "x"], "left_anti").select("instance", "u", "v").distinct()
        return r.join(broken, ["instance", "u", "v"], "left_anti")

    return _until_stable(allowed, keep)


def prune_inconsistent(pairs: DataFrame, neighbours: DataFrame, support: DataFrame, require_all: bool = False) -> DataFrame:
    """Deletes (u, v) while some neighbour x of u (instance, u, x) that still
    has matches has none that supports it (instance, u, x, v, y); with
    ``require_all`` a neighbour without any match deletes it as well."""

    def keep(r: DataFrame) -> DataFrame:
        having = r.select("instance", F.col("u").alias("x")).distinct()
        due = neighbours if require_all else neighbours.join(having, ["instance", "x"])
        wanted = r.join(due.select("instance", "u", "x").distinct(), ["instance", "u"])
        met = support.join(r.select("instance", F.col("u").alias("x"), F.col("v").alias("y")), ["instance", "x", "y"]).select("instance", "u", "v", "x").distinct()
        broken = wanted.join(met, ["instance", "u", "v", "x"], "left_anti").select("instance", "u", "v").distinct()
        return r.join(broken, ["instance", "u", "v"], "left_anti")

    return _until_stable(pairs.select("instance", "u", "v").distinct(), keep)


def documents_with_simulation(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents (instance, doc) that hold a pair; all of an instance if none."""
    held = pairs.select("instance", "doc").distinct().withColumn("hit", F.lit(True))
    marked = documents.join(held, ["instance", "doc"], "left")
    some = marked.groupBy("instance").agg(F.max(F.coalesce("hit", F.lit(False))).alias("some"))
    return marked.join(some, "instance").where("hit or not some").drop("hit", "some")
