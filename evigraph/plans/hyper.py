"""The simulation from two graphs' tables to the relation, end to end.

A side is ``Side(vertices, members)``: vertices (instance, vertex_id, text,
type, poses, virtual, query_type) and members (instance, edge, pos, vertex_id),
the root at pos 0. ``clusters`` of the query side are (instance, cluster, edge);
without them each edge is a cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render, vector, vertex
from ..operators import clusters as C
from ..operators import fusion, graph, match, simulation
from .tables import cut


@dataclass(frozen=True)
class Side:
    vertices: DataFrame
    members: DataFrame


@dataclass(frozen=True)
class Simulation:
    """The relation (instance, u, v), and what led to it: cluster pairs
    (instance, sc, q, d, score) and their matches (instance, sc, u, v)."""

    relation: DataFrame
    delta: DataFrame
    d_match: DataFrame


def _texts(side: Side) -> DataFrame:
    """(instance, edge, text) of every edge: its vertices in order."""
    words = side.members.join(side.vertices.select("instance", "vertex_id", "text"), ["instance", "vertex_id"])
    listed = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return words.groupBy("instance", "edge").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"))


def _cluster_texts(of_edges: DataFrame, texts: DataFrame) -> DataFrame:
    met = of_edges.join(texts, ["instance", "edge"])
    return met.groupBy("instance", "cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("edge", "text"))), lambda x: x["text"]), ". ").alias("text"))


def _verb(poses) -> object:
    return vertex.any_pos(poses, "VERB", "AUX")


def _in_clusters(of_edges: DataFrame, side: Side) -> DataFrame:
    named = side.vertices.select("instance", "vertex_id", "text", "type", "poses", "query_type", _verb(F.col("poses")).alias("verb"))
    return of_edges.join(side.members, ["instance", "edge"]).join(named, ["instance", "vertex_id"])


def delta_pairs(query: Side, data: Side, likely: DataFrame, of_query: DataFrame, sigma: float, max_hops: int = -1) -> tuple[DataFrame, DataFrame]:
    """(pairs, of_data): cluster pairs (instance, sc, q, d, score) of ``sigma``
    or more, one half at least, and the edges (instance, cluster, edge) of data
    clusters, which are shortest paths between likely vertices. Both sides of a
    pair hold a vertex that is no verb."""
    in_q = cut(_in_clusters(of_query, query).select("instance", "cluster", "vertex_id", "verb").distinct())
    marked = likely.join(data.vertices.select("instance", F.col("vertex_id").alias("v"), _verb(F.col("poses")).alias("verb")), ["instance", "v"]).select("instance", "u", "v", "verb")
    wanted = cut(C.vertex_pairs(in_q.withColumnRenamed("vertex_id", "u"), marked))
    incidence = data.members.select(F.col("instance").alias("graph"), "edge", F.col("vertex_id").alias("vertex"))
    starts = wanted.select(F.col("instance").alias("graph"), F.col("v").alias("src")).distinct()
    paths = graph.shortest_hyperpaths(incidence, starts, max_hops).select(F.col("graph").alias("instance"), F.col("src").alias("v"), F.col("dst").alias("w"), "path")
    found = C.cluster_of_path(wanted.join(paths, ["instance", "v", "w"]))
    candidates = cut(found.select("instance", F.col("cluster").alias("q"), F.col("d_cluster").alias("d"), "path").dropDuplicates(["instance", "q", "d"]))
    of_data = cut(candidates.select("instance", F.col("d").alias("cluster"), F.explode("path").alias("edge")).distinct())
    embed = lambda of_edges, side: match.with_embedding(_cluster_texts(of_edges, _texts(side)), "text", "embedding")
    left, right = embed(of_query, query), embed(of_data, data)
    scored = candidates.select("instance", "q", "d").join(left.select("instance", F.col("cluster").alias("q"), F.col("embedding").alias("x")), ["instance", "q"]).join(right.select("instance", F.col("cluster").alias("d"), F.col("embedding").alias("y")), ["instance", "d"])
    scored = scored.withColumn("score", vector.cosine(F.col("x"), F.col("y"))).where(F.col("score") >= max(sigma, 0.5))
    plain = lambda df, name: df.where("not verb").select("instance", F.col("cluster").alias(name)).distinct()
    kept = scored.join(plain(in_q, "q"), ["instance", "q"], "left_semi").join(plain(_in_clusters(of_data, data), "d"), ["instance", "d"], "left_semi")
    return cut(kept.select("instance", F.xxhash64("instance", "q", "d").alias("sc"), "q", "d", "score")), of_data


def representatives(of_edges: DataFrame, side: Side) -> DataFrame:
    """(instance, cluster, vertex_id): the smallest vertex that is no verb."""
    return _in_clusters(of_edges, side).where("not verb").groupBy("instance", "cluster").agg(F.min("vertex_id").alias("vertex_id"))


def _edge_descriptions(of_edges: DataFrame, side: Side, asked: DataFrame, name: str) -> DataFrame:
    """``asked`` (path, instance, cluster, a, b) with the text of each cluster's
    edges in which vertices of a known type are written ``TYPE#n``."""
    held = _in_clusters(of_edges, side)
    label = render.type_label(F.col("query_type"), F.col("type"), F.element_at("poses", 1))
    steps = asked.select("path", "instance", "cluster").join(held, ["instance", "cluster"]).select("path", F.dense_rank().over(_by_edge()).alias("step"), F.col("pos").alias("idx"), F.col("vertex_id").alias("node"), "text", label.alias("type"))
    kinds = side.vertices.select("instance", F.col("vertex_id").alias("node"), label.alias("type"))
    ends = asked.select("path", "instance", F.posexplode(F.array("a", "b")).alias("end", "node")).join(kinds, ["instance", "node"]).select("path", "node", "type", "end")
    return C.path_texts(ends, steps).select("path", F.col("text").alias(name))


def _by_edge():
    from pyspark.sql.window import Window

    return Window.partitionBy("path").orderBy("edge")


def d_matches(query: Side, data: Side, pairs: DataFrame, of_query: DataFrame, of_data: DataFrame, delta: float, scorer: match.Scorer = match.lexical_entailment) -> DataFrame:
    """(instance, sc, u, v, score), one to one in each cluster pair: u and v of
    one type count by how well the texts between them and their neighbours
    agree, the mean over neighbours, where it is over ``delta``."""
    q, d = cut(_in_clusters(of_query, query)), cut(_in_clusters(of_data, data))
    # cluster names are unique within an instance only
    named = lambda df: df.withColumn("cluster", F.xxhash64("instance", "cluster")).select("cluster", "vertex_id", "type", "verb", "query_type", "poses").distinct()
    keyed = pairs.select("sc", F.xxhash64("instance", "q").alias("q"), F.xxhash64("instance", "d").alias("d"))
    r = cut(C.match_candidates(named(q), named(d), keyed))
    beside = q.select("instance", "cluster", "edge", F.col("vertex_id").alias("u")).join(q.where("pos > 0").select("instance", "cluster", "edge", F.col("vertex_id").alias("x")), ["instance", "cluster", "edge"]).where("u <> x").select("instance", F.col("cluster").alias("q"), "u", "x").distinct()
    met = pairs.select("instance", "sc", "q", "d").join(beside, ["instance", "q"]).join(r, ["sc", "u"]).join(r.select("sc", F.col("u").alias("x"), F.col("v").alias("y")), ["sc", "x"]).where("v <> y")
    met = cut(met.withColumn("q_path", F.xxhash64("sc", "u", "x")).withColumn("d_path", F.xxhash64("sc", "v", "y")))
    asked = lambda path, cluster, a, b: met.select(F.col(path).alias("path"), "instance", F.col(cluster).alias("cluster"), F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    left = _edge_descriptions(of_query, query, asked("q_path", "q", "u", "x"), "q_text").withColumnRenamed("path", "q_path")
    right = _edge_descriptions(of_data, data, asked("d_path", "d", "v", "y"), "d_text").withColumnRenamed("path", "d_path")
    rows = met.join(left, "q_path").join(right, "d_path").select(F.col("sc").alias("pair"), "u", "v", F.struct("x", "y").alias("place"), scorer(F.col("d_text"), F.col("q_text")).alias("score"))
    best = match.greedy_one_to_one(match.dmatch_scores(rows, delta))
    return best.select(F.col("pair").alias("sc"), "u", "v", "score").join(pairs.select("instance", "sc"), "sc").select("instance", "sc", "u", "v", "score")


def hypergraph_simulation(query: Side, data: Side, clusters: DataFrame | None = None, sigma: float = 0.75, b: int = 5, delta: float = 0.7, label: match.Scorer | None = match.lexical_label, strict: bool = False) -> Simulation:
    """Allowed pairs by type, the ``b`` likeliest of each query vertex, cluster
    pairs from ``sigma``, matches over ``delta``, and the greatest relation in
    which every pair stays supported (``operators.simulation``). A cluster pair
    supports at the query edges that hold a vertex of its query cluster that is
    no verb. Every step is a join or an aggregate over all instances at once."""
    allowed = cut(match.allowed_pairs(query.vertices, data.vertices, label=label))
    likely = match.top_b(allowed, b).select("instance", "u", "v")
    of_query = cut(clusters if clusters is not None else query.members.select("instance", F.col("edge").alias("cluster"), "edge").distinct())
    pairs, of_data = delta_pairs(query, data, likely, of_query, sigma)
    matched = cut(d_matches(query, data, pairs, of_query, of_data, delta))
    plain = _in_clusters(of_query, query).where("not verb").select("instance", F.col("cluster").alias("q"), "vertex_id").distinct()
    reach = pairs.select("instance", "sc", "q").join(plain, ["instance", "q"]).join(query.members.select("instance", "edge", "vertex_id"), ["instance", "vertex_id"]).select("instance", "sc", "edge").distinct()
    on_edge = matched.join(reach, ["instance", "sc"]).select("instance", "edge", "sc", "u", "v")
    edges = query.members.select("instance", "edge", F.col("vertex_id").alias("u"))
    return Simulation(simulation.edge_simulation(allowed, edges, on_edge, strict), pairs, matched)


@dataclass(frozen=True)
class Fusion:
    """``trace`` (``fusion.reverse_trace``), ``report`` (instance, context), the
    relation (instance, u, v) over merged vertices, and their lineage (instance,
    v, vertex_id, source)."""

    trace: DataFrame
    report: DataFrame
    relation: DataFrame
    lineage: DataFrame


def fuse(query: Side, evidence: Side, texts: DataFrame, scorer: match.Scorer = match.lexical_entailment, **simulation_settings) -> Fusion:
    """Evidence of several sources as one graph, simulated and traced back.

    Vertices of both sides also have ents; evidence vertices have a source, and
    ``texts`` is (instance, source, text). Sources are merged inside their
    instance, the query is simulated in what comes out, and every critical query
    vertex is followed through the relation and the lineage to its sources.
    """
    vertices = cut(evidence.vertices)
    links = cut(fusion.instance_links(vertices, scorer))
    lineage, merged, members = fusion.merge_instances(vertices, evidence.members, links)
    lineage, merged = cut(lineage), cut(merged)
    found = hypergraph_simulation(query, Side(merged, cut(members)), **simulation_settings)
    relation = cut(found.relation)
    trace = cut(fusion.reverse_trace(query.vertices, relation, merged, lineage, texts))
    return Fusion(trace, fusion.trace_report(trace, texts), relation, lineage)
