"""Clusters of hyperedges, and texts of paths through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vertex
from ..plans.tables import cut

_VERBS = ("VERB", "AUX")


def first_come(arcs: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Those of ``arcs`` (graph, edge, head) that are accepted when they are
    taken by rising ``edge`` and one is refused if its head stands in an arc
    accepted before, or in ``taken`` (graph, edge).

    Rounds: an arc is decided once no open arc before it touches its head, so
    independent arcs of all graphs are decided together."""
    ends = lambda df: df.select("graph", "edge").union(df.select("graph", F.col("head").alias("edge"))).distinct()
    now = arcs.select("graph", "edge", "head").distinct()
    if taken is not None:
        now = now.join(taken.select("graph", F.col("edge").alias("head")).distinct(), ["graph", "head"], "left_anti")
    now, accepted = cut(now), None
    while not now.isEmpty():
        touched = now.select("graph", "edge", F.explode(F.array("edge", "head")).alias("key"))
        first = touched.groupBy("graph", F.col("key").alias("head")).agg(F.min("edge").alias("first"))
        free = cut(now.join(first, ["graph", "head"]).where("first >= edge").select("graph", "edge", "head"))
        accepted = free if accepted is None else accepted.unionByName(free)
        rest = now.join(free.select("graph", "edge"), ["graph", "edge"], "left_anti")
        now = cut(rest.join(ends(free).withColumnRenamed("edge", "head"), ["graph", "head"], "left_anti"))
    return now if accepted is None else accepted


def combine_edges(edges: DataFrame, children: DataFrame) -> DataFrame:
    """(graph, cluster, edge, rule) of ``edges`` (graph, edge, idx, pos, dep,
    head, head_pos: the root's token and its parent) and ``children`` (graph,
    edge, idx, pos: the other tokens).

    noun: an edge whose root is no verb joins the edges of its verbs, each by
    the first that asks. relative: an edge whose root is a relative clause
    joins its head's edge. clause: a verb's edge that is an adverbial or
    complement clause joins its head verb's edge. The latter two in order of
    edges, while the head's edge is free. single: every edge left. ``cluster``
    is the joining edge; of edges with one root token the last is meant.
    """
    rooted = edges.groupBy("graph", "idx").agg(F.max("edge").alias("other"))
    verbs = children.where(F.col("pos").isin(*_VERBS)).select("graph", "edge", "idx").distinct()
    asked = edges.where(~F.col("pos").isin(*_VERBS)).select("graph", "edge").join(verbs, ["graph", "edge"]).join(rooted, ["graph", "idx"])
    claimed = cut(asked.groupBy("graph", F.col("other")).agg(F.min("edge").alias("cluster")))
    noun = claimed.select("graph", "cluster", F.col("other").alias("edge")).union(claimed.select("graph", "cluster", F.col("cluster").alias("edge"))).distinct()

    def joined(condition) -> DataFrame:
        at = rooted.select("graph", F.col("idx").alias("head"), F.col("other").alias("_of"))
        return edges.where(condition & F.col("head").isNotNull()).join(at, ["graph", "head"]).select("graph", "edge", F.col("_of").alias("head"))

    pairs = lambda arcs: arcs.select("graph", F.col("edge").alias("cluster"), F.explode(F.array("edge", "head")).alias("edge")).distinct()
    relative = pairs(first_come(joined(F.col("dep") == "relcl"), noun))
    used = noun.select("graph", "edge").union(relative.select("graph", "edge")).distinct()
    clause_root = F.col("pos").isin(*_VERBS) & F.col("dep").isin("advcl", "ccomp") & F.col("head_pos").isin(*_VERBS)
    clause = pairs(first_come(joined(clause_root), used))
    used = used.union(clause.select("graph", "edge")).distinct()
    single = edges.select("graph", "edge").join(used, ["graph", "edge"], "left_anti").select("graph", F.col("edge").alias("cluster"), "edge")
    out = None
    for rule, part in (("noun", noun), ("relative", relative), ("clause", clause), ("single", single)):
        named = part.withColumn("rule", F.lit(rule))
        out = named if out is None else out.unionByName(named)
    return out


def vertex_pairs(clusters: DataFrame, likely: DataFrame) -> DataFrame:
    """(instance, cluster, v, w): data vertices that likely stand for two
    vertices of one query cluster, not twice the same and not both verbs.

    ``clusters`` is (instance, cluster, u, verb), ``likely`` (instance, u, v,
    verb); several joins on the instance and a vertex, never all pairs."""
    side = lambda u, verb: clusters.select("instance", "cluster", F.col("u").alias(u), F.col("verb").alias(verb))
    pairs = side("u", "u_verb").join(side("x", "x_verb"), ["instance", "cluster"]).where("u <> x and not (u_verb and x_verb)")
    for_u = likely.select("instance", "u", "v", F.col("verb").alias("v_verb"))
    for_x = likely.select("instance", F.col("u").alias("x"), F.col("v").alias("w"), F.col("verb").alias("w_verb"))
    met = pairs.join(for_u, ["instance", "u"]).join(for_x, ["instance", "x"]).where("v <> w and not (v_verb and w_verb)")
    return met.select("instance", "cluster", "v", "w").distinct()


def cluster_of_path(paths: DataFrame) -> DataFrame:
    """``paths`` (…, path) with ``d_cluster``, a hash of the set of its edges;
    paths without edges are left out."""
    return paths.where(F.size("path") > 0).withColumn("d_cluster", F.xxhash64(F.array_sort(F.array_distinct("path"))))


def path_texts(ends: DataFrame, steps: DataFrame) -> DataFrame:
    """(path, text) of paths, with tokens of a known type as ``TYPE#n``.

    ``ends`` is (path, node, type, end: 0 or 1), ``steps`` (path, step, idx,
    node, text, type). Tokens of a type are numbered in order of first use,
    the ends before all. Tokens of a step are joined by a space, by idx; steps
    by ". "."""
    used = ends.select("path", "node", "type", F.struct(F.lit(-1).alias("s"), F.col("end").cast("long").alias("i")).alias("at"))
    used = used.unionByName(steps.select("path", "node", "type", F.struct(F.col("step").cast("int").alias("s"), F.col("idx").cast("long").alias("i")).alias("at")))
    first = used.where("type is not null").groupBy("path", "node", "type").agg(F.min("at").alias("at"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("path", "type").orderBy("at", "node"))).select("path", "node", F.concat("type", F.lit("#"), F.col("n").cast("string")).alias("label"))
    worded = steps.join(numbered, ["path", "node"], "left").select("path", "step", "idx", F.coalesce("label", "text").alias("word"))
    each = worded.groupBy("path", "step").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ").alias("line"))
    return each.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "line"))), lambda x: x["line"]), ". ").alias("text"))


def triples(edge_nodes: DataFrame) -> DataFrame:
    """(graph, edge, text), ``root(a, b)``, of (graph, edge, pos, text)."""
    parts = edge_nodes.groupBy("graph", "edge").agg(F.min_by("text", "pos").alias("root"), F.sort_array(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "text")))).alias("args"))
    return parts.select("graph", "edge", F.concat("root", F.lit("("), F.array_join(F.transform("args", lambda a: a["text"]), ", "), F.lit(")")).alias("text"))


def attribute_triples(tokens: DataFrame) -> DataFrame:
    """(graph, idx, text), ``attr(head, word)``, of adjectives and adverbs that
    describe a noun or verb in tokens (graph, idx, text, pos, dep, head)."""
    head = tokens.where(F.col("pos").isin("NOUN", "PROPN", "VERB")).select("graph", F.col("idx").alias("head"), F.col("text").alias("head_text"))
    words = tokens.where(F.col("pos").isin("ADJ", "ADV") & F.col("dep").isin("amod", "advmod")).join(head, ["graph", "head"])
    return words.select("graph", "idx", F.concat(F.lit("attr("), "head_text", F.lit(", "), "text", F.lit(")")).alias("text"))


def triple_text(parts: DataFrame) -> DataFrame:
    """(graph, cluster, text): a cluster's triples joined by " & ", by edge."""
    listed = F.sort_array(F.collect_list(F.struct("edge", "text")))
    return parts.groupBy("graph", "cluster").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " & ").alias("text"))


def match_candidates(q_vertices: DataFrame, d_vertices: DataFrame, pairs: DataFrame, answers: bool = False) -> DataFrame:
    """(sc, u, v) of cluster pairs (sc, q, d): vertices of (cluster, vertex_id,
    type, verb, query_type) with equal types, two unknown ones included, and no
    verbs. A question word matches nothing, unless ``answers``: then what can
    answer it."""
    q = pairs.select("sc", F.col("q").alias("cluster")).join(q_vertices, "cluster").select("sc", F.col("vertex_id").alias("u"), F.col("type").alias("u_type"), F.col("verb").alias("u_verb"), F.col("query_type").alias("asked"))
    d = pairs.select("sc", F.col("d").alias("cluster")).join(d_vertices, "cluster").select("sc", F.col("vertex_id").alias("v"), F.col("type").alias("v_type"), F.col("verb").alias("v_verb"), F.col("poses").alias("v_poses"))
    plain = q.where("asked is null and not u_verb").join(d.where("not v_verb").withColumnRenamed("sc", "_sc"), (F.col("sc") == F.col("_sc")) & F.col("u_type").eqNullSafe(F.col("v_type"))).select("sc", "u", "v")
    if not answers:
        return plain.distinct()
    asked = q.where("asked is not null").join(d, "sc").where(vertex.answers_query(F.col("asked"), F.col("v_type"), F.col("v_poses")))
    return plain.union(asked.select("sc", "u", "v")).distinct()
