"""Consistency methods: transforms of query instances, by name.

Each takes instances (instance, doc, query, text) and returns them with
``text`` annotated or rows left out. Scores are lexical defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector, vertex
from ..operators import build, graph, match, simulation
from ..operators.match import lexical_entailment, lexical_label, with_embedding
from .hyper import Side, hypergraph_simulation
from .tables import cut, saved


def vanilla(rows: DataFrame) -> DataFrame:
    return rows


def contradoc(rows: DataFrame) -> DataFrame:
    """Contradicted documents are marked."""
    marked = F.when(lexical_label(F.col("text"), F.col("query")) == "contradiction", F.concat(F.lit("[CONTRADICTED] "), F.col("text"))).otherwise(F.col("text"))
    return rows.withColumn("text", marked)


def similar_only(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents similar to the query; all of an instance if none is."""
    hit = lexical_entailment(F.col("text"), F.col("query")) >= least
    some = F.max(F.col("_hit").cast("int")).over(Window.partitionBy("instance"))
    return rows.withColumn("_hit", hit).withColumn("_some", some).where("_hit or _some = 0").drop("_hit", "_some")


def sentli(rows: DataFrame) -> DataFrame:
    """A label of the first 512 characters stands before the text."""
    return rows.withColumn("text", F.concat(F.lit("[SENTLI: "), lexical_label(F.substring("text", 1, 512), F.col("query")), F.lit("] "), F.col("text")))


def sparsecl(rows: DataFrame, alpha: float = 1.5) -> DataFrame:
    """The cosine and weighted sparsity stand before the text."""
    staged = with_embedding(with_embedding(rows, "query", "_q"), "text", "_t")
    score = vector.contradiction_score(F.col("_q"), F.col("_t"), alpha)
    return staged.withColumn("text", F.concat(F.format_string("[SparseCL: %.2f] ", score), F.col("text"))).drop("_q", "_t")


def consistent_detection(rows: DataFrame, critical: DataFrame, pairs: DataFrame, near: float = 0.25) -> DataFrame:
    """Documents at a cosine distance of ``near`` or less are consistent; others
    contradict if a critical query vertex (instance, u, and doc where documents
    have their own) has no match (instance, doc, u). Adds ``verdict`` and marks
    the text."""
    far = 1 - vector.cosine(F.col("_q"), F.col("_t"))
    on = [c for c in ("instance", "doc") if c in critical.columns]
    want = rows.select("instance", "doc").join(critical.select(*on, "u").distinct(), on)
    gap = want.join(pairs.select("instance", "doc", "u").distinct(), ["instance", "doc", "u"], "left_anti").select("instance", "doc").distinct().withColumn("_gap", F.lit(True))
    staged = with_embedding(with_embedding(rows, "query", "_q"), "text", "_t")
    judged = staged.join(gap, ["instance", "doc"], "left").withColumn("verdict", F.when((far <= near) | F.col("_gap").isNull(), "consistent").otherwise("contradiction"))
    return judged.withColumn("text", F.concat(F.lit("["), F.col("verdict"), F.lit("] "), F.col("text"))).drop("_gap", "_q", "_t")


def graphs_of(rows: DataFrame) -> tuple[Side, Side, DataFrame]:
    """The lexical graphs of queries and documents, and (pair, instance, doc):
    every document is an instance of its own, met by its query's graph."""
    named = saved(rows.select("instance", "doc", "query", "text", F.xxhash64("instance", "doc").alias("pair")))

    def side(body: str) -> Side:
        vertices, edges = build.rule_graph(named.select(F.col("pair").alias("graph"), F.col(body).alias("text")))
        asked = F.col("query_type") if body == "query" else F.lit(None).cast("string")
        vertices = vertices.select(F.col("graph").alias("instance"), "vertex_id", "text", "type", "poses", F.lit(False).alias("virtual"), asked.alias("query_type"))
        return Side(saved(vertices), cut(edges.select(F.col("graph").alias("instance"), "edge", "pos", "vertex_id")))

    return side("query"), side("text"), named.select("pair", "instance", "doc")


def _arcs(side: Side) -> DataFrame:
    stars = graph.star_edges(side.members.select(F.col("instance").alias("graph"), "edge", "pos", F.col("vertex_id").alias("vertex")))
    return stars.withColumnRenamed("graph", "instance")


def bsim(rows: DataFrame, bound: int = 5) -> DataFrame:
    """Documents whose graph simulates the query's within ``bound`` hops; all of
    an instance if none does."""
    query, data, of = graphs_of(rows)
    allowed = match.allowed_pairs(query.vertices, data.vertices)
    pairs = simulation.bounded_simulation(allowed, _arcs(query), _arcs(data), bound)
    found = pairs.select(F.col("instance").alias("pair")).distinct().join(of, "pair").select("instance", "doc")
    return simulation.documents_with_simulation(rows, found)


def hyper(rows: DataFrame, near: float = 0.25, **limits: float) -> DataFrame:
    """Documents marked as consistent or as contradictions by the simulation of
    their query: see ``consistent_detection``. Critical are the query's nouns."""
    query, data, of = graphs_of(rows)
    relation = hypergraph_simulation(query, data, **limits).relation
    pairs = relation.select(F.col("instance").alias("pair"), "u").distinct().join(of, "pair").select("instance", "doc", "u")
    nouns = query.vertices.where(F.col("query_type").isNull() & vertex.any_pos(F.col("poses"), "NOUN", "PROPN"))
    critical = nouns.select(F.col("instance").alias("pair"), F.col("vertex_id").alias("u")).join(of, "pair").select("instance", "doc", "u")
    return consistent_detection(rows, critical, pairs, near).drop("verdict")


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {"vanilla": vanilla, "contradoc": contradoc, "cdit": similar_only, "sentli": sentli, "sparsecl": sparsecl, "bsim": bsim, "hypergraph_simulation": hyper}


def apply_method(name: str, rows: DataFrame) -> DataFrame:
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}")
    return METHODS[name](rows)
