"""Merging graphs of several sources, and reports on evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vertex
from ..plans.tables import saved
from . import graph
from .match import Scorer, lexical_entailment, word_overlap_pairs


def merge_edges(vertices: DataFrame, scorer: Scorer = lexical_entailment, least: float = 0.99) -> DataFrame:
    """Merge links (a, b) between vertices (vertex_id, source, text, ents,
    poses) of different sources: equal texts, each linked to the text's first
    vertex only; and compatible entities with texts of four or more letters,
    one entailing the other, that share a word of over three letters."""
    first = vertices.groupBy(F.trim("text").alias("t")).agg(F.min("vertex_id").alias("a"), F.count_distinct("source").alias("n")).where("n > 1 and t <> ''")
    same = vertices.withColumn("t", F.trim("text")).join(first, "t").where("a <> vertex_id").select("a", F.col("vertex_id").alias("b"))
    keyed = vertices.where("length(trim(text)) >= 4").withColumn("instance", F.lit(0))
    pairs = word_overlap_pairs(keyed, keyed).where("u < v")
    side = lambda n: vertices.select(F.col("vertex_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("source", "text", "ents", "poses")])
    both = pairs.join(side("u"), "u").join(side("v"), "v").where("u_source <> v_source")
    return same.union(both.where(_fit(scorer, least)).select("u", "v")).distinct()


def _fit(scorer: Scorer, least: float) -> Column:
    c = F.col
    entails = F.greatest(scorer(c("u_text"), c("v_text")), scorer(c("v_text"), c("u_text"))) >= least
    return vertex.entities_compatible(c("u_ents"), c("v_ents"), c("u_poses"), c("v_poses")) & entails


def instance_links(vertices: DataFrame, scorer: Scorer = lexical_entailment, least: float = 0.99) -> DataFrame:
    """(instance, a, b): ``merge_edges`` inside each instance, for vertices
    (instance, vertex_id, source, text, ents, poses)."""
    first = vertices.groupBy("instance", F.trim("text").alias("t")).agg(F.min("vertex_id").alias("a"), F.count_distinct("source").alias("n")).where("n > 1 and t <> ''")
    same = vertices.withColumn("t", F.trim("text")).join(first, ["instance", "t"]).where("a <> vertex_id").select("instance", "a", F.col("vertex_id").alias("b"))
    keyed = vertices.where("length(trim(text)) >= 4")
    pairs = saved(word_overlap_pairs(keyed, keyed).where("u < v"))
    if pairs.isEmpty():
        return same.distinct()
    side = lambda n: keyed.select("instance", F.col("vertex_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("source", "text", "ents", "poses")])
    both = pairs.join(side("u"), ["instance", "u"]).join(side("v"), ["instance", "v"]).where("u_source <> v_source")
    return same.union(both.where(_fit(scorer, least)).select("instance", "u", "v")).distinct()


def merge_instances(vertices: DataFrame, members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lineage, merged, members) of the graphs of each instance, made one.

    ``vertices`` is (instance, vertex_id, source, text, type, ents, poses,
    virtual), ``members`` (instance, edge, pos, vertex_id), ``links`` (instance,
    a, b); ids are unique in an instance. Lineage (instance, v, vertex_id,
    source) leads from each merged vertex back to all that it was made of. A
    merged vertex has the smallest one's id and text, the highest type, all
    entities and parts of speech; members hold it once an edge, at its first
    place, and then stand close together again.
    """
    key = lambda c: F.struct("instance", F.col(c).alias("id"))
    comp = graph.components(links.select(key("a").alias("a"), key("b").alias("b"))).select("id.instance", F.col("id.id").alias("vertex_id"), F.col("component.id").alias("v"))
    mapped = saved(vertices.join(comp, ["instance", "vertex_id"], "left").withColumn("v", F.coalesce("v", "vertex_id")))
    best = F.max_by(F.struct("type"), F.struct(vertex.level(F.col("type")), -F.col("vertex_id")))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    merged = mapped.groupBy("instance", F.col("v").alias("vertex_id")).agg(F.min_by("text", "vertex_id").alias("text"), best["type"].alias("type"), every("ents"), every("poses"), F.bool_and("virtual").alias("virtual"), F.lit(None).cast("string").alias("query_type"))
    moved = members.join(mapped.select("instance", "vertex_id", "v"), ["instance", "vertex_id"]).groupBy("instance", "edge", "v").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("instance", "edge").orderBy("pos")) - 1
    return mapped.select("instance", "v", "vertex_id", "source"), merged, moved.select("instance", "edge", place.alias("pos"), F.col("v").alias("vertex_id"))


def reverse_trace(query: DataFrame, relation: DataFrame, merged: DataFrame, lineage: DataFrame, texts: DataFrame) -> DataFrame:
    """What each query vertex rests on, back to the sources.

    ``query`` and ``merged`` are (instance, vertex_id, text, ents, poses),
    ``relation`` (instance, u, v), ``lineage`` (instance, v, source), ``texts``
    (instance, source, text). Of critical query vertices: one row for each
    merged vertex in the relation and each of its sources that has a text,
    (instance, u, query_text, matched, evidence, answer, supporting,
    confidence); one row with matched false for a vertex without a relation.
    """
    asked = query.where(vertex.is_critical(F.col("ents"), F.col("poses"))).select("instance", F.col("vertex_id").alias("u"), F.col("text").alias("query_text"), F.col("ents").alias("q_ents"), F.col("poses").alias("q_poses"))
    met = asked.join(relation.select("instance", "u", "v").distinct(), ["instance", "u"], "left")
    found = met.where("v is not null").join(merged.select("instance", F.col("vertex_id").alias("v"), F.col("text").alias("answer"), "ents", "poses"), ["instance", "v"])
    found = found.join(lineage.select("instance", "v", F.col("source").alias("evidence")).distinct(), ["instance", "v"]).join(texts.select("instance", F.col("source").alias("evidence"), F.col("text").alias("evidence_text")), ["instance", "evidence"])
    sure = vertex.match_confidence(F.col("query_text"), F.col("answer"), F.col("q_ents"), F.col("ents"), F.col("q_poses"), F.col("poses"))
    rows = found.select("instance", "u", "query_text", F.lit(True).alias("matched"), "evidence", "answer", supporting_span(F.col("answer"), F.col("evidence_text")).alias("supporting"), sure.alias("confidence"))
    none = lambda kind: F.lit(None).cast(kind)
    missed = met.where("v is null").select("instance", "u", "query_text", F.lit(False).alias("matched"), none(rows.schema["evidence"].dataType).alias("evidence"), none("string").alias("answer"), none("string").alias("supporting"), F.lit(0.0).alias("confidence"))
    return rows.unionByName(missed)


def full_support(trace: DataFrame) -> DataFrame:
    """(instance, evidence) of sources that every traced query vertex rests on:
    a division, by counting."""
    all_of = trace.groupBy("instance").agg(F.count_distinct("u").alias("n"))
    each = trace.where("matched").groupBy("instance", "evidence").agg(F.count_distinct("u").alias("m"))
    return each.join(all_of, "instance").where("n = m").select("instance", "evidence")


def trace_report(trace: DataFrame, texts: DataFrame) -> DataFrame:
    """(instance, context): coverage of the query texts, each evidence with its
    mean confidence, beginning and what it supports, best first; texts with
    different confident answers; texts without support. Each instance's rows
    meet in one text, as that text holds them all."""
    two = lambda c: F.round(c.cast("decimal(20,10)"), 2).cast("decimal(12,2)").cast("string")
    texted = trace.groupBy("instance", "query_text").agg(F.max("matched").alias("hit"))
    cover = texted.groupBy("instance").agg(F.count_if("hit").alias("covered"), F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("query_text")))).alias("missing"))
    line = F.concat(F.lit("  - "), "query_text", F.lit(": "), "supporting")
    mean = (F.sum(F.col("confidence").cast("decimal(20,10)")).cast("double") / F.count("confidence")).alias("mean")
    supports = trace.where("matched").groupBy("instance", F.col("evidence").alias("source")).agg(mean, F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), line.alias("l")))).alias("lines"))
    every = texts.select("instance", "source", "text").join(supports, ["instance", "source"], "left").fillna(0.0, ["mean"]).fillna(0, ["n"])
    band = F.when(F.col("mean") >= 0.8, "high").when(F.col("mean") >= 0.5, "medium").otherwise("low")
    begin = F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))).otherwise(F.col("text"))
    head = F.concat(F.lit("["), F.col("source").cast("string"), F.lit("] "), band, F.lit(", mean "), two(F.col("mean")), F.lit(", matches "), F.col("n").cast("string"), F.lit(": "), begin)
    block = F.array_join(F.concat(F.array(head), F.coalesce(F.transform("lines", lambda x: x["l"]), F.array().cast("array<string>"))), "\n")
    blocks = every.groupBy("instance").agg(F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), (-F.col("n")).alias("c"), "source", block.alias("b")))).alias("blocks"))
    answers = trace.where("matched and confidence >= 0.5").groupBy("instance", "query_text").agg(F.array_sort(F.collect_set("answer")).alias("answers")).where("size(answers) > 1")
    clash = F.concat(F.lit("  - "), "query_text", F.lit(": "), F.array_join("answers", " / "))
    clashes = answers.groupBy("instance").agg(F.array_sort(F.collect_list(clash)).alias("clashes"))
    joined = cover.join(blocks, "instance", "left").join(clashes, "instance", "left")
    part = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(lines, "\n"))).otherwise("")
    missing = F.transform("missing", lambda t: F.concat(F.lit("  - "), t))
    count = F.concat(F.lit("covered "), F.col("covered").cast("string"), F.lit(" of "), F.col("total").cast("string"))
    text = F.concat(count, part("evidence", F.coalesce(F.transform("blocks", lambda x: x["b"]), F.array().cast("array<string>"))), part("conflicting", F.coalesce("clashes", F.array().cast("array<string>"))), part("unsupported", missing))
    return joined.select("instance", text.alias("context"))


def merge_graphs(vertices: DataFrame, edge_vertices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(map, vertices, edges): vertex ids by component, merged vertices with
    the union of their sources, and incidence rewritten, each vertex once an
    edge at its first place; edges keep their source."""
    comp = graph.components(links.select("a", "b"))
    mapped = vertices.join(comp.withColumnRenamed("id", "vertex_id"), "vertex_id", "left").select("vertex_id", F.coalesce("component", "vertex_id").alias("merged"), "text", "source", "type")
    best = F.max_by(F.struct("type"), F.struct(vertex.level(F.col("type")), -F.col("vertex_id")))
    merged = mapped.groupBy("merged").agg(F.min_by("text", "vertex_id").alias("text"), F.sort_array(F.collect_set("source")).alias("provenance"), best["type"].alias("type"))
    moved = edge_vertices.join(mapped.select(F.col("vertex_id").alias("vertex"), "merged"), "vertex").groupBy("edge", "merged").agg(F.min("pos").alias("pos"))
    return mapped.select("vertex_id", "merged"), merged, moved.withColumnRenamed("merged", "vertex")


def evidence_stats(evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches and mean confidence (0.0 without any) of each evidence, with a
    band: high from .8, medium from .5, else low. Confidences are summed as
    decimals of ten places, so the mean does not depend on their order."""
    total = F.sum(F.col("confidence").cast("decimal(20,10)")).cast("double")
    got = matches.groupBy("evidence").agg(F.count("confidence").alias("n"), (total / F.count("confidence")).alias("mean"))
    out = evidence.select("evidence").distinct().join(got, "evidence", "left").fillna(0, ["n"]).fillna(0.0, ["mean"])
    return out.withColumn("band", F.when(F.col("mean") >= 0.8, "high").when(F.col("mean") >= 0.5, "medium").otherwise("low"))


def conflicts(matches: DataFrame, least: float = 0.5) -> DataFrame:
    """Query texts with two or more matches and different confident answers."""
    sure = F.when(F.col("confidence") >= least, F.col("answer"))
    return matches.groupBy("query_text").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(sure).alias("answers")).where("n >= 2 and answers >= 2")


def coverage(parts: DataFrame) -> DataFrame:
    """Covered and all query components (instance, component, matched)."""
    each = parts.groupBy("instance", "component").agg(F.max(F.coalesce("matched", F.lit(False))).alias("hit"))
    return each.groupBy("instance").agg(F.count_if("hit").alias("covered"), F.count(F.lit(1)).alias("total"), F.sort_array(F.collect_list(F.when(~F.col("hit"), F.col("component")))).alias("missing"))


def supporting_span(needle: Column, evidence: Column, around: int = 50, longest: int = 200) -> Column:
    """The needle's first place in the evidence with what stands around it, cut
    at ``longest``; else the first 100 characters."""
    at = F.when(F.trim(needle) == "", 0).otherwise(F.instr(evidence, F.trim(needle)))
    start = F.greatest(F.lit(1), at - around)
    span = F.trim(F.substring(evidence, start, at + F.length(F.trim(needle)) + around - start))
    short = lambda c, n: F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("...")))
    return F.when(at > 0, short(span, longest)).otherwise(short(evidence, 100))


def structured_context(matches: DataFrame) -> DataFrame:
    """One report text for each instance from (instance, evidence, query_text,
    answer, confidence), best evidence and match first."""
    two = lambda c: F.round(c.cast("decimal(20,10)"), 2).cast("decimal(12,2)").cast("string")
    line = F.concat(F.lit("- "), "query_text", F.lit(": "), "answer", F.lit(" ("), two(F.col("confidence")), F.lit(")"))
    mean = F.sum(F.col("confidence").cast("decimal(20,10)")).cast("double") / F.count("confidence")
    each = matches.groupBy("instance", "evidence").agg(mean.alias("mean"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("o"), line.alias("l")))).alias("lines"))
    block = F.concat(F.lit("["), F.col("evidence").cast("string"), F.lit("] mean "), two(F.col("mean")), F.lit(", "), F.col("n").cast("string"), F.lit(" matches\n"), F.array_join(F.transform("lines", lambda x: x["l"]), "\n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("mean")).alias("m"), (-F.col("n")).alias("n"), "evidence", block.alias("b"))))
    return each.groupBy("instance").agg(order.alias("blocks")).select("instance", F.array_join(F.transform("blocks", lambda x: x["b"]), "\n").alias("context"))
