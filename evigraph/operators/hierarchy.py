"""Concept hierarchies: labels by which ancestry is a comparison, and domains.

``arcs`` is (child, parent); a concept may have several parents. Its label is
the path from a root over smallest parents. What hangs below a concept on that
tree holds it in its label; for what hangs below it on other arcs further
concepts are noted that it covers. So one concept is below another if its label
holds one that the other covers, and no arcs are walked to find out.
Joins of what grows with the arcs are shuffled: a broadcast passes the driver whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Rounds, cut


def concept_labels(arcs: DataFrame) -> DataFrame:
    """(concept, label) of all concepts that hang from a root. Concepts whose
    smallest parents go round a ring have none. A round labels one level."""
    arcs = arcs.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct()
    children = arcs.groupBy(F.col("child").alias("concept")).agg(F.min("parent").alias("parent"))
    roots = arcs.select(F.col("parent").alias("concept")).distinct().join(children.hint("merge"), "concept", "left_anti")
    children, rounds = cut(children), Rounds(arcs.sparkSession)
    front = rounds.add(roots.select("concept", F.array("concept").alias("label")))
    while not front.isEmpty():
        front = rounds.add(children.join(front.withColumnRenamed("concept", "parent").hint("merge"), "parent").select("concept", F.concat("label", F.array("concept")).alias("label")))
    return rounds.all()


def covered_labels(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(concept, cover): what hangs below a concept has a cover in its label. A
    concept covers itself and what arcs off the tree add; covers are concepts, so
    no labels are kept for them. They climb all arcs, and stop where they, or
    the concept above them on the tree, are covered already."""
    named = labels.select(F.col("concept").alias("child"), "label")
    arcs = arcs.select("child", "parent").distinct().join(labels.select(F.col("concept").alias("parent")).hint("merge"), "parent").join(named.hint("merge"), "child")
    up = F.get("label", F.size("label") - 2)
    side = cut(arcs.select("parent", "child", up.alias("above"), F.array_contains("label", F.col("parent")).alias("known")))
    arcs, rounds = side.select("child", "parent"), Rounds(side.sparkSession)
    rounds.add(labels.select("concept", F.col("concept").alias("cover"), F.get("label", F.size("label") - 2).alias("above")))
    side = rounds.add(side.where("not known").select(F.col("parent").alias("concept"), F.col("child").alias("cover"), "above"))
    while not side.isEmpty():
        found = rounds.all().select("concept", "cover")
        climbed = side.withColumnRenamed("concept", "child").join(arcs.hint("merge"), "child").select(F.col("parent").alias("concept"), "cover", "above").distinct()
        climbed = climbed.join(found.hint("merge"), ["concept", "cover"], "left_anti")
        side = rounds.add(climbed.join(found.withColumnRenamed("cover", "above").hint("merge"), ["concept", "above"], "left_anti").select("concept", "cover", "above"))
    return rounds.all().select("concept", "cover")


def below(pairs: DataFrame, labels: DataFrame, covers: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``below``: if a is b or hangs below it; null if one
    of them has no label. Labels meet covers by equality, so no row holds all
    that a concept covers."""
    named = pairs.join(labels.select(F.col("concept").alias("a"), F.col("label").alias("_label")).hint("merge"), "a", "left")
    known = labels.select(F.col("concept").alias("b"), F.lit(True).alias("_known"))
    met = named.join(known.hint("merge"), "b", "left")
    begins = named.select("a", "b", F.explode("_label").alias("cover")).distinct()
    found = begins.join(covers.withColumnRenamed("concept", "b").hint("merge"), ["b", "cover"], "left_semi").select("a", "b").distinct()
    met = met.join(found.withColumn("_found", F.lit(True)).hint("merge"), ["a", "b"], "left")
    return met.select("a", "b", F.when(F.col("_label").isNotNull() & F.col("_known"), F.coalesce("_found", F.lit(False))).alias("below"))


def concept_domains(arcs: DataFrame, tops: DataFrame) -> DataFrame:
    """(concept, domains): the concepts right under ``tops`` (concept) that each
    concept is or hangs below. A concept without a parent that is no top is a
    domain too. Two concepts share an ancestor besides the tops if and only if
    they share a domain; a top has none. Labels and covers meet by equality."""
    arcs = cut(arcs.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct())
    labels = concept_labels(arcs)
    covers = covered_labels(arcs, labels)
    high = F.coalesce("_top", F.lit(False))
    marked = tops.select(F.col("concept").alias("parent"), F.lit(True).alias("_top")).distinct()
    low = arcs.join(marked, "parent", "left").where(~high).select(F.col("child").alias("concept")).distinct()
    domains = labels.select("concept").join(tops.select("concept").distinct(), "concept", "left_anti").join(low.hint("merge"), "concept", "left_anti")
    held = domains.join(covers.hint("merge"), "concept").select(F.col("concept").alias("domain"), F.col("cover").alias("begin"))
    begins = labels.select("concept", F.explode("label").alias("begin"))
    return begins.join(held.hint("merge"), "begin", "left").groupBy("concept").agg(F.array_sort(F.collect_set("domain")).alias("domains"))


def domain_matches(pairs: DataFrame, held: DataFrame, domains: DataFrame, abstractions: DataFrame | None = None) -> DataFrame:
    """``pairs`` (a, b) of vertices with ``match``, true, false or unknown.

    ``held`` is (vertex, concept), ``domains`` of ``concept_domains``. Where both
    have an abstraction, (vertex, abstraction), a common one decides. Else true
    if they share a domain, false if they share none, null if one of them has
    only concepts outside the hierarchy, or none.
    """
    of = held.join(domains.hint("merge"), "concept", "left").groupBy("vertex").agg(F.count("domains").alias("known"), F.array_distinct(F.flatten(F.collect_list("domains"))).alias("domains"))
    # who has tops alone is known, but has no domain
    side = lambda n: of.where("known > 0").select(F.col("vertex").alias(n), F.col("domains").alias(f"{n}_domains")).hint("merge")
    met = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    found = F.arrays_overlap("a_domains", "b_domains")
    if abstractions is not None:
        each = abstractions.where("abstraction is not null").groupBy("vertex").agg(F.collect_set("abstraction").alias("s"))
        for n in ("a", "b"):
            met = met.join(each.select(F.col("vertex").alias(n), F.col("s").alias(f"{n}_abstract")), n, "left")
        found = F.coalesce(F.arrays_overlap("a_abstract", "b_abstract"), found)
    return met.select("a", "b", found.alias("match"))
