import pytest
from pyspark.sql import functions as F

from evigraph.operators import graph, hierarchy


@pytest.fixture
def broadcasts(spark, monkeypatch):
    """Plans of all tables that loops write while a test runs."""
    from evigraph.plans import tables

    plans = []
    keep = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    add, cut = tables.Rounds.add, tables.cut
    monkeypatch.setattr(tables.Rounds, "add", lambda self, df: keep(df) or add(self, df))
    for module in (graph, hierarchy):
        monkeypatch.setattr(module, "cut", lambda df: keep(df) or cut(df))
    return lambda *dfs: [keep(df) for df in dfs] and [p for p in plans if "BroadcastHashJoin" in p]


def test_components_and_hierarchies_broadcast_nothing(spark, broadcasts):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = graph.components(edges)
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 201
    n = F.col("id")
    arcs = spark.range(3, 60).select(n.alias("child"), F.explode(F.array_distinct(F.array(F.floor(n / 3), F.floor(n / 5)))).alias("parent"))
    labels = hierarchy.concept_labels(arcs)
    covers = hierarchy.covered_labels(arcs, labels)
    pairs = spark.range(60).select(n.alias("a"), F.floor(n / 4).alias("b"))
    assert broadcasts(labels, covers, hierarchy.below(pairs, labels, covers)) == []
