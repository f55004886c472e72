from pyspark.sql import functions as F

from evigraph.operators import hierarchy


def test_no_row_holds_what_a_concept_covers(spark):
    n = F.col("id")
    arcs = spark.range(3, 300).select(n.alias("child"), F.explode(F.array_distinct(F.array(F.floor(n / 3), F.floor(n / 5)))).alias("parent"))
    labels = hierarchy.concept_labels(arcs)
    covers = hierarchy.covered_labels(arcs, labels)
    assert dict(covers.dtypes) == {"concept": "bigint", "cover": "bigint"}
    pairs = spark.createDataFrame([(7, 1), (7, 1), (299, 0), (8, 7), (8, 8), (8, 900), (900, 8)], "a long, b long")
    found = hierarchy.below(pairs, labels, covers)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(7, 1, True), (7, 1, True), (299, 0, True), (8, 7, False), (8, 8, True), (8, 900, None), (900, 8, None)], key=str)


def test_what_the_concept_above_has_covered_is_not_noted_again(spark):
    n = F.col("id")
    arcs = spark.range(3, 2000).select(n.alias("child"), F.explode(F.array_distinct(F.array(F.floor(n / 3), F.floor(n / 5)))).alias("parent"))
    labels = hierarchy.concept_labels(arcs)
    # at most one for each third that can be taken, and itself
    assert hierarchy.covered_labels(arcs, labels).count() < 2000 * 8
