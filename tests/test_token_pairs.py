from pyspark.sql import functions as F

from evigraph.operators import match


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_with_the_lexical_label_meet_by_tokens(spark):
    words = ["red car", "Red", "blue car", "car", "...", "", "a b c d e f car", "tree"]
    side = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "instance long, vertex_id long, text string").select("*", F.lit(None).cast("string").alias("type"), F.array(F.lit("NOUN")).alias("poses"), F.lit(False).alias("virtual"), F.when(F.col("vertex_id") % 2 == 1, "WHAT").alias("query_type"))
    found = match.allowed_pairs(side, side)
    # the same label under another name meets all pairs of a type
    every = match.allowed_pairs(side, side, label=lambda p, h: match.lexical_label(p, h))
    assert "_token" in _plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect())) != []
