from pyspark.sql import functions as F

from evigraph.operators import match


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_default_embedding_counts_each_place_once(spark):
    row = match.with_embedding(spark.createDataFrame([("a b a c",), ("",)], "t string"), "t", "e")
    places = spark.createDataFrame([(w,) for w in "abac"], "w string").select(F.pmod(F.xxhash64("w"), F.lit(64)).alias("p")).collect()
    counts = [float(sum(r["p"] == i for r in places)) for i in range(64)]
    length = sum(c * c for c in counts) ** 0.5
    assert [r["e"] for r in row.collect()] == [[c / length for c in counts], [0.0] * 64]
    assert "filter(" not in _plan(row)
