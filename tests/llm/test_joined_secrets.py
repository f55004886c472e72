from pyspark.sql import functions as F

from evigraph.llm import secrets


def test_keys_joined_to_base_spans_and_placeholders(spark):
    key = "gH7kQ2zX9pL4vB8nM1cR5tW3yJ6dFs"
    texts = [(1, f"/keys/sk-live-{key}/9f86d081884c7d65 end"), (2, f"{key}/token=abcdefghijklmnop"), (3, f"/your-path/{key}"), (4, f"a 00000000/{key}/1234567 b")]
    got = secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert len(got) == 4 and all(key[:20] not in r.t and key[5:25] not in r.t for r in got), got
