"""Hypergraphs, results and indexes as tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("dataset", "instance_id", "side", "doc_idx")


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Appends each table (vertices, hyperedges, edge_vertices …) under its
    name, partitioned by dataset; rows of keys that are there already go."""
    for name, df in tables.items():
        fresh = df
        if _exists(df.sparkSession, f"{path}/{name}"):
            there = df.sparkSession.read.parquet(f"{path}/{name}").select(*KEYS).distinct()
            fresh = df.join(there, list(KEYS), "left_anti")
        fresh.write.mode("append").partitionBy("dataset").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, wanted: DataFrame, name: str) -> DataFrame:
    """One table's rows for ``wanted`` keys; a missing document keeps a row of
    nulls, so that places stay aligned."""
    return wanted.select(*KEYS).join(spark.read.parquet(f"{path}/{name}"), list(KEYS), "left")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def not_yet_done(items: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Items whose keys have no result yet: the resume of a batch run."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_results(results: DataFrame, path: str, kind: str = "json") -> None:
    """One more run's rows; earlier ones stay."""
    results.write.mode("append").format(kind).save(path)


def with_status(items: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Items with a status: ready, or skipped with a reason where the index
    has no such key."""
    known = index.select(key).distinct().withColumn("_known", F.lit(True))
    joined = items.join(known, key, "left")
    return joined.withColumns({"status": F.when(F.col("_known"), "ready").otherwise("skipped"), "reason": F.when(F.col("_known").isNull(), "not in dataset")}).drop("_known")


def save_vectors(vectors: DataFrame, path: str, block: int = 50_000) -> None:
    """A vector table in files of ``block`` rows, appended."""
    vectors.write.mode("append").option("maxRecordsPerFile", block).parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_prompts(rows: DataFrame, path: str, question: str, prompt: str) -> None:
    """One JSON line (question, prompt) for each row, appended."""
    rows.select(F.col(question).alias("question"), F.col(prompt).alias("prompt")).write.mode("append").json(path)


def append_run(spark: SparkSession, path: str, run: dict[str, str]) -> None:
    """One run's values as a row of a log; ``load_runs`` reads them all."""
    spark.createDataFrame([run]).write.mode("append").json(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def query_log(events: DataFrame, path: str) -> None:
    """Log lines (question_id, place, line) in a folder for each question."""
    events.repartition("question_id").sortWithinPartitions("question_id", "place").write.mode("append").partitionBy("question_id").json(path)
