"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """A new folder in the checkpoint directory."""
    _directory(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def _directory(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="evigraph-"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table and read back. Columns are compressed,
    so this takes a fraction of a checkpoint's disk where rows are many."""
    rounds = Rounds(df.sparkSession)
    return rounds.add(df)


class Rounds:
    """What the rounds of a loop find, each written alone and all read as one
    table: plans and numbers of tasks do not grow with the rounds."""

    def __init__(self, spark: SparkSession):
        self._spark, self._at, self._n, self._schema = spark, _folder(spark), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a round and returns it."""
        self._schema = df.schema if self._schema is None else self._schema
        path = f"{self._at}/r{self._n}"
        df.write.parquet(path)
        self._n += 1
        return self._spark.read.schema(self._schema).parquet(path)

    def all(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(f"{self._at}/r*")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to ``spark.checkpoint.dir``; a folder of our own
    only where the session names none and all runs on this machine."""
    _directory(df.sparkSession)
    return df.checkpoint(eager=True)
