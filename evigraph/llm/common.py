"""Shared helpers of the training-data operators: shared-folder tables, word
offsets in byte buffers, and connected components.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` in the UTF-8 form
of a text, which are the same words as the code-point pattern finds.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) is a folder of our own
    set, and only with a local master, because there all runs on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evigraph-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes the files of those of ``tables`` that ``stored`` gave, once
    nothing reads them any more; others are left alone. Spark deletes shuffle
    files when the driver's collector finds their plans gone, so it is asked to."""
    for table in tables:
        if path := getattr(table, "_stored_at", None):
            sc = table.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; else the
    join shuffles. Rows are a few numbers each, so about 50 bytes a row."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one table; only these reach the scan's read schema."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words:
    """Word offsets of many texts held in one byte buffer.

    ``start``/``end`` are byte offsets of every word, ``first`` has for each
    text the index of its first word (one entry more than texts).
    """

    def __init__(self, texts: list[bytes]):
        buffer = b" ".join(texts) + b" "
        self.bytes = np.frombuffer(buffer, np.uint8)
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
        self.first = np.searchsorted(self.start, begin)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id in ``edges``: columns (id, component).

    Alternates large-star and small-star steps; each round is a pair of
    shuffled aggregations, nothing is gathered in one place, and a hub's
    neighbours are only ever reduced by ``min``. Rows with a null end and self
    loops give no link. Raises if the fixpoint is not reached in ``rounds``.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    current = checkpointed(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        sides = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v")))
        current = checkpointed(small.distinct())
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = current.groupBy("u").agg(F.min("v").alias("component"))
            tops = current.select(F.col("v").alias("u")).distinct().join(roots, "u", "left_anti").select("u", F.col("u").alias("component"))
            return roots.union(tops).withColumnRenamed("u", "id")
        before = state
    raise RuntimeError(f"components not settled after {rounds} rounds")
