"""Mentions of clusters, carried over to another tokenisation and settled.

Spans meet tokens, and each other, in buckets of places: a span is put into each
bucket that it touches and looks only there, so no two rows meet because they
share a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters, and tokens, of a bucket.
CHARS, TOKENS = 64, 16


def buckets(start, end, width: int):
    """The buckets of places that a half-open span touches; an empty span is
    where it starts."""
    return F.sequence(F.floor(start / width).cast("long"), F.floor((F.greatest(end, start + 1) - 1) / width).cast("long"))


def token_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """``spans`` (graph, …, char_start, char_end) that begin inside a token and end
    inside or at the end of one, with ``start`` and ``end``, half open, of
    ``tokens`` (graph, idx, char_start, char_end). Others are left out."""
    held = tokens.select("graph", "idx", F.col("char_start").alias("_s"), F.col("char_end").alias("_e")).where("_s < _e")
    held = held.withColumn("_bucket", F.explode(buckets(F.col("_s"), F.col("_e"), CHARS)))
    first = held.select("graph", "_bucket", F.col("idx").alias("start"), "_s", "_e")
    begun = spans.withColumn("_bucket", F.floor(F.col("char_start") / CHARS).cast("long")).join(first, ["graph", "_bucket"]).where("_s <= char_start and char_start < _e").drop("_bucket", "_s", "_e")
    last = held.select("graph", "_bucket", (F.col("idx") + 1).alias("end"), "_s", "_e")
    return begun.withColumn("_bucket", F.floor((F.col("char_end") - 1) / CHARS).cast("long")).join(last, ["graph", "_bucket"]).where("_s < char_end and char_end <= _e").drop("_bucket", "_s", "_e")


def updated_mentions(ranges: DataFrame, tokens: DataFrame) -> DataFrame:
    """(graph, cluster, start, end, primary): the mentions of clusters over new
    tokens, from their character ranges (graph, cluster, char_start, char_end,
    primary) and ``tokens`` (graph, idx, char_start, char_end).

    Ranges that no longer begin and end inside tokens are left out. Equal spans
    of a cluster are one mention, primary if one of them was.
    """
    return token_spans(ranges, tokens).groupBy("graph", "cluster", "start", "end").agg(F.max("primary").alias("primary"))


def dropped_clusters(mentions: DataFrame) -> DataFrame:
    """(graph, cluster) of clusters that give way to another: of clusters with
    mentions (graph, cluster, start, end, root) on one root token only that with
    the shortest span there stays, the smallest of equals. A cluster is dropped
    whole, whatever else it mentions."""
    best = mentions.groupBy("graph", "root").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), "cluster")).alias("m"))
    lost = mentions.join(best, ["graph", "root"]).where(F.col("cluster") != F.col("m.cluster"))
    return lost.select("graph", "cluster").distinct()


def containment(spans: DataFrame) -> DataFrame:
    """``spans`` (graph, start, end) with ``outer_start``, ``outer_end``, the
    smallest span that holds it (of equally long ones that which starts first),
    and ``crossing``, if one starts inside it and ends outside or the other way
    round. Equal spans are one; those held by none have null."""
    own = spans.select("graph", "start", "end").where("start < end").distinct()
    spread = own.withColumn("_bucket", F.explode(buckets(F.col("start"), F.col("end"), TOKENS)))
    other = spread.select("graph", "_bucket", F.col("start").alias("s"), F.col("end").alias("e"))
    met = spread.join(other, ["graph", "_bucket"]).where("(s <> start or e <> end) and s < end and start < e")
    holds = (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e"))
    inside = (F.col("start") <= F.col("s")) & (F.col("e") <= F.col("end"))
    best = F.min(F.when(holds, F.struct((F.col("e") - F.col("s")).alias("n"), "s", "e")))
    found = met.groupBy("graph", "start", "end").agg(best.alias("m"), F.max(~holds & ~inside).alias("crossing"))
    joined = own.join(found, ["graph", "start", "end"], "left")
    return joined.select("graph", "start", "end", F.col("m.s").alias("outer_start"), F.col("m.e").alias("outer_end"), F.coalesce("crossing", F.lit(False)).alias("crossing"))


def settled_spans(spans: DataFrame) -> DataFrame:
    """Those of ``spans`` (graph, start, end) that no other holds: the outermost.
    Crossing ones all stay, since neither holds the other."""
    return containment(spans).where("outer_start is null").select("graph", "start", "end", "crossing")
