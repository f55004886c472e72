"""Evaluation and cleaning aggregates."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = (1000, 2000, 3000, 4000, 5000)


def ratio(over: Column, under: Column) -> Column:
    """A quotient, 0.0 for a zero denominator."""
    return F.coalesce(over / F.nullif(under, F.lit(0)), F.lit(0.0))


def confusion(df: DataFrame, predicted: str, gold: str, *by: str) -> DataFrame:
    """tp, fp, fn, tn with precision, recall and F1 of both classes; rows
    without a gold label do not count."""
    p, g = F.coalesce(F.col(predicted), F.lit(False)), F.col(gold)
    counts = df.groupBy(*by).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))

    def scores(hit: str, over: str, under: str, prefix: str) -> dict[str, Column]:
        pr, re = ratio(F.col(hit), F.col(hit) + F.col(over)), ratio(F.col(hit), F.col(hit) + F.col(under))
        return {f"{prefix}precision": pr, f"{prefix}recall": re, f"{prefix}f1": ratio(2 * pr * re, pr + re)}

    return counts.withColumns(scores("tp", "fp", "fn", "") | scores("tn", "fn", "fp", "negative_"))


def keep_first(df: DataFrame, key: str, order: str, keep_blank: bool = True) -> DataFrame:
    """The first row of each key; all rows with a blank key if ``keep_blank``.
    Keys are met by an aggregate of ``order``, so a frequent key is combined
    before the shuffle; rows that tie in order both stay."""
    k = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
    first = df.where(k != "").groupBy(k.alias("_key")).agg(F.min(order).alias("_first"))
    named = df.withColumn("_key", k)
    kept = named.join(first, "_key").where(F.col(order) == F.col("_first")).select(df.columns)
    return kept.unionByName(df.where(k == "")) if keep_blank else kept


def token_bucket(n: Column, bounds: tuple[int, ...] = BUCKETS) -> Column:
    """The first bound that ``n`` does not pass; null beyond the last."""
    out = F.lit(None).cast("int")
    for b in reversed(bounds):
        out = F.when(n <= b, b).otherwise(out)
    return out


def recall_at(hits: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 100)) -> DataFrame:
    """(k, recall): questions whose first hit (question, rank from 1) is at k
    or before, over all questions."""
    first = hits.groupBy("question").agg(F.min("rank").alias("first"))
    joined = questions.select("question").distinct().join(first, "question", "left")
    found = joined.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("first") <= k).alias(f"r{k}") for k in ks])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ratio(F.col(f"r{k}"), F.col("n")).alias("recall")) for k in ks]))
    return found.select(pairs.alias("p")).select("p.k", "p.recall")


def weighted_mean(df: DataFrame, name: str, value: str, weight: str) -> DataFrame:
    return df.where(F.col(weight) > 0).groupBy(name).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def sampling_weights(df: DataFrame, key: str, power: float) -> DataFrame:
    """Each key's share of rows, to a power, made to sum to 1."""
    sizes = df.groupBy(key).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("w"))
    total = sizes.agg(F.sum("w").alias("total"))
    return sizes.join(F.broadcast(total)).select(key, (F.col("w") / F.col("total")).alias("weight"))


def tie_adjusted_ranks(df: DataFrame, by: str, score: str, order: str) -> DataFrame:
    """row_number, and the rank of the first of a tie group."""
    w = Window.partitionBy(by).orderBy(F.desc(score))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), order))).withColumn("tie_rank", F.rank().over(w))


def inversions(order: Column) -> Column:
    """How many pairs of an array stand in falling order."""
    return F.aggregate(F.transform(order, lambda x, i: F.size(F.filter(F.slice(order, i + 2, F.size(order)), lambda y: y < x))), F.lit(0), lambda a, x: a + x)


def mean_graph_sizes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean vertices and edges of the graphs of each instance."""
    count = lambda df, c: df.groupBy("instance", "graph").agg(F.count(F.lit(1)).alias(c))
    each = count(vertices, "v").join(count(edges, "e"), ["instance", "graph"], "full").fillna(0)
    return each.groupBy("instance").agg(F.avg("v").alias("mean_vertices"), F.avg("e").alias("mean_edges"))


def corpus_means(df: DataFrame, *columns: str) -> DataFrame:
    """Means of 0-1 measures in percent; 0 for no rows."""
    return df.agg(*[F.coalesce(100 * F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns])


def run_summary(runs: DataFrame, name: str, seconds: str) -> DataFrame:
    """Runs, total and mean seconds of each name."""
    return runs.groupBy(name).agg(F.count(F.lit(1)).alias("runs"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"))


def over_limit(n: Column, limit: int = 4096) -> Column:
    return n > limit


def first_hit_counts(hits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(k, n): how many questions have their first hit at 1..k or before."""
    first = questions.select("question").distinct().join(hits.groupBy("question").agg(F.min("rank").alias("first")), "question", "left")
    places = first.where(F.col("first") <= k).groupBy(F.col("first").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    every = df_range(hits, k).join(places, "k", "left").fillna(0, ["c"])
    return every.select("k", F.sum("c").over(Window.orderBy("k")).alias("n"))


def df_range(df: DataFrame, k: int) -> DataFrame:
    """(k) from 1, a row each."""
    return df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("k"))


def mean_top(order: Column, k: int) -> Column:
    """Of an array of gold ranks in model order: the share of the best ``k``
    golds (ranks below k) among its first ``k``."""
    return F.size(F.filter(F.slice(order, 1, k), lambda x: x < k)) / F.lit(float(k))


def last_gold(order: Column, k: int) -> Column:
    """How far down the array one must go to meet all of the best ``k`` golds."""
    return F.array_max(F.transform(F.filter(F.transform(order, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["x"] < k), lambda p: p["i"])) + 1


def preferred_order(slices: DataFrame, preferred: DataFrame) -> DataFrame:
    """``slices`` (instance, slice, hits) with ``place``: most hits first, of
    equals those in ``preferred`` (instance, slice), then the smaller slice."""
    marked = slices.join(preferred.select("instance", "slice").distinct().withColumn("_p", F.lit(0)), ["instance", "slice"], "left")
    order = Window.partitionBy("instance").orderBy(F.desc("hits"), F.coalesce("_p", F.lit(1)), "slice")
    return marked.withColumn("place", F.row_number().over(order)).drop("_p")


def suffix_number(name: Column) -> Column:
    """The number at the end of a file's stem; names without one come last."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)(?:\.[^.]*)?$", 1).try_cast("bigint"), F.lit(10**9).cast("bigint"))


def index_numbers(n: int, count: int, mode: str = "even", seed: int = 0) -> list[int]:
    """``count`` different places of 0..n-1, all if there are fewer: "even" spread
    from 0, "top" the first ones, "normal" most of them near 0, drawn as the size of
    a normal number, the next free place where one is taken."""
    if count >= n:
        return list(range(n))
    if mode == "even":
        return [i * n // count for i in range(count)]
    if mode == "top":
        return list(range(count))
    if mode != "normal":
        raise ValueError(f"no mode {mode!r}; there are even, top and normal")
    draw, found = random.Random(seed), set()
    while len(found) < count:
        place = int(abs(draw.gauss(0, 1)))
        while place in found:
            place += 1
        if place < n:
            found.add(place)
    return sorted(found)
