"""Vertex ids by nearly equal texts, in the order in which texts come.

Two texts are near if ``text.fuzzy_ratio`` is at least ``LEAST``, that is an
edit distance of at most a tenth of the longer one. Near texts of a graph meet
through their pieces: a text that may bear k edits is cut into k + 1 pieces, one
of which stands unchanged somewhere in the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.tables import cut
from . import graph

#: Texts from this ratio on may share an id; equal ones always do.
LEAST = 90
#: Lengths of pieces. A text of n letters may bear n / 9 edits of a longer one,
#: hence its pieces have five letters at least and nine at most.
PIECES = (5, 9)


def near_texts(forms: DataFrame) -> DataFrame:
    """(graph, a, b, score), a < b, of all near but unequal texts of a graph in
    ``forms`` (graph, text). Texts of under ten letters are near to none. No text
    meets one with which it shares no piece, nor one that is too long or short."""
    longer = forms.select("graph", "text").where("length(text) >= 9").distinct()
    n = F.length("text")
    edits = F.floor(n / 9).cast("int")
    # piece i runs from i * n / (k + 1) to (i + 1) * n / (k + 1)
    cut_at = lambda i: F.floor(i * F.length("text") / (F.floor(F.length("text") / 9) + 1)).cast("int")
    own = longer.select("graph", F.col("text").alias("a"), F.explode(F.transform(F.sequence(F.lit(0), edits), lambda i: F.substring("text", cut_at(i) + 1, cut_at(i + 1) - cut_at(i)))).alias("piece")).distinct()
    at = F.transform(F.split("text", ""), lambda c, i: i)
    lengths = F.array(*[F.lit(m) for m in range(PIECES[0], PIECES[1] + 1)])
    runs = F.flatten(F.transform(at, lambda i: F.transform(lengths, lambda m: F.when(i + m <= F.length("text"), F.substring(F.col("text"), i + 1, m)))))
    whole = longer.select("graph", F.col("text").alias("b"), F.explode(F.array_distinct(F.array_compact(runs))).alias("piece"))
    fits = F.abs(F.length("a") - F.length("b")) * 10 <= F.greatest(F.length("a"), F.length("b"))
    met = own.join(whole, ["graph", "piece"]).where("a <> b").where(fits)
    pairs = met.select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("score", text.fuzzy_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= LEAST)


def fuzzy_vertex_ids(nodes: DataFrame) -> DataFrame:
    """(graph, idx, vertex_id) of vertices (graph, idx, text, pos, ent, primary).

    In order of idx, lower-case texts open ids or join one. A text that opened an
    id always joins it. Another joins the nearest of those before it, the first
    of equals, if its pos and ent are what that id has; else it opens its own.
    An id has the ent of its first vertex and the pos of its last. Vertices with
    a ``primary`` (the idx of whom they mention) come after all others, first
    those that are their own; the rest take the id of their primary if that is a
    vertex. Ids count from 1 in the order in which they were opened.

    What was joined before decides, so near texts are gone through in order.
    Only texts with near ones are, those that hang together at a time: a task
    reads their rows sorted and holds an entry for each different text. All
    other texts are settled by their first row.
    """
    rank = F.when(F.col("primary").isNull(), 0).when(F.col("primary") == F.col("idx"), 1).otherwise(2)
    rows = nodes.select("graph", F.col("idx").cast("long"), F.lower("text").alias("text"), "pos", "ent", F.col("primary").cast("long"))
    there = rows.select("graph", F.col("idx").alias("primary"), F.lit(True).alias("known"))
    rows = cut(rows.withColumn("rank", rank).join(there, ["graph", "primary"], "left").withColumn("follows", F.coalesce((F.col("rank") == 2) & F.col("known"), F.lit(False))))
    own = rows.where("not follows").select("graph", "idx", "rank", "text", "pos", "ent")
    near = cut(near_texts(own.select("graph", "text")))
    key = lambda c: F.struct("graph", F.col(c).alias("text"))
    families = graph.components(near.select(key("a").alias("a"), key("b").alias("b"))).select("id.graph", "id.text", F.xxhash64("component.graph", "component.text").alias("family"))
    both = near.select("graph", F.col("a").alias("text"), F.col("b").alias("other"), "score").union(near.select("graph", "b", "a", "score"))
    beside = both.groupBy("graph", "text").agg(F.collect_list(F.struct("other", "score")).alias("beside"))
    named = cut(families.join(beside, ["graph", "text"]))
    # a text's near ones ride on its first row only
    first = own.groupBy("graph", "text").agg(F.min(F.struct("rank", "idx")).alias("first"))
    heads = named.join(first, ["graph", "text"]).select("graph", F.col("first.idx").alias("idx"), "text", "beside")
    rows_of = own.join(named.select("graph", "text", "family"), ["graph", "text"]).join(heads, ["graph", "idx", "text"], "left")
    ordered = rows_of.repartition("graph", "family").sortWithinPartitions("graph", "family", "rank", "idx")
    kind = dict(rows.dtypes)["graph"]
    joined = ordered.select("graph", "family", "idx", "rank", "text", "pos", "ent", "beside").mapInArrow(_in_order, f"graph {kind}, idx long, form string")
    alone = own.join(named.select("graph", "text"), ["graph", "text"], "left_anti").select("graph", "idx", F.col("text").alias("form"))
    formed = cut(joined.unionByName(alone))
    opened = formed.join(own.select("graph", "idx", "rank", "text"), ["graph", "idx"]).where("form = text").groupBy("graph", "form").agg(F.min(F.struct("rank", "idx")).alias("opened"))
    # ids are counted inside a graph, of which a row is a different text
    number = F.row_number().over(_by_opening())
    ids = opened.withColumn("vertex_id", number).select("graph", "form", "vertex_id")
    given = cut(formed.join(ids, ["graph", "form"]).select("graph", "idx", "vertex_id"))
    after = rows.where("follows").select("graph", "idx", F.col("primary").alias("at")).join(given.withColumnRenamed("idx", "at"), ["graph", "at"], "left")
    late = after.where("vertex_id is null").count()
    if late:
        raise ValueError(f"{late} vertices name a primary that is no primary of its own")
    return given.unionByName(after.select("graph", "idx", "vertex_id"))


def _by_opening():
    from pyspark.sql.window import Window

    return Window.partitionBy("graph").orderBy("opened")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The form that each row joins; rows come by graph and family, in order."""
    now: tuple | None = None
    opened: dict[str, list] = {}
    beside: dict[str, list] = {}
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6, 7)]
        for graph_id, family, idx, word, pos, ent, near in zip(batch.column(0).to_pylist(), *columns, strict=True):
            if (graph_id, family) != now:
                now, opened, beside = (graph_id, family), {}, {}
            if near is not None:
                beside[word] = [(n["other"], n["score"]) for n in near]
            if word in opened:
                opened[word][1] = pos
                out.append(word)
                continue
            known = [(-score, opened[other][0], other) for other, score in beside[word] if other in opened]
            best = min(known)[2] if known else None
            if best is not None and opened[best][1:] == [pos, ent]:
                out.append(best)
            else:
                opened[word] = [len(opened), pos, ent]
                out.append(word)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string())], names=["graph", "idx", "form"])
