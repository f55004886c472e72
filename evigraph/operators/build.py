"""Text to hypergraph by rules, chunk splitting, and record parsing.

Parsers with a language model are not available here; ``rule_graph`` is a
deterministic lexical builder with the same tables as result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Question words and the kind of answer that they ask for.
QUESTION_WORDS = {"who": "PERSON", "whose": "BELONGS", "what": "WHAT", "which": "WHICH", "when": "TIME", "where": "LOCATION", "why": "REASON", "how": "ATTRIBUTE"}


def query_type(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for w, kind in QUESTION_WORDS.items():
        out = F.when(F.lower(word) == w, kind).otherwise(out)
    return out


def rule_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of ``docs(graph, text)``: a sentence is an edge, its
    distinct words with four letters or more, numbers and question words are
    vertices. Vertices: graph, vertex_id (by first place), text, type, poses,
    query_type; edges: graph, edge, pos (0 for the first word), vertex_id."""
    sentences = docs.select("graph", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")).alias("edge", "sentence"))
    words = sentences.select("graph", "edge", F.posexplode(text.tokens(F.col("sentence"))).alias("place", "word"))
    asked = query_type(F.col("word"))
    used = words.where((F.length("word") >= 4) | F.col("word").rlike(r"^\d+$") | asked.isNotNull())
    first = F.min(F.struct("edge", "place"))
    kinds = used.groupBy("graph", F.lower("word").alias("text")).agg(first.alias("at"), F.max(F.col("word").rlike(r"^\p{Lu}")).alias("proper"))
    named = kinds.select("graph", F.xxhash64("graph", "text").alias("vertex_id"), "text", "at", F.when(F.col("text").rlike(r"^\d+$"), "NUMBER").alias("type"), F.when(F.col("text").rlike(r"^\d+$"), F.array(F.lit("NUM"))).when(F.col("proper"), F.array(F.lit("PROPN"))).otherwise(F.array(F.lit("NOUN"))).alias("poses"), query_type(F.col("text")).alias("query_type"))
    # lists of a sentence's words are shuffled once, where places of words were twice
    listed = used.groupBy("graph", "edge").agg(F.sort_array(F.collect_list(F.struct("place", F.lower("word").alias("text")))).alias("w"))
    edges = listed.select("graph", "edge", F.posexplode(F.array_distinct(F.transform("w", lambda x: x["text"]))).alias("pos", "w")).select("graph", "edge", "pos", F.xxhash64("graph", "w").alias("vertex_id"))
    return named.drop("at"), edges


def split_chunks(docs: DataFrame, body: str, chunks: int, out: str = "chunks") -> DataFrame:
    """Adds ``out``: the text cut in two or three at the sentence ends nearest
    to equal parts, the earlier of equals; joined again they give the text. A
    text without inner ends stays whole. The text is measured once, not for
    each sentence."""
    sizes = F.transform(F.split(F.col(body), r"(?<=[.!?])(?=\s)"), F.length)
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(body).alias("body"), sizes.alias("sizes"))

    def nearest(part: int, after: str | None):
        """One pass over the sentences: where each ends, and the best so far."""
        start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"), F.lit(None).cast("double").alias("gap"))

        def step(n: Column, state: Column, size: Column) -> Column:
            at = state["at"] + size
            gap = F.abs(at - n * part / chunks)
            better = (at < n) & (at > (F.col(after) if after else F.lit(0))) & (state["gap"].isNull() | (gap < state["gap"]))
            return F.struct(at.alias("at"), F.when(better, at).otherwise(state["best"]).alias("best"), F.when(better, gap).otherwise(state["gap"]).alias("gap"))

        # an outer lambda holds the length: a column would be put in for each sentence
        return F.get(F.transform(F.array(F.length("body")), lambda n: F.aggregate("sizes", start, lambda s, x: step(n, s, x), lambda s: s["best"])), F.lit(0))

    held = held.withColumn("one", nearest(1, None))
    held = held.withColumn("two", nearest(2, "one") if chunks >= 3 else F.lit(None).cast("int"))
    cut = lambda a, b: F.substring("body", a + 1, b - a)
    n, one, two = F.length("body"), F.col("one"), F.col("two")
    parts = F.array(cut(F.lit(0), F.coalesce(one, n)), F.when(one.isNotNull(), cut(one, F.coalesce(two, n))), F.when(two.isNotNull(), cut(two, n)))
    return held.select("row.*", F.array_compact(parts).alias(out))


def parse_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of record text ``("entity", name, type, desc);`` and so
    on, up to ``<END_OUTPUT>``; an attribute links its entity to ``key=value``."""
    body = F.regexp_replace("text", r"(?s)<END_OUTPUT>.*$", "")
    records = lines.select(F.explode(F.regexp_extract_all(body, F.lit(r'(?s)\((".*?")\);'), F.lit(1))).alias("r"))
    fields = records.select(F.transform(F.split(F.expr("substring(r, 2, length(r) - 2)"), r'"\s*,\s*"'), lambda x: F.trim(x)).alias("f"))
    kind = F.get("f", 0)
    at = lambda i: F.get(F.col("f"), i)
    entity = fields.where((kind == "entity") & (F.size("f") == 4)).select(at(1).alias("name"), at(2).alias("type"), at(3).alias("desc"))
    relation = fields.where((kind == "relationship") & (F.size("f") == 5)).select(at(1).alias("src"), at(2).alias("dst"), at(3).alias("type"), at(4).alias("desc"))
    pair = F.concat(at(1), F.lit("="), at(2))
    attribute = fields.where((kind == "attribute") & (F.size("f") == 5))
    nodes = entity.unionByName(attribute.select(pair.alias("name"), F.lit("attribute").alias("type"), at(3).alias("desc"))).distinct()
    edges = relation.unionByName(attribute.select(at(4).alias("src"), pair.alias("dst"), F.lit("attribute").alias("type"), at(3).alias("desc"))).distinct()
    return nodes, edges


def bigram_scores(tokens: DataFrame) -> DataFrame:
    """Log-likelihood ratio of each bigram of (doc, place, token)."""
    nxt = tokens.select("doc", (F.col("place") - 1).alias("place"), F.col("token").alias("b"))
    pairs = tokens.withColumnRenamed("token", "a").join(nxt, ["doc", "place"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("ab"))
    left = pairs.groupBy("a").agg(F.sum("ab").alias("na"))
    right = pairs.groupBy("b").agg(F.sum("ab").alias("nb"))
    total = pairs.agg(F.sum("ab").alias("n"))
    joined = pairs.join(left, "a").join(right, "b").join(F.broadcast(total))
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    ab, na, nb, n = (F.col(c).cast("double") for c in ("ab", "na", "nb", "n"))
    cells = xlogx(ab) + xlogx(na - ab) + xlogx(nb - ab) + xlogx(n - na - nb + ab)
    return joined.select("a", "b", (2 * (cells - xlogx(na) - xlogx(n - na) - xlogx(nb) - xlogx(n - nb) + xlogx(n))).alias("llr"))
