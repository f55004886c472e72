import itertools

import pytest
from pyspark.sql import functions as F

from evigraph.functions import vertex
from evigraph.operators import dependency, metrics


def test_roles_and_legal_pairs(spark):
    deps = ["nsubj", "agent", "dobj", "attr", "nmod", "appos", "ROOT", None]
    rows = [(a, b) for a, b in itertools.product(deps, deps)]
    df = spark.createDataFrame(rows, "a string, b string")
    groups = [{"nsubj", "agent"}, {"dobj", "attr"}, {"nmod", "appos"}, {"nmod", "dobj"}]
    got = {(r.a, r.b): r.c for r in df.select("a", "b", vertex.roles_compatible(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {(a, b): any({a, b} <= g for g in groups) for a, b in rows}
    cases = spark.createDataFrame([("entailment", None, True), ("neutral", True, True), ("neutral", False, False), ("neutral", None, False), ("contradiction", True, False), (None, True, False)], "label string, domain boolean, wanted boolean")
    fits = cases.select("wanted", vertex.legal(F.col("label"), F.col("domain"), F.lit("nsubj"), F.lit("agent")).alias("got"), vertex.legal(F.col("label"), F.col("domain"), F.lit("nsubj"), F.lit("dobj")).alias("apart")).collect()
    assert all(r.got == r.wanted and not r.apart for r in fits)


def test_pronouns_that_ask_without_a_type(spark):
    words = [(0, 0, "whose", "PRON", "WP$", "poss", 1, None), (0, 1, "idea", "NOUN", "NN", "ROOT", None, None), (0, 2, "whoever", "PRON", "WP", "nsubj", 1, None), (0, 3, "who", "PRON", "WP", "nsubj", 1, 1), (0, 4, "it", "PRON", "PRP", "dobj", 1, None), (0, 5, "what", "PRON", "WP", "det", 1, None), (0, 6, "which", "PRON", "WDT", "dobj", 1, None)]
    tokens = spark.createDataFrame([(*w, "NOT_ENTITY") for w in words], "graph int, idx int, text string, pos string, tag string, dep string, head int, antecedent int, ent string")
    got = {r.idx: (r.is_query, r.query_type) for r in dependency.mark_vertices(tokens, is_query=True).collect()}
    assert got == {0: (True, None), 1: (False, None), 2: (True, None), 3: (False, None), 4: (False, None), 5: (False, None), 6: (True, "WHICH")}
    plain = {r.idx: r.is_query for r in dependency.mark_vertices(tokens.drop("tag"), is_query=True).collect()}
    assert plain == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert not any(r.is_query for r in dependency.mark_vertices(tokens).collect())


def test_index_numbers():
    assert metrics.index_numbers(10, 4) == [0, 2, 5, 7] and metrics.index_numbers(3, 5, "top") == [0, 1, 2]
    assert metrics.index_numbers(10, 3, "top") == [0, 1, 2]
    drawn = metrics.index_numbers(50, 12, "normal", seed=4)
    assert len(set(drawn)) == 12 and max(drawn) < 50 and drawn == metrics.index_numbers(50, 12, "normal", seed=4)
    with pytest.raises(ValueError, match="mode"):
        metrics.index_numbers(9, 3, "odd")
