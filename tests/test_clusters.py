import itertools
import random

from pyspark.sql import functions as F

from evigraph.functions import render
from evigraph.operators import clusters, dependency, match, retrieval, simulation
from evigraph.plans.hyper import Side, hypergraph_simulation
from evigraph.plans.methods import apply_method


def test_first_come_equals_one_pass(spark):
    rng = random.Random(3)
    arcs = [(g, e, rng.randrange(12)) for g in range(30) for e in rng.sample(range(12), 8)]
    taken = [(g, rng.randrange(12)) for g in range(0, 30, 3)]
    wanted = set()
    for g in range(30):
        used = {e for x, e in taken if x == g}
        for _, e, head in sorted(a for a in arcs if a[0] == g):
            if head not in used:
                wanted.add((g, e, head))
                used |= {e, head}
    got = clusters.first_come(spark.createDataFrame(arcs, "graph int, edge int, head int"), spark.createDataFrame(taken, "graph int, edge int"))
    assert {tuple(r) for r in got.select("graph", "edge", "head").collect()} == wanted
    assert clusters.first_come(spark.createDataFrame([], "graph int, edge int, head int")).collect() == []


def test_greedy_matching_equals_one_pass(spark):
    rng = random.Random(4)
    rows = [(p, u, v, float(rng.randrange(6))) for p in range(20) for u, v in rng.sample(list(itertools.product(range(6), range(6))), 15)]
    wanted = set()
    for p in range(20):
        left, right = set(), set()
        for _, u, v, score in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[3], r[1], r[2])):
            if u not in left and v not in right:
                wanted.add((p, u, v, score))
                left.add(u)
                right.add(v)
    got = match.greedy_one_to_one(spark.createDataFrame(rows, "pair int, u int, v int, score double"))
    assert {tuple(r) for r in got.collect()} == wanted


def edge_rule(allowed, edges, matched, strict):
    """One removal after another, straight from the rule's words."""
    r = set(allowed)
    while True:
        def supported(u, v, e):
            for sc in {m[1] for m in matched if m[0] == e and m[2:] == (u, v)}:
                rows = [m[2:] for m in matched if m[0] == e and m[1] == sc and (e, m[2]) in edges]
                if all(any(x == y and (y, w) in r for y, w in rows) for x in {x for x, _ in rows}):
                    return True
            return False

        gone = set()
        for u, v in r:
            of = [e for e, x in edges if x == u]
            ok = [supported(u, v, e) for e in of]
            if not (all(ok) and ok if strict else any(ok)):
                gone.add((u, v))
        if not gone:
            return r
        r -= gone


def test_edge_simulation_equals_rule(spark):
    rng = random.Random(5)
    for strict in (False, True):
        edges = {(e, u) for e in range(5) for u in rng.sample(range(6), 3)}
        allowed = {(u, v) for u in range(6) for v in range(8) if rng.random() < 0.6}
        matched = {(e, sc, u, v) for e, u in edges for sc in range(3) for v in range(8) if rng.random() < 0.15}
        frame = lambda rows, names: spark.createDataFrame([(0, *r) for r in sorted(rows)], "instance int, " + ", ".join(f"{n} int" for n in names))
        got = simulation.edge_simulation(frame(allowed, ("u", "v")), frame(edges, ("edge", "u")), frame(matched, ("edge", "sc", "u", "v")), strict)
        assert {(r.u, r.v) for r in got.collect()} == edge_rule(allowed, edges, matched, strict)


def test_long_chains_of_removals_end(spark):
    n = 130
    arcs = [(0, i, i + 1) for i in range(n)]
    allowed = [(0, 0, i) for i in range(n + 1)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    # a query that needs an endless path: the chain has none, whatever its length
    got = simulation.bounded_simulation(frame(allowed[-12:], "instance int, u int, v int"), frame([(0, 0, 0)], "instance int, src int, dst int"), frame(arcs[-12:], "instance int, src int, dst int"), bound=1)
    assert got.collect() == []


def side(spark, words, edges, asked=None):
    """words: id, text, type, pos; edges: lists of ids, the root first."""
    v = [(0, i, t, k, [p], False, (asked or {}).get(i)) for i, t, k, p in words]
    m = [(0, e, pos, i) for e, ids in enumerate(edges) for pos, i in enumerate(ids)]
    return Side(spark.createDataFrame(v, "instance int, vertex_id long, text string, type string, poses array<string>, virtual boolean, query_type string"), spark.createDataFrame(m, "instance int, edge long, pos int, vertex_id long"))


def test_hypergraph_simulation_of_a_small_graph(spark):
    query = side(spark, [(1, "wrote", None, "VERB"), (2, "Ann Bell", "PERSON", "PROPN"), (3, "Red River", "WORK_OF_ART", "PROPN")], [[1, 2, 3]])
    data = side(
        spark,
        [(1, "wrote", None, "VERB"), (2, "Ann Bell", "PERSON", "PROPN"), (3, "Red River", "WORK_OF_ART", "PROPN"), (4, "sold", None, "VERB"), (5, "Carl Moe", "PERSON", "PROPN"), (6, "Blue Hill", "WORK_OF_ART", "PROPN")],
        [[1, 2, 3], [4, 5, 6]],
    )
    out = hypergraph_simulation(query, data)
    relation = {(r.u, r.v) for r in out.relation.collect()}
    # the right person and book support each other; the other edge's texts differ
    assert relation == {(2, 2), (3, 3)}
    assert {(r.u, r.v) for r in out.d_match.collect()} == {(2, 2), (3, 3)}
    assert out.delta.where("score < 0.75").count() == 0 and out.delta.count() >= 1
    # nothing allowed gives nothing
    other = side(spark, [(9, "2001", "TEMPORAL", "NUM")], [[9]])
    assert hypergraph_simulation(query, other).relation.collect() == []


def test_methods_on_small_instances(spark):
    rows = spark.createDataFrame([(1, 1, "Who wrote Red River?", "Ann Bell wrote Red River."), (1, 2, "Who wrote Red River?", "Quite another thing happened."), (2, 1, "Nothing fits here", "Entirely different words stand")], "instance int, doc int, query string, text string")
    kept = {(r.instance, r.doc) for r in apply_method("bsim", rows).collect()}
    assert (2, 1) in kept and kept <= {(1, 1), (1, 2), (2, 1)}
    marked = apply_method("hypergraph_simulation", rows)
    assert marked.columns == rows.columns and all(r.text.startswith(("[consistent] ", "[contradiction] ")) for r in marked.collect())


def test_question_words(spark):
    words = [(0, 0, "Who", "PRON", "nsubj", 1), (0, 1, "wrote", "VERB", "ROOT", None), (0, 2, "it", "PRON", "dobj", 1), (0, 3, "when", "ADV", "advmod", 1), (0, 4, "how many", "ADJ", "amod", 5), (0, 5, "books", "NOUN", "dobj", 1), (0, 6, "whose", "DET", "poss", 5), (0, 7, "was", "AUX", "aux", 1), (0, 8, ".", "PUNCT", "punct", 1)]
    tokens = spark.createDataFrame([(*w, "NOT_ENTITY") for w in words], "graph int, idx int, text string, pos string, dep string, head int, ent string").withColumn("antecedent", F.lit(None).cast("int"))
    got = {r.idx: (r.is_vertex, r.query_type) for r in dependency.mark_vertices(tokens, is_query=True).collect()}
    assert got == {0: (True, "PERSON"), 1: (True, None), 2: (True, None), 3: (True, "TIME"), 4: (True, "NUMBER"), 5: (True, None), 6: (True, "BELONGS"), 7: (False, None), 8: (False, None)}


def test_pronouns_share_the_id_of_whom_they_stand_for(spark):
    words = [(0, 0, "Ann", "PROPN", None), (0, 1, "she", "PRON", 0), (0, 2, "ann", "PROPN", None), (0, 3, "ran", "VERB", None), (0, 4, "ran", "VERB", None)]
    tokens = spark.createDataFrame(words, "graph int, idx int, text string, pos string, antecedent int").withColumn("is_vertex", F.lit(True))
    got = {r.idx: r.vertex_id for r in dependency.vertex_ids(tokens).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}


def test_training_data_helpers(spark):
    row = spark.range(1).select(F.array(*map(F.lit, range(100, 140))).alias("t"))
    out = row.select(
        retrieval.random_crop(F.col("t"), F.lit(7), 0.2, 0.5).alias("crop"),
        retrieval.replace_words(F.col("t"), 0.5, 1, 9).alias("replaced"),
        retrieval.shuffle_words(F.col("t"), 0.5).alias("shuffled"),
        retrieval.masked_mean(F.lit([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]), F.lit([True, True, False])).alias("mean"),
        retrieval.last_token(F.lit([[1.0], [2.0], [3.0]]), F.lit([True, True, False])).alias("last"),
    ).first()
    assert 8 <= len(out.crop) <= 20 and out.crop == list(range(out.crop[0], out.crop[0] + len(out.crop)))
    changed = [x for x in out.replaced if x < 10]
    assert 5 < len(changed) < 35 and all(x == y or x in range(1, 10) for x, y in zip(out.replaced, range(100, 140)))
    assert sorted(out.shuffled) == list(range(100, 140)) and out.shuffled != list(range(100, 140))
    assert out["mean"] == [2.0, 3.0] and out["last"] == [2.0]
    texts = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = spark.createDataFrame([(i, "q", texts("p", 3), texts("n", 9), texts("h", 4)) for i in range(200)], "id int, question string, positive array<string>, negative array<string>, hard array<string>")
    examples = retrieval.training_examples(rows, 5, 0.4, first_hard=1).collect()
    assert all(len(e.negatives) == 5 == len(set(e.negatives)) and "h0" not in e.negatives for e in examples)
    hard = sum(n.startswith("h") for e in examples for n in e.negatives)
    assert 300 < hard < 500 and {e.gold for e in examples} == {"p0", "p1", "p2"}
    named = retrieval.pick_datasets(rows, spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.3)], "name string, weight double"), "id").groupBy("dataset").count().collect()
    shares = {r.dataset: r["count"] for r in named}
    assert 20 <= shares["a"] <= 60 and 75 <= shares["b"] <= 125 and sum(shares.values()) == 200


def test_texts_of_answers(spark):
    one = spark.range(1)
    got = one.select(render.cited(F.array(F.lit("One here.[Relevant]"), F.lit(""), F.lit("Two."))).alias("c"), render.join_mentions(F.lit("he saw  it"), F.array(F.lit("he"), F.lit("it"), F.lit("")), F.array(F.lit("Ann"), F.lit("the bird"), F.lit("x"))).alias("j")).first()
    assert got.c == "One here [0]. Two [2]." and got.j == "Ann saw the bird"
