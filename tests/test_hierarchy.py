import random

import pytest

from evigraph.operators import hierarchy


def up(parents, x):
    out, ahead = set(), [x]
    while ahead:
        at = ahead.pop()
        if at not in out:
            out.add(at)
            ahead += parents.get(at, ())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestry_equals_a_walk(spark, seed):
    """Random hierarchies with one to three parents a concept, tops above."""
    rng = random.Random(seed)
    arcs = [(i, p) for i in range(2, 70) for p in {rng.randrange(max(0, i - 20), i) for _ in range(rng.choice([1, 1, 2, 3]))}]
    arcs += [(90, 91), (91, 90), (5, 5)]
    parents = {}
    for c, p in arcs:
        parents.setdefault(c, []).append(p)
    frame = spark.createDataFrame([*arcs, (None, 1), (1, None)], "child int, parent int")
    labels = hierarchy.concept_labels(frame).cache()
    assert {r.concept for r in labels.collect()} == set(range(70))
    covers = hierarchy.covered_labels(frame, labels)
    pairs = [(rng.randrange(70), rng.randrange(70)) for _ in range(400)] + [(90, 3), (3, 90), (7, 7)]
    got = {(r.a, r.b): r.below for r in hierarchy.below(spark.createDataFrame(pairs, "a int, b int"), labels, covers).collect()}
    assert got == {(a, b): None if 90 in (a, b) else b in up(parents, a) for a, b in pairs}
    assert 20 < sum(v is True for v in got.values())
    tops = {0, 1, 2, 3}
    domains = {r.concept: set(r.domains) for r in hierarchy.concept_domains(frame, spark.createDataFrame([(t,) for t in tops], "concept int")).collect()}
    for a in range(70):
        for b in range(a, 70):
            shared = (up(parents, a) & up(parents, b)) - tops
            assert bool(domains.get(a, set()) & domains.get(b, set())) == bool(shared), (a, b)


def test_three_values(spark):
    arcs = spark.createDataFrame([("animal", "thing"), ("dog", "animal"), ("cat", "animal"), ("plan", "thing"), ("pet", "thing"), ("dog", "pet")], "child string, parent string")
    domains = hierarchy.concept_domains(arcs, spark.createDataFrame([("thing",)], "concept string"))
    assert {r.concept: r.domains for r in domains.collect()} == {"thing": [], "animal": ["animal"], "dog": ["animal", "pet"], "cat": ["animal"], "plan": ["plan"], "pet": ["pet"]}
    held = spark.createDataFrame([(1, "dog"), (2, "cat"), (3, "plan"), (4, "unknown"), (5, "pet"), (5, "plan"), (7, "dog"), (8, "plan"), (9, "thing")], "vertex int, concept string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (6, 1), (1, 5), (2, 5), (7, 8), (7, 1), (9, 1)], "a int, b int")
    abstract = spark.createDataFrame([(7, "being"), (8, "being"), (1, "act"), (2, None)], "vertex int, abstraction string")
    plain = {(r.a, r.b): r.match for r in hierarchy.domain_matches(pairs, held, domains).collect()}
    assert plain == {(1, 2): True, (1, 3): False, (1, 4): None, (6, 1): None, (1, 5): True, (2, 5): False, (7, 8): False, (7, 1): True, (9, 1): False}
    told = {(r.a, r.b): r.match for r in hierarchy.domain_matches(pairs, held, domains, abstract).collect()}
    assert told == plain | {(7, 8): True, (7, 1): False}
