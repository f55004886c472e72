import random

from evigraph.operators import mentions, spans


def tokens_of(rng, n):
    """Tokens with gaps, as (idx, char_start, char_end)."""
    out, at = [], 0
    for i in range(n):
        at += rng.randrange(3)
        out.append((i, at, at + rng.randint(1, 90)))
        at = out[-1][2]
    return out


def test_mentions_equal_a_scan(spark):
    rng = random.Random(6)
    tokens, ranges, wanted = [], [], {}
    for g in range(15):
        own = tokens_of(rng, 40)
        tokens += [(g, *t) for t in own]
        for _ in range(60):
            s = rng.randrange(own[-1][2])
            e = s + rng.randint(1, 300)
            cluster, primary = rng.randrange(4), rng.random() < 0.3
            ranges += [(g, cluster, s, e, primary)] * rng.choice([1, 1, 2])
            start = [i for i, a, b in own if a <= s < b]
            end = [i + 1 for i, a, b in own if a < e <= b]
            if start and end:
                key = (g, cluster, start[0], end[0])
                wanted[key] = wanted.get(key, False) or primary
    got = mentions.updated_mentions(spark.createDataFrame(ranges, "graph int, cluster int, char_start int, char_end int, primary boolean"), spark.createDataFrame(tokens, "graph int, idx int, char_start int, char_end int"))
    rows = got.collect()
    assert {(r.graph, r.cluster, r.start, r.end): r.primary for r in rows} == wanted and len(rows) == len(wanted)
    assert 100 < len(wanted) < len(ranges)


def test_touched_tokens_equal_a_scan(spark):
    rng = random.Random(7)
    own = tokens_of(rng, 60)
    asked = [(0, k, s, s + rng.randint(1, 200)) for k, s in enumerate(rng.sample(range(own[-1][2]), 80))]
    got = spans.tokens_of_chars(spark.createDataFrame(asked, "graph int, span int, char_start int, char_end int"), spark.createDataFrame([(0, *t) for t in own], "graph int, idx int, char_start int, char_end int"))
    wanted = {}
    for _, k, s, e in asked:
        if held := [i for i, a, b in own if a < e and s < b]:
            wanted[k] = (min(held), max(held) + 1)
    assert {r.span: (r.start, r.end) for r in got.collect()} == wanted


def test_containment_equals_all_pairs(spark):
    """Nested, crossing, touching, equal and long spans."""
    rng = random.Random(8)
    own = {(g, s, s + rng.choice([1, 2, 5, 9, 40, 90])) for g in range(6) for s in rng.choices(range(120), k=40)}
    frame = spark.createDataFrame([*own, *list(own)[:5], (0, 3, 3)], "graph int, start int, end int")
    wanted = set()
    for g, s, e in own:
        others = [(a, b) for h, a, b in own if h == g and (a, b) != (s, e)]
        outer = min(((b - a, a, b) for a, b in others if a <= s and e <= b), default=(None, None, None))
        crossing = any(a < e and s < b and not (a <= s and e <= b) and not (s <= a and b <= e) for a, b in others)
        wanted.add((g, s, e, outer[1], outer[2], crossing))
    assert {tuple(r) for r in mentions.containment(frame).collect()} == wanted
    assert {tuple(r)[:3] for r in mentions.settled_spans(frame).collect()} == {w[:3] for w in wanted if w[3] is None}
    assert {w[5] for w in wanted} == {True, False} and any(w[3] is not None for w in wanted)


def test_clusters_that_share_a_root(spark):
    rows = [(0, 1, 0, 4, 2), (0, 2, 1, 3, 2), (0, 2, 7, 9, 8), (0, 3, 7, 9, 8), (0, 4, 20, 22, 21), (0, 4, 30, 31, 30), (0, 5, 29, 31, 30), (1, 1, 0, 4, 2)]
    got = mentions.dropped_clusters(spark.createDataFrame(rows, "graph int, cluster int, start int, end int, root int"))
    # 1 has the longer span on 2, 3 the larger number on 8, 5 the longer span on 30
    assert {tuple(r) for r in got.collect()} == {(0, 1), (0, 3), (0, 5)}
