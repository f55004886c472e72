import random

import pytest

from evigraph.operators import fuzzy


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def ratio(a, b):
    return 100 * (1 - edits(a, b) / max(len(a), len(b)))


def near_forms(rng, many):
    """Chains of near forms, of nine to sixty letters."""
    out = []
    while len(out) < many:
        word = "".join(rng.choice("abcde ") for _ in range(rng.randint(8, 60)))
        for _ in range(rng.randint(1, 5)):
            out.append(word)
            for _ in range(rng.randint(1, max(1, len(word) // 12))):
                i = rng.randrange(len(word))
                word = rng.choice([word[:i] + rng.choice("abc") + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + rng.choice("abc") + word[i:]])
    return out[:many]


def test_near_texts_equal_all_pairs(spark):
    rng = random.Random(5)
    forms = [(g, t) for g in range(2) for t in sorted(set(near_forms(rng, 120)))]
    forms += [(0, "short"), (0, "shord"), (0, ""), (1, "x" * 3000), (1, "x" * 2900 + "y" * 80)]
    got = {(r.graph, r.a, r.b, round(r.score, 6)) for r in fuzzy.near_texts(spark.createDataFrame(forms + forms[:3], "graph int, text string")).collect()}
    wanted = set()
    for g in range(2):
        own = sorted({t for x, t in forms if x == g and len(t) < 1000})
        wanted |= {(g, a, b, round(ratio(a, b), 6)) for i, a in enumerate(own) for b in own[i + 1 :] if ratio(a, b) >= 90 - 1e-9}
    long = [r for r in got if len(r[1]) > 1000]
    assert len(long) == 1
    assert got - set(long) == wanted and len(wanted) > 60


def one_pass(rows):
    """The ids of one graph, vertex by vertex."""
    known = {i for i, *_ in rows}
    order = sorted(rows, key=lambda r: (0 if r[4] is None else 1 if r[4] == r[0] else 2, r[0]))
    choices, ids = [], {}
    for idx, word, pos, ent, primary in order:
        if primary is not None and primary != idx and primary in known:
            continue
        word = word.lower()
        scored = [(ratio(word, c[0]) if word or c[0] else 100.0, -k) for k, c in enumerate(choices)]
        best = max(scored, default=(0, 0))
        c = choices[-best[1]] if scored else None
        if c and (c[0] == word or best[0] >= 90 - 1e-9 and (c[1], c[2]) == (pos, ent)):
            c[1] = pos
            ids[idx] = 1 - best[1]
        else:
            choices.append([word, pos, ent])
            ids[idx] = len(choices)
    for idx, _, _, _, primary in order:
        if idx not in ids:
            ids[idx] = ids[primary]
    return ids


def test_ids_equal_one_pass(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        words = near_forms(rng, 14)
        for i in range(40):
            word = rng.choice(words)
            rows.append((g, i, word.upper() if rng.random() < 0.2 else word, rng.choice(["NOUN", "NOUN", "PROPN"]), rng.choice(["X", "X", "Y"]), rng.choice([None, None, None, 3, 7, 99]) if i not in (3, 7) else i))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "graph int, idx long, text string, pos string, ent string, primary long")
    got = {(r.graph, r.idx): r.vertex_id for r in fuzzy.fuzzy_vertex_ids(frame).collect()}
    wanted = {(g, i): n for g in range(12) for i, n in one_pass([r[1:] for r in rows if r[0] == g]).items()}
    assert got == wanted
    assert fuzzy.fuzzy_vertex_ids(frame.limit(0)).collect() == []


def test_primary_without_an_id_is_refused(spark):
    frame = spark.createDataFrame([(0, 1, "a", "NOUN", "X", 2), (0, 2, "b", "NOUN", "X", 1)], "graph int, idx long, text string, pos string, ent string, primary long")
    with pytest.raises(ValueError, match="primary"):
        fuzzy.fuzzy_vertex_ids(frame)
