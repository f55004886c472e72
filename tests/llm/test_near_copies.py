import random

from evigraph.llm import simhash


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(500)]
    sets, rows, similar = {}, [], 0
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(150, 600))]
        changed = list(words)
        for _ in range((1, 2, 4, 8)[d % 4]):
            changed[rng.randrange(len(words))] = "changed"
        for w in (words, changed):
            sets[len(rows)] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = set(range(0, 120, 2))
    for d in range(0, 120, 2):
        alike = len(sets[d] & sets[d + 1]) >= 0.8 * len(sets[d] | sets[d + 1])
        similar += alike
        if not alike:
            wanted.add(d + 1)
    assert similar > 40 and wanted <= got and len(got - wanted) <= 0.02 * similar
    print("missed", len(got - wanted), "of", similar)


def test_near_dedup_cases(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "a"), (3, text + " ", "b"), (3, text + " ", "b"), (None, text, "c"), (9, None, "d"), (8, "", "e"), (None, "only null here is this one", "f"), (7, "quite another text stands in this row", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_dedup(docs).collect()), key=repr)
    assert got == sorted([rows[1], rows[5], rows[6], rows[7]], key=repr)
    assert simhash.near_dedup(docs.limit(0)).collect() == []
