from evigraph.llm import simhash


def test_near_stage_takes_pairs_of_fingerprints(spark, monkeypatch):
    # without a shared least hash the fingerprints alone find the near copy
    monkeypatch.setattr(simhash, "SMALLEST", 0)
    words = [f"w{i * i % 997}" for i in range(900)]
    changed = [*words[:-1], "changed"]
    other = [f"x{i * i % 991}" for i in range(900)]
    rows = [(i, " ".join(w)) for i, w in enumerate((words, changed, other))]
    got = {r.doc_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, 2}


def test_pairs_of_fingerprints(spark):
    named = spark.createDataFrame([(0, 9), (0, 4), (7, 5), (-1, 6)], "fp long, id long")
    assert {tuple(r) for r in simhash.print_pairs(named).collect()} == {(4, 9), (4, 5)}
