from evigraph.operators import fusion
from evigraph.plans.hyper import Side, fuse

KINDS = {"VERB": ["NOT_ENTITY"], "PROPN": None}


def side(spark, rows, edges, sources=False):
    """rows: (id, text, type, pos[, source]); an edge is a list of ids."""
    v = [(0, r[0], r[1], r[2], [r[3]], False, None, [r[2] or "NOT_ENTITY"], *r[4:]) for r in rows]
    m = [(0, e, p, x) for e, ids in enumerate(edges) for p, x in enumerate(ids)]
    schema = "instance int, vertex_id long, text string, type string, poses array<string>, virtual boolean, query_type string, ents array<string>" + (", source int" if sources else "")
    return Side(spark.createDataFrame(v, schema), spark.createDataFrame(m, "instance int, edge long, pos int, vertex_id long"))


def test_two_sources_end_to_end(spark):
    """Ann Bell stands in both sources; the query is traced back to each."""
    query = side(spark, [(1, "wrote", None, "VERB"), (2, "Ann Bell", "PERSON", "PROPN"), (3, "Red River", "WORK_OF_ART", "PROPN"), (4, "Oslo", "GPE", "PROPN")], [[1, 2, 3], [4]])
    evidence = side(
        spark,
        [(1, "wrote", None, "VERB", 0), (2, "Ann Bell", "PERSON", "PROPN", 0), (3, "Red River", "WORK_OF_ART", "PROPN", 0), (14, "sold", None, "VERB", 1), (15, "Ann Bell", "PERSON", "PROPN", 1), (16, "Blue Hill", "WORK_OF_ART", "PROPN", 1)],
        [[1, 2, 3], [14, 15, 16]],
        sources=True,
    )
    texts = spark.createDataFrame([(0, 0, "Ann Bell wrote Red River."), (0, 1, "Ann Bell sold Blue Hill." + " More of it." * 9)], "instance int, source int, text string")
    out = fuse(query, evidence, texts)
    assert {(r.v, r.vertex_id, r.source) for r in out.lineage.collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (14, 14, 1), (2, 15, 1), (16, 16, 1)}
    assert {(r.u, r.v) for r in out.relation.collect()} == {(2, 2), (3, 3)}
    trace = {(r.query_text, r.matched, r.evidence, r.answer, round(r.confidence, 2)) for r in out.trace.collect()}
    assert trace == {("Ann Bell", True, 0, "Ann Bell", 1.0), ("Ann Bell", True, 1, "Ann Bell", 1.0), ("Red River", True, 0, "Red River", 1.0), ("Oslo", False, None, None, 0.0)}
    assert fusion.full_support(out.trace.where("query_text <> 'Oslo'")).collect() == [(0, 0)]
    assert fusion.full_support(out.trace).collect() == []
    lines = out.report.first().context.split("\n")
    assert lines == [
        "covered 2 of 3",
        "evidence",
        "[0] high, mean 1.00, matches 2: Ann Bell wrote Red River.",
        "  - Ann Bell: Ann Bell wrote Red River.",
        "  - Red River: Ann Bell wrote Red River.",
        "[1] high, mean 1.00, matches 1: Ann Bell sold Blue Hill. More of it. More of it. More of it. More of it. More of...",
        "  - Ann Bell: Ann Bell sold Blue Hill. More of it. More of it. More of i",
        "unsupported",
        "  - Oslo",
    ]


def test_conflicts_and_empty_tables(spark):
    trace = spark.createDataFrame([(1, 1, "who", True, 0, "Ann", "Ann did", 0.5), (1, 1, "who", True, 1, "Bob", "Bob did", 0.7), (1, 2, "where", True, 1, "Rome", "Rome", 0.2)], "instance int, u int, query_text string, matched boolean, evidence int, answer string, supporting string, confidence double")
    texts = spark.createDataFrame([(1, 0, "Ann did"), (1, 1, "Bob did in Rome"), (1, 2, "Nothing")], "instance int, source int, text string")
    text = fusion.trace_report(trace, texts).first().context
    assert text.split("conflicting\n")[1] == "  - who: Ann / Bob"
    assert text.startswith("covered 2 of 2\nevidence\n[0] medium") and "[2] low, mean 0.00, matches 0: Nothing" in text
    assert fusion.trace_report(trace.limit(0), texts).collect() == []
    assert [tuple(r) for r in fusion.full_support(trace).collect()] == [(1, 1)]
