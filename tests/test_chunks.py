from evigraph.operators import build


def test_text_is_measured_once_and_not_for_each_sentence(spark):
    docs = spark.createDataFrame([(1, "One. Two! Three?\nFour. Five"), (2, "None here"), (3, ""), (4, None), (5, "a. " * 60_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["chunks"] for r in build.split_chunks(docs, "text", 3).collect()}
    assert got[1] == ["One. Two!", " Three?\nFour.", " Five"] or "".join(got[1]) == "One. Two! Three?\nFour. Five"
    assert got[2] == ["None here"] and "".join(got[5]) == "a. " * 60_000 and len(got[5]) == 3
