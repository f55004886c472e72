from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.plans import provider
from evigraph.sources import datasets, graphs


def test_complete_asks_each_prompt_once_and_keeps_errors(spark):
    def generate(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "id int, prompt string")
    got = {r.id: (r.answer, r.answer_error) for r in provider.complete(rows, "prompt", "answer", generate, batch=1).collect()}
    assert got == {1: ("A", None), 2: ("A", None), 3: (None, "ValueError: no"), 4: (None, None)}


def test_retrieved_prompts(spark):
    queries = spark.createDataFrame([(0, [1.0, 0.0], "what?")], "vec_id int, embedding array<float>, question string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0])], "vec_id int, embedding array<float>")
    passages = spark.createDataFrame([(1, "T", "one"), (2, "", "two"), (3, None, "three")], "id int, title string, text string")
    row = provider.retrieve_prompts(queries, vectors, passages, 2, "hotpotqa").first()
    assert row.context == "T one\ntwo" and "Question: what?" in row.prompt


def test_nfd(spark):
    assert spark.range(1).select(text.decomposed(F.lit("é")).alias("x")).first().x == "e\u0301"


def test_logs_and_all_choices(spark, tmp_path):
    log = str(tmp_path / "runs")
    graphs.append_run(spark, log, {"name": "a", "seconds": "1"})
    graphs.append_run(spark, log, {"name": "b", "seconds": "2"})
    assert sorted(r.name for r in graphs.load_runs(spark, log).collect()) == ["a", "b"]
    graphs.save_prompts(spark.createDataFrame([("q", "p")], "a string, b string"), str(tmp_path / "prompts"), "a", "b")
    assert spark.read.json(str(tmp_path / "prompts")).first().asDict() == {"prompt": "p", "question": "q"}
    path = tmp_path / "scalr.jsonl"
    path.write_text('{"id": "1", "question": "q", "answer": 11, "text": "", ' + ", ".join(f'"choice_{i}": "c{i}"' for i in range(12)) + "}\n")
    row = datasets.scalr(spark, str(path)).first()
    assert "L) c11" in row.question and row.answer == "L"
