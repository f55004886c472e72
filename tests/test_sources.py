import json

import pytest

from evigraph.plans import methods
from evigraph.sources import datasets, graphs
from evigraph.streaming import running


def write(path, *rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_loaders(spark, tmp_path):
    p = write(tmp_path / "m.jsonl", {"id": "1", "question": " Q ", "answer": "A", "answer_alias": ["A", "B"], "paragraphs": [{"title": "T", "paragraph_text": " x ", "is_supporting": True}, {"title": "U", "paragraph_text": "y"}], "question_decomposition": [{"id": "2", "question": "second"}, {"id": "1", "question": "first"}]})
    rows = datasets.load(spark, p, "musique")
    r = rows.first()
    assert (r._id, r.question, r.answerable, r.supporting_flags) == ("1", "Q", True, [True, False])
    assert datasets.musique(spark, p, supporting_only=True).first().supporting_flags == [True]
    q = datasets.query_instances(rows).first()
    assert (q.data, q.answers, q.query_decomposition) == (["x", "y"], ["A", "B"], ["first", "second"])
    p = write(tmp_path / "h.jsonl", {"id": "h", "question": "Q", "answer": "A", "context": {"title": ["T", "U"], "sentences": [["a", "b"], ["c"]]}})
    assert [(e["index"], e.title, e.text) for e in datasets.evidence_rows(datasets.load(spark, p, "hotpotqa")).orderBy("index").collect()] == [(0, "T", "a"), (1, "T", "b"), (2, "U", "c")]
    p = write(tmp_path / "a.jsonl", {"id": "a", "question": "Q", "choices": {"text": ["red", "blue"], "label": ["A", "B"]}, "answerKey": "B"})
    r = datasets.load(spark, p, "arc").first()
    assert (r.question, r.answer, r.answer_label) == ("Q\n\nOptions:\nA) red\nB) blue", "blue", "B")
    p = write(tmp_path / "c.jsonl", {"text": "body", "question": "Q", "answer": "Yes"}, {"text": "", "question": "Q", "answer": ""})
    assert [r.text_length for r in datasets.load(spark, p, "contract_qa").collect()] == [4]
    p = write(tmp_path / "s.jsonl", {"id": "s", "question": "Q", "choice_0": "x", "choice_1": "y", "answer": 1})
    assert datasets.load(spark, p, "scalr").first().answer == "B"
    p = write(tmp_path / "e.jsonl", {"uid": "u", "premise": ["p", "q"], "hypothesis": "h", "label": "entailment"}, {"premise": "whole", "hypothesis": "h"}, {"premise": "x", "hypothesis": ""})
    assert sorted((r.num_chunks, r.premise) for r in datasets.load(spark, p, "contract_nli").collect()) == [(1, "whole"), (2, "p\nq")]
    p = write(tmp_path / "d.jsonl", {"id": "d", "query": "Q", "answer": "A", "evidence_list": [{"title": "T", "fact": "f"}]})
    assert datasets.load(spark, p, "multihop").first().context[0].sentences == ["f"]
    with pytest.raises(ValueError, match="unknown task"):
        datasets.load(spark, p, "nothing")


def test_graph_store_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("d", "i", "query", 0, 1), ("d", "i", "data", 0, 2)], "dataset string, instance_id string, side string, doc_idx int, vertex_id int")
    graphs.save_graph({"vertices": df}, str(tmp_path / "g"))
    graphs.save_graph({"vertices": df}, str(tmp_path / "g"))
    wanted = spark.createDataFrame([("d", "i", "data", 0), ("d", "i", "data", 1)], "dataset string, instance_id string, side string, doc_idx int")
    assert sorted((r.doc_idx, r.vertex_id) for r in graphs.load_graph(spark, str(tmp_path / "g"), wanted, "vertices").collect()) == [(0, 2), (1, None)]
    items = spark.createDataFrame([("a",), ("b",)], "q string")
    assert [r.q for r in graphs.not_yet_done(items, items.where("q = 'a'"), "q").collect()] == ["b"]
    assert {r.q: r.status for r in graphs.with_status(items, items.where("q = 'a'"), "q").collect()} == {"a": "ready", "b": "skipped"}


def test_methods(spark):
    rows = spark.createDataFrame([(1, 0, "red car", "a red car"), (1, 1, "red car", "nothing"), (2, 0, "blue", "other")], "instance int, doc int, query string, text string")
    assert {(r.instance, r.doc) for r in methods.apply_method("cdit", rows).collect()} == {(1, 0), (2, 0)}
    assert {r.text for r in methods.apply_method("contradoc", rows).collect()} == {"a red car", "[CONTRADICTED] nothing", "[CONTRADICTED] other"}
    assert all(r.text.startswith("[SparseCL: ") for r in methods.apply_method("sparsecl", rows).collect())
    critical = spark.createDataFrame([(1, 5), (2, 6)], "instance int, u int")
    pairs = spark.createDataFrame([(1, 1, 5)], "instance int, doc int, u int")
    judged = methods.consistent_detection(rows, critical, pairs)
    assert {(r.instance, r.doc): r.verdict for r in judged.collect()} == {(1, 0): "consistent", (1, 1): "consistent", (2, 0): "contradiction"}
    with pytest.raises(ValueError, match="unknown method"):
        methods.apply_method("x", rows)


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = batch.withColumn("ts", batch.ts.cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = running.running_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("running").agg({"n": "sum"}).first()[0] == batch.count()
    query = running.dedup_events(stream, "user_id").writeStream.outputMode("append").format("memory").queryName("deduped").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("deduped").count() == batch.select("user_id").distinct().count()
