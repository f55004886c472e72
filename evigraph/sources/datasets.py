"""Question-answering and entailment datasets as DataFrames of one shape.

Every loader reads JSON or JSON lines with an explicit schema and returns _id,
question, answer, context (array of title and sentences) and what its task
adds. Missing fields become "" or an empty array. ``load`` is the registry.
"""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PASSAGES = "array<struct<title:string,sentences:array<string>>>"


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _first(*names: str) -> Column:
    return F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names], F.lit(""))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("pathGlobFilter", "*.json*")
    return reader.option("multiLine", True).json(path) if str(path).endswith(".json") else reader.json(path)


def _one(title: Column, body: Column) -> Column:
    return F.array(F.struct(title.alias("title"), F.array(body).alias("sentences"))).cast(_PASSAGES)


def hotpotqa(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, "id string, _id string, question string, answer string, type string, level string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>")
    pairs = F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))
    return raw.select(_first("id", "_id").alias("_id"), _text("question").alias("question"), _text("answer").alias("answer"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce(pairs, F.array()).cast(_PASSAGES).alias("context"), "supporting_facts")


def musique(spark: SparkSession, path: str, supporting_only: bool = False) -> DataFrame:
    raw = _read(spark, path, "id string, question string, answer string, answer_alias array<string>, answerable boolean, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<struct<id:string,question:string,answer:string,paragraph_support_idx:int>>")
    flag = lambda p: F.coalesce(p["is_supporting"], F.lit(False))
    used = F.filter(F.coalesce("paragraphs", F.array().cast("array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>")), lambda p: flag(p) | F.lit(not supporting_only))
    context = F.transform(used, lambda p: F.struct(F.trim(F.coalesce(p["title"], F.lit(""))).alias("title"), F.array(F.trim(F.coalesce(p["paragraph_text"], F.lit("")))).alias("sentences")))
    return raw.select(_text("id").alias("_id"), _text("question").alias("question"), _text("answer").alias("answer"), F.coalesce("answer_alias", F.array().cast("array<string>")).alias("answer_alias"), F.coalesce("answerable", F.lit(True)).alias("answerable"), "question_decomposition", context.cast(_PASSAGES).alias("context"), F.transform(used, flag).alias("supporting_flags"))


def multihop(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, "id string, query string, answer string, question_type string, evidence_list array<struct<title:string,text:string,fact:string,published_at:string,source:string>>")
    context = F.transform("evidence_list", lambda e: F.struct(F.coalesce(e["title"], F.lit("")).alias("title"), F.array(F.coalesce(F.when(F.trim(e["text"]) != "", e["text"]), e["fact"], F.lit(""))).alias("sentences")))
    rows = raw.select(_text("id").alias("_id"), _text("query").alias("question"), _text("answer").alias("answer"), F.coalesce("question_type", F.lit("")).alias("question_type"), F.coalesce(context, F.array()).cast(_PASSAGES).alias("context"))
    return rows.withColumn("supporting_flags", F.transform("context", lambda _: F.lit(True)))


def arc(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, "id string, question string, choices struct<text:array<string>,label:array<string>>, answerKey string, paragraphs array<struct<title:string,text:string>>")
    labels, options = F.col("choices.label"), F.col("choices.text")
    shown = F.array_join(F.zip_with(labels, options, lambda a, b: F.concat(a, F.lit(") "), b)), "\n")
    key = F.regexp_extract("answerKey", r"([A-Za-z0-9]+)", 1)
    place = F.array_position(labels, key).cast("int")
    context = F.transform("paragraphs", lambda p: F.struct(F.coalesce(p["title"], F.lit("")).alias("title"), F.array(F.coalesce(p["text"], F.lit(""))).alias("sentences")))
    return raw.select(_text("id").alias("_id"), F.concat(_text("question"), F.lit("\n\nOptions:\n"), shown).alias("question"), F.coalesce(F.get(options, place - 1), F.lit("")).alias("answer"), key.alias("answer_label"), options.alias("options"), labels.alias("option_labels"), F.coalesce(context, F.array()).cast(_PASSAGES).alias("context"))


def text_questions(context_type: str, task_type: str, needs_text: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """A loader of {id, text or contract, question, answer} rows; those without
    a question, or a text where one is needed, go."""

    def load_rows(spark: SparkSession, path: str) -> DataFrame:
        raw = _read(spark, path, "id string, text string, contract string, statute string, description string, question string, hypothesis string, answer string")
        body = _first("text", "contract")
        rows = raw.select(_text("id").alias("_id"), _first("question", "hypothesis", "description").alias("question"), _text("answer").alias("answer"), body.alias("text"))
        rows = rows.where("question <> ''").where(F.lit(not needs_text) | (F.col("text") != ""))
        context = F.when(F.col("text") != "", _one(F.lit(context_type), F.col("text"))).otherwise(F.array().cast(_PASSAGES))
        named = rows.withColumn("_id", F.when(F.col("_id") == "", F.concat(F.lit(context_type + "_"), F.substring(F.md5(F.concat("question", "text")), 1, 8))).otherwise(F.col("_id")))
        return named.select("_id", "question", "answer", context.alias("context"), F.lit(context_type).alias("context_type"), F.lit(task_type).alias("task_type"), F.length("text").alias("text_length"))

    return load_rows


def sara(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, "id string, statute string, description string, question string, hypothesis string, answer string")
    body = F.concat_ws("\n\n", F.col("statute"), F.col("description"))
    low = F.lower(F.trim("answer"))
    label = F.when(low.contains("contradict"), "Contradicts").when(low.contains("entail"), "Entails").otherwise("Neutral")
    return raw.select(_text("id").alias("_id"), _first("question", "hypothesis").alias("question"), label.alias("answer"), _one(F.lit("statute"), body).alias("context"), F.lit("legal_entailment").alias("context_type"))


def lobbying(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, "id string, text string, company_name string, answer string")
    return raw.select(_text("id").alias("_id"), F.format_string("Is this bill relevant to %s?", _text("company_name")).alias("question"), _text("answer").alias("answer"), _one(F.lit("bill"), _text("text")).alias("context"), F.lit("legislation").alias("context_type"))


def scalr(spark: SparkSession, path: str) -> DataFrame:
    """Options are all ``choice_<n>`` that the file has, in order of n."""
    there = [c for c in spark.read.json(path).columns if re.fullmatch(r"choice_\d+", c)]
    names = sorted(there, key=lambda c: int(c.removeprefix("choice_")))
    raw = _read(spark, path, ", ".join(["id string, question string, answer int, text string", *[f"{n} string" for n in names]]))
    options = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    shown = F.array_join(F.transform(options, lambda o, i: F.concat(F.chr(i + 65), F.lit(") "), o)), "\n")
    return raw.select(_text("id").alias("_id"), F.concat(_text("question"), F.lit("\n\nOptions:\n"), shown).alias("question"), F.chr(F.col("answer") + 65).alias("answer"), F.col("answer").alias("answer_index"), F.when(_text("text") != "", _one(F.lit("text"), _text("text"))).otherwise(F.array().cast(_PASSAGES)).alias("context"), F.lit("holding").alias("context_type"))


def entailment(spark: SparkSession, path: str) -> DataFrame:
    """{premise string or list, hypothesis, label}: chunks of the premise; ids
    fall back from id to uid to a hash; rows need a hypothesis."""
    raw = _read(spark, path, "id string, uid string, premise string, hypothesis string, label string, dataset string, subset string")
    listed = F.from_json("premise", "array<string>")
    chunks = F.filter(F.coalesce(F.when(F.col("premise").startswith("["), listed), F.array("premise")), lambda c: F.trim(c) != "")
    rows = raw.select(_first("id", "uid").alias("_id"), _text("hypothesis").alias("question"), F.coalesce("label", F.lit("")).alias("answer"), chunks.alias("premise_chunks"), F.coalesce("dataset", F.lit("")).alias("dataset"), F.coalesce("subset", F.lit("test")).alias("subset"))
    rows = rows.where("question <> ''").withColumn("_id", F.when(F.col("_id") == "", F.concat(F.lit("row-"), F.substring(F.md5(F.concat("question", F.array_join("premise_chunks", ""))), 1, 12))).otherwise(F.col("_id")))
    return rows.withColumns({"premise": F.array_join("premise_chunks", "\n"), "num_chunks": F.size("premise_chunks"), "context": F.transform("premise_chunks", lambda c: F.struct(F.lit("premise").alias("title"), F.array(c).alias("sentences"))).cast(_PASSAGES)})


LEGAL = {
    "contract_qa": text_questions("contract", "clause_extraction"),
    "consumer_contracts_qa": text_questions("tos", "user_agreement_qa"),
    "privacy_policy_qa": text_questions("privacy_policy", "data_handling_qa"),
    "rule_qa": text_questions("rules", "logical_reasoning", needs_text=False),
    "legal_qa": text_questions("legal_document", "legal_qa", needs_text=False),
    "sara_entailment": sara,
    "privacy_policy_entailment": text_questions("privacy_policy", "entailment"),
    "insurance": text_questions("legal_insurance", "insurance_qa"),
    "corporate_lobbying": lobbying,
    "scalr": scalr,
}
LOADERS: dict[str, Callable[..., DataFrame]] = {"hotpotqa": hotpotqa, "musique": musique, "multihop": multihop, "arc": arc, "docnli": entailment, "econ": entailment, "contract_nli": entailment, "control": entailment, **LEGAL}


def load(spark: SparkSession, path: str, task: str) -> DataFrame:
    """Rows of a task's dataset; ``legalbench`` is all of ``LEGAL`` under the
    folders of their names. An unknown task is an error."""
    if task == "legalbench":
        parts = [f(spark, f"{path}/{name}").withColumn("context_type", F.lit(name)) for name, f in LEGAL.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    if task not in LOADERS:
        raise ValueError(f"unknown task {task!r}")
    return LOADERS[task](spark, path)


def evidence_rows(instances: DataFrame) -> DataFrame:
    """(_id, index, title, text): the sentences of all contexts, numbered from
    0 through an instance."""
    flat = F.flatten(F.transform("context", lambda c: F.transform(c["sentences"], lambda s: F.struct(c["title"].alias("title"), s.alias("text")))))
    return instances.select("_id", F.posexplode(flat).alias("index", "e")).select("_id", "index", "e.title", "e.text")


def query_instances(instances: DataFrame) -> DataFrame:
    """query, data, answers (answer and aliases once each) and decomposition,
    in the order of its ids if all steps have one."""
    names = instances.columns
    aliases = F.col("answer_alias") if "answer_alias" in names else F.array().cast("array<string>")
    if "question_decomposition" in names:
        steps = F.col("question_decomposition")
        by_id = F.when(F.forall(steps, lambda s: s["id"].try_cast("long").isNotNull()), F.array_sort(steps, lambda a, b: (a["id"].try_cast("long") - b["id"].try_cast("long")).cast("int"))).otherwise(steps)
        parts = F.transform(by_id, lambda s: s["question"])
    else:
        parts = F.lit(None).cast("array<string>")
    data = F.transform("context", lambda c: F.array_join(c["sentences"], " "))
    return instances.select("_id", F.col("question").alias("query"), data.alias("data"), F.array_union(F.array("answer"), aliases).alias("answers"), parts.alias("query_decomposition"))


def passages(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, title) of a TSV with a header line, or JSON lines."""
    if str(path).endswith((".tsv", ".tsv.gz")):
        return spark.read.option("sep", "\t").option("header", True).schema("id string, text string, title string").csv(path)
    return spark.read.schema("id string, title string, text string").json(path).select("id", "text", "title")


def question_and_answer(text: Column) -> Column:
    """Struct (question, answer) of "Question: … Answer: …"; null if either is
    missing."""
    q = F.trim(F.regexp_extract(text, r"(?is)Question:\s*(.*?)\s*Answer:", 1))
    a = F.trim(F.regexp_extract(text, r"(?is)Answer:\s*(.*)$", 1))
    return F.when((q != "") & (a != ""), F.struct(q.alias("question"), a.alias("answer")))
