"""Models as parameters: texts in batches through a given function, and the
pipeline from questions to prompts and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import render
from ..operators import retrieval


def complete(rows: DataFrame, prompt: str, out: str, generate: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """``rows`` with ``out``, what ``generate`` gives for the prompts, ``batch``
    at a time. Each different prompt is asked once; null prompts have no answer.
    A batch that fails gives nulls, and its message in ``<out>_error``."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                try:
                    part[out], part[f"{out}_error"] = generate(part[prompt].tolist()), None
                except Exception as e:  # one bad batch must not end a long run
                    part[out], part[f"{out}_error"] = None, f"{type(e).__name__}: {e}"
                yield part

    asked = rows.where(F.col(prompt).isNotNull()).select(prompt).distinct()
    schema = T.StructType([rows.schema[prompt], T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])
    return rows.join(asked.mapInPandas(ask, schema), prompt, "left")


def retrieve_prompts(queries: DataFrame, vectors: DataFrame, passages: DataFrame, k: int, task: str) -> DataFrame:
    """(query_id, question, context, prompt) of ``queries`` (vec_id, embedding,
    question): the texts of the ``k`` nearest passages, best first."""
    found = retrieval.exact_neighbours(queries, vectors, k).withColumnRenamed("vec_id", "id")
    met = retrieval.with_passages(found, passages)
    shown = F.struct("rank", retrieval.passage_text(F.col("title"), F.col("text")).alias("t"))
    context = met.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["t"]), "\n").alias("context"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "question").join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return asked.withColumn("prompt", render.prompt(F.col("question"), F.col("context"), task))
