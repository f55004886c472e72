"""Texts made of vertices, answers and prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vertex

#: Marks that a model with reflection puts in its output.
REFLECTION = (
    "[Fully supported]", "[Partially supported]", "[No support / Contradictory]", "[No Retrieval]", "[Retrieval]", "[Irrelevant]", "[Relevant]",
    "<paragraph>", "</paragraph>", "[Utility:1]", "[Utility:2]", "[Utility:3]", "[Utility:4]", "[Utility:5]", "</s>",
)


def display(values: Column) -> Column:
    """An array's values in one text, ``A|B``; entities without NOT_ENTITY."""
    return F.array_join(F.filter(values, lambda v: v != vertex.NONE), "|")


def resolved_text(own: Column, primary: Column, antecedent: Column, text: Column) -> Column:
    """What a mention stands for: its own resolution, else its primary
    mention's text, else its antecedent's, else its own text."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(own), filled(primary), filled(antecedent), text)


def vertex_text(resolved: Column, is_query: Column) -> Column:
    """The resolved text, with a question mark before what is asked for."""
    return F.when(is_query, F.concat(F.lit("?"), resolved)).otherwise(resolved)


def type_label(query_type: Column, kind: Column, pos: Column) -> Column:
    """What a path's text says for a token: the type asked for, else its own
    type; verbs have none, other adjectives and adverbs are attributes."""
    known = F.when(kind.isNotNull() & (kind != "NOT_ENT"), kind)
    return F.when(pos.isin("VERB", "AUX"), F.lit(None).cast("string")).otherwise(F.coalesce(query_type, known, F.when(pos.isin("ADJ", "ADV"), "ATTRIBUTE")))


def is_valid_node(ents: Column, poses: Column) -> Column:
    """If a noun is there whose entity is no date or number."""
    pairs = F.arrays_zip(ents.alias("e"), poses.alias("p"))
    plain = lambda e: ~e.isin("DATE", "TIME", "PERCENT", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL")
    return F.exists(pairs, lambda x: x["p"].isin("NOUN", "PROPN") & plain(F.coalesce(x["e"], F.lit(vertex.NONE))))


def is_content(poses: Column, virtual: Column) -> Column:
    """Neither virtual nor a verb."""
    return ~virtual & ~vertex.any_pos(poses, "VERB", "AUX")


def should_refine(query_type: Column, poses: Column, virtual: Column) -> Column:
    """If a vertex may be given a type: no question word, verb, adjective or adverb."""
    return query_type.isNull() & is_content(poses, virtual) & ~vertex.any_pos(poses, "ADJ", "ADV")


def is_shorthand(question: Column) -> Column:
    """``subject >> relation`` questions."""
    return F.coalesce(F.contains(question, F.lit(">>")), F.lit(False))


def fix_spacing(text: Column) -> Column:
    """A space after a mark that ends a sentence within a word."""
    return F.regexp_replace(text, r"(?U)(?<=\w)([.!?])(?=\w)", "$1 ")


def without_reflection(text: Column) -> Column:
    """A model's output without its marks and without one space in front."""
    for mark in REFLECTION:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.regexp_replace(text, "^ ", "")


def closed_answer(output: Column, task: str, choices: Column | None = None) -> Column:
    """The last of the space-separated choices that the output holds; for fact
    verification true or false; else the output."""
    found = F.lit(None).cast("string")
    if choices is not None:
        named = F.filter(F.split(choices, " "), lambda c: F.contains(output, c))
        found = F.when(F.size(named) > 0, F.element_at(named, -1))
    if task == "fever":
        verdict = F.when(output == "SUPPORTS", "true").when(output == "REFUTES", "false").when(F.lower(output).isin("true", "false"), F.lower(output))
        found = F.coalesce(verdict, found)
    return F.coalesce(found, output)


def choice_letter(label: Column) -> Column:
    """1 to 4 as A to D; A to D as they are; null for others."""
    return F.when(label.isin("A", "B", "C", "D"), label).when(label.isin("1", "2", "3", "4"), F.translate(label, "1234", "ABCD"))


def choice_lines(labels: Column, texts: Column) -> Column:
    """The options, each on a line ``A: text``; D stands there even if empty."""
    pairs = F.arrays_zip(labels.alias("l"), texts.alias("t"))
    at = lambda letter: F.element_at(F.filter(pairs, lambda p: choice_letter(p["l"]) == letter), -1)["t"]
    line = lambda letter: F.concat(F.lit(f"\n{letter}: "), F.coalesce(F.when(F.exists(pairs, lambda p: choice_letter(p["l"]) == letter), at(letter)), F.lit("")))
    return F.concat(*map(line, "ABCD"))


def instruction(task_text: str | None, question: Column, options: Column | None = None) -> Column:
    """A task's text over the question, with options below where there are any."""
    if options is not None:
        return F.concat(F.lit((task_text or "") + "\n\n### Input:\n"), question, options)
    return question if task_text is None else F.concat(F.lit(task_text + "\n\n## Input:\n\n"), question)


def cited(sentences: Column) -> Column:
    """Sentences without marks, each with the number of its document in place of
    its last character: ``text [0]. text [1].``; empty ones are left out."""
    lines = F.transform(sentences, lambda s, i: F.struct(without_reflection(s).alias("s"), i.alias("i"), s.alias("raw")))
    kept = F.transform(F.filter(lines, lambda x: x["raw"] != ""), lambda x: F.concat(F.substring(x["s"], F.lit(1), F.length(x["s"]) - 1), F.lit(" ["), x["i"].cast("string"), F.lit("].")))
    return F.array_join(kept, " ")


def between(text: Column, first: Column, last: Column) -> Column:
    """From the first place of ``first`` to the last of ``last``; the whole text
    if one is missing, empty, equal to the other, or they stand the other way."""
    start = F.instr(text, first)
    back = F.instr(F.reverse(text), F.reverse(last))
    end = F.length(text) - back + 1
    usable = (F.length(first) > 0) & (F.length(last) > 0) & (first != last) & (start > 0) & (back > 0) & (start < end - F.length(last) + 1)
    return F.when(F.coalesce(usable, F.lit(False)), F.substring(text, start, end - start + 1)).otherwise(text)


#: Prompts by task: own wording, with places for the context and the question.
PROMPTS = {
    "hotpotqa": "Answer from the passages.\n{context}\n\nQuestion: {question}\n### Final Answer:",
    "musique": "Answer from the passages, step by step.\n{context}\n\nQuestion: {question}\n### Final Answer:",
    "multihop": "Combine the passages.\n{context}\n\nQuestion: {question}\n### Final Answer:",
    "legalbench": "Answer the legal question from the document.\n{context}\n\nQuestion: {question}\n### Final Answer:",
    "ARC": "Choose the best option.\n{context}\n\nQuestion: {question}\n### Final Answer:",
}


def prompt(question: Column, context: Column, task: str) -> Column:
    """The prompt of a task; of ``legalbench/…`` and ``qa/…`` that of legal
    questions. Raises for an unknown task."""
    name = "legalbench" if task.split("/")[0] in ("legalbench", "qa") else task
    if name not in PROMPTS:
        raise ValueError(f"unsupported task {task!r}")
    head, rest = PROMPTS[name].split("{context}")
    middle, tail = rest.split("{question}")
    return F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))


def join_mentions(text: Column, old: Column, new: Column) -> Column:
    """``text`` with each mention ``old[i]`` replaced by ``new[i]``, in order,
    and squeezed; empty mentions are passed over."""
    pairs = F.arrays_zip(old.alias("o"), new.alias("n"))
    usable = F.filter(pairs, lambda p: (F.coalesce(p["o"], F.lit("")) != "") & (F.coalesce(p["n"], F.lit("")) != ""))
    replaced = F.aggregate(usable, text, lambda t, p: F.replace(t, p["o"], p["n"]))
    return F.trim(F.regexp_replace(replaced, r"\s+", " "))
