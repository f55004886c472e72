import collections
import math
import re
import string

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text, vector, vertex


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def normal(s, keep=False):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    if not (keep and s.strip() in ("a", "an", "the")):
        s = re.sub(r"\b(a|an|the)\b", " ", s)
    return " ".join(s.split())


def f1(p, t):
    p, t = normal(p).split(), normal(t).split()
    same = sum((collections.Counter(p) & collections.Counter(t)).values())
    return 0.0 if not same else 2 * same / (len(p) + len(t))


@pytest.mark.parametrize(("p", "t"), [("The cat, sat!", "a cat sat"), ("", ""), ("x x y", "x y y"), ("the", "an"), ("Überraschung hier", "überraschung"), ("no", "yes")])
def test_answers(spark, p, t):
    assert one(spark, text.normalize_answer(F.col("p")), p=p) == normal(p)
    assert one(spark, text.normalize_answer(F.col("p"), keep_bare_article=True), p=p) == normal(p, True)
    assert one(spark, text.exact_match(F.col("p"), F.col("t")), p=p, t=t) == (normal(p) == normal(t))
    assert math.isclose(one(spark, text.token_f1(F.col("p"), F.col("t")), p=p, t=t), f1(p, t))
    assert math.isclose(one(spark, text.token_f1(F.col("t"), F.col("p")), p=p, t=t), f1(p, t))


def test_over_truths(spark):
    best = text.over_truths(text.token_f1, F.col("p"), F.col("t"))
    assert one(spark, best, p="red car", t=["blue", "red"]) == pytest.approx(2 / 3)
    assert one(spark, best, p="red car", t=[]) == 0.0


@pytest.mark.parametrize(("p", "t", "hit"), [("the cat", ["a"], 0), ("Answer: A.", ["a"], 1), ("concatenate", ["CAT"], 1), ("x", [""], 0), ("x", [], 0), ("1.5", ["."], 1), ("a .", ["."], 0)])
def test_match(spark, p, t, hit):
    assert one(spark, text.answer_match(F.col("p"), F.col("t")), p=p, t=t) == hit


@pytest.mark.parametrize(("body", "answer", "found"), [("The red car", "RED car", True), ("redcar", "red", False), (None, "x", False), ("abc", " ", True), ("a b", "b a", False)])
def test_contains_tokens(spark, body, answer, found):
    assert one(spark, text.contains_tokens(F.col("b"), F.col("a")), b=body, a=answer) is found


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("", ("unanswerable", "empty_input", True)),
        ("so ### Final Answer: Paris.\nmore", ("Paris", "parsed_final_answer", False)),
        ("### Final Answer: ### Final Answer: Rome!", ("Rome", "parsed_final_answer", False)),
        ("Step 1: look\nBerlin.", ("Berlin", "parsed_last_line", False)),
        ("# only\n" + "reason " * 60, (("# only\n" + "reason " * 60).strip(" .,;:!?\"'")[:200], "fallback_truncated", True)),
    ],
)
def test_postprocess(spark, raw, wanted):
    assert tuple(one(spark, text.postprocess_answer(F.col("r")), r=raw)) == wanted


def test_strings(spark):
    assert one(spark, text.clean_text(F.col("a")), a=" x [n 12] – y\n") == "x - y"
    assert one(spark, text.normalize_special_chars(F.col("a")), a="a\\nb\tc  d") == "a b c d"
    assert one(spark, text.instance_id(F.col("a")), a="Who is\n it?") == one(spark, text.instance_id(F.col("a")), a="whoisit?")
    assert one(spark, text.tokens(F.col("a")), a="it's 5€!") == ["it", "'", "s", "5", "€", "!"]
    answers = [f"a{i}" for i in range(1, 11)]
    assert one(spark, text.resolve_placeholders(F.col("t"), F.col("a")), t="#10 and #1 and #11", a=answers) == "a10 and a1 and a11"
    assert one(spark, text.resolve_placeholders(F.col("t"), F.col("a")), t="#2", a=[]) == "#2"
    assert one(spark, text.entity_tags(F.col("a")), a="Ann <PERSON> Rome <LOC>") == {"Ann": "PERSON", "Rome": "LOC"}
    assert one(spark, text.json_payload(F.col("a")), a='x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert one(spark, text.json_payload(F.col("a")), a="none") is None
    labels, options = ["A", "B", "C"], ["red", "green", "blue"]
    for raw, wanted in (("B", "B"), ("b)", "B"), ("2", "B"), ("Green", "B"), ("it is (C), surely", "C"), ("none of it", None)):
        assert one(spark, text.option_label(F.col("r"), F.col("l"), F.col("o")), r=raw, l=labels, o=options) == wanted
    assert one(spark, text.compact_prefix(F.col("a")), a="one two three four five six seven eight nine") == "one two three four five six seven eight,"
    assert one(spark, text.yes_no(F.col("a")), a="Well, NO.") == "no"
    assert one(spark, text.fuzzy_ratio(F.lit("abcd"), F.lit("abcx"))) == 75.0


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vector.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, vector.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, vector.hoyer(a, b)) == pytest.approx((math.sqrt(2) - 2 / math.sqrt(2)) / (math.sqrt(2) - 1), abs=1e-12)
    assert sum(one(spark, vector.softmax(a))) == pytest.approx(1)


def test_vertex_algebra(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, vertex.pos_range(arr("AUX"), F.lit("VERB"))) is True
    assert one(spark, vertex.pos_range(arr("ADJ"), F.lit("VERB"))) is False
    assert one(spark, vertex.ent_range(arr("GPE"), F.lit("NORP"))) is False
    assert one(spark, vertex.ent_range(arr("NORP"), F.lit("GPE"))) is True
    assert one(spark, vertex.is_domain(arr("GPE"), arr("ORG"))) is True
    assert one(spark, vertex.is_domain(arr("GPE"), arr("NOT_ENTITY"))) is False
    assert one(spark, vertex.is_domain(arr(), arr())) is False
    assert one(spark, vertex.vertex_type(arr("CONCEPT", "PERSON", "ORG"), arr("NOUN"))) == "ORG"
    assert one(spark, vertex.vertex_type(arr("NOT_ENT"), arr("NUM"))) == "NUMBER"
    assert one(spark, vertex.vertex_type(arr(), arr("NOUN"))) is None
    assert one(spark, vertex.coarse(F.lit("MONEY"))) == "NUMBER"
    assert one(spark, vertex.all_pos(arr(), "PRON")) is True
    group = lambda k, *p: one(spark, vertex.strict_type_group(F.lit(k), arr(*p)))
    assert [group("GPE", "NOUN"), group("LAW", "NOUN"), group(None, "ADJ"), group("PERSON", "VERB"), group(None)] == ["LOC_ORG_GROUP", "ENT::LAW", "NO_ENT_ADJ_GROUP", "VERB_GROUP", "NO_ENT_OTHER"]
    assert one(spark, vertex.answers_query(F.lit("WHAT"), F.lit(None).cast("string"), arr("PRON"))) is True
    assert one(spark, vertex.answers_query(F.lit("TIME"), F.lit("NUMBER"), arr("NUM"))) is False
    assert one(spark, vertex.match_confidence(F.lit("x "), F.lit("x"), arr("GPE"), arr("GPE"), arr("NOUN"), arr("VERB"))) == pytest.approx(0.8)
