"""String functions as column expressions. White space is Java's ``\\s`` with
Unicode classes, as ``SPACE``; null gives null unless stated."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that rule a line out as a short answer.
NOT_ANSWERS = ("step", "reason", "explain", "note", "context", "paragraph", "think", "analysis", "conclusion")
EDGE = " .,;:!?\"'"


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def instance_id(query: Column) -> Column:
    """First 16 hex digits of MD5 over the lower-case query without spaces."""
    return F.substring(F.md5(F.lower(F.regexp_replace(query, SPACE, ""))), 1, 16)


def clean_text(text: Column) -> Column:
    """Without ``[n 12]`` marks, squeezed, long dashes as ``-``; null gives ""."""
    bare = squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[n\s+\d+\]", ""))
    return F.translate(bare, "–—―", "---")


def normalize_special_chars(text: Column) -> Column:
    """Control characters, and their two-letter escapes, as single spaces."""
    spaced = F.regexp_replace(text, r"\\[nrtvfba]|[\n\r\t\x0B\f\x08\x07]", " ")
    return squeeze(F.regexp_replace(spaced, " +", " "))


def to_ascii_marks(text: Column) -> Column:
    """Unicode hyphens, quotes, primes, slashes and ellipses in ASCII; control
    and format characters as spaces."""
    out = F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", " ")
    out = F.regexp_replace(out, "[‐‑‒–—―−]", "-")
    out = F.regexp_replace(out, "[‘’‚‛′´`]", "'")
    out = F.regexp_replace(out, "[“”„‟″]", '"')
    return F.replace(F.translate(out, "⁄∕", "//"), F.lit("…"), F.lit("..."))


def decomposed(text: Column) -> Column:
    """Unicode NFD, which no built-in function gives; by Arrow batches."""

    @F.pandas_udf("string")
    def nfd(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))

    return nfd(text)


def tokens(text: Column, uncased: bool = False) -> Column:
    """Runs of letters, digits and marks, or single other visible characters."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"), F.lit(0))
    return F.transform(found, F.lower) if uncased else found


def contains_tokens(text: Column, answer: Column) -> Column:
    """If the answer's tokens follow one another in the text, any case. Null
    text gives false, an answer without tokens true."""
    sep = "\u0001"
    framed = lambda c: F.concat(F.lit(sep), F.array_join(tokens(c, True), sep), F.lit(sep))
    return F.when(text.isNull(), F.lit(False)).when(F.size(tokens(answer)) == 0, F.lit(True)).otherwise(F.contains(framed(text), framed(answer)))


def normalize_answer(text: Column, keep_bare_article: bool = False) -> Column:
    """Lower case, no punctuation, no articles, squeezed. A text that is just
    an article stays if ``keep_bare_article``."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    without = F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")
    if keep_bare_article:
        without = F.when(F.trim(plain).isin("a", "an", "the"), plain).otherwise(without)
    return squeeze(without)


def exact_match(prediction: Column, truth: Column, **kind: bool) -> Column:
    return normalize_answer(prediction, **kind) == normalize_answer(truth, **kind)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_f1(prediction: Column, truth: Column, **kind: bool) -> Column:
    """F1 of the multisets of normalised tokens; 0 if they share none.

    A token is numbered among its equals in sorted order, so what two sorted
    arrays share as sets is what they share as multisets."""
    words = lambda c: F.sort_array(_words(normalize_answer(c, **kind)))
    numbered = lambda a: F.transform(a, lambda x, i: F.concat(x, F.lit(" "), (i - F.array_position(a, x)).cast("string")))

    def score(s: Column) -> Column:
        same = F.size(F.array_intersect(numbered(s["p"]), numbered(s["t"])))
        return _let(F.struct(same.alias("n"), F.size(s["p"]).alias("p"), F.size(s["t"]).alias("t")), lambda c: F.when(c["n"] == 0, F.lit(0.0)).otherwise(2 * (c["n"] / c["p"]) * (c["n"] / c["t"]) / (c["n"] / c["p"] + c["n"] / c["t"])))

    return _let(F.struct(words(prediction).alias("p"), words(truth).alias("t")), score)


def over_truths(metric, prediction: Column, truths: Column, **kind: bool) -> Column:
    """Greatest value of a metric over an array of truths; 0.0 without any."""
    return F.coalesce(F.array_max(F.transform(truths, lambda t: metric(prediction, t, **kind).cast("double"))), F.lit(0.0))


def answer_match(prediction: Column, truths: Column) -> Column:
    """1 if any truth is in the prediction, any case; truths of one or two
    characters need word boundaries, empty ones do not count."""
    low = F.lower(F.coalesce(prediction, F.lit("")))

    def one(t: Column) -> Column:
        quoted = F.concat(F.lit(r"(?U)\b\Q"), F.lower(t), F.lit(r"\E\b"))
        return F.when(F.length(t) == 0, F.lit(False)).when(F.length(t) <= 2, F.call_function("rlike", low, quoted)).otherwise(F.contains(low, F.lower(t)))

    return F.exists(truths, lambda t: F.coalesce(one(t), F.lit(False))).cast("int")


def postprocess_answer(answer: Column) -> Column:
    """Struct (answer, status, fallback) from a model's output: what stands
    behind the last "### Final Answer:", else the last short line without the
    words of ``NOT_ANSWERS``, else the first 200 characters."""
    bare = F.btrim(F.replace(F.replace(answer, F.lit("</s>"), F.lit("")), F.lit("</think>"), F.lit("")), F.lit(" \t\n\r\f\x0b"))
    first = F.regexp_extract(bare, r"(?i)###\s*Final\s*Answer:\s*(.+?)(?:\n|$)", 1)
    final = F.btrim(F.regexp_replace(first, r"(?i)^.*###\s*Final\s*Answer:\s*(?=\S)", ""), F.lit(EDGE))
    lines = F.transform(F.split(bare, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")))
    usable = F.filter(lines, lambda x: (x != "") & (F.length(x) < 100) & ~F.lower(x).rlike("|".join(NOT_ANSWERS)) & ~x.startswith("#") & (F.btrim(x, F.lit(EDGE)) != ""))
    cut = F.substring(F.btrim(bare, F.lit(EDGE)), 1, 200)
    out = lambda a, s, f: F.struct(a.alias("answer"), F.lit(s).alias("status"), F.lit(f).alias("fallback"))
    return (
        F.when(F.coalesce(answer, F.lit("")) == "", out(F.lit("unanswerable"), "empty_input", True))
        .when(final != "", out(final, "parsed_final_answer", False))
        .when(F.size(usable) > 0, out(F.btrim(F.element_at(usable, -1), F.lit(EDGE)), "parsed_last_line", False))
        .otherwise(out(F.when(cut == "", "unanswerable").otherwise(cut), "fallback_truncated", True))
    )


def resolve_placeholders(text: Column, answers: Column) -> Column:
    """``#k`` as the k-th of ``answers``, the highest k first so that ``#1``
    does not take ``#10``; placeholders without an answer stay."""
    steps = F.when(F.size(answers) > 0, F.sequence(F.size(answers), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, text, lambda t, k: F.replace(t, F.concat(F.lit("#"), k.cast("string")), F.coalesce(F.element_at(answers, k), F.concat(F.lit("#"), k.cast("string")))))


def entity_tags(text: Column) -> Column:
    """Map of ``name <TAG>`` pairs; a repeated name has its last tag."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"([^<>]+?)\s*<[^<>]+>"), F.lit(1)), lambda n: F.trim(n))
    tags = F.regexp_extract_all(text, F.lit(r"[^<>]+?\s*<([^<>]+)>"), F.lit(1))
    pairs = F.arrays_zip(names.alias("n"), tags.alias("t"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["n"] == p["n"]))
    return F.map_from_arrays(F.transform(last, lambda p: p["n"]), F.transform(last, lambda p: p["t"]))


def binary_label(label: Column, positive: tuple[str, ...], yes: str, no: str) -> Column:
    """``yes`` if the trimmed lower-case label is among ``positive``."""
    return F.when(F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(*positive), yes).otherwise(no)


def option_label(answer: Column, labels: Column, options: Column) -> Column:
    """An option's label from a label, "A)", a number, its text, or a letter
    within a sentence; null if none."""
    bare = F.trim(answer)
    upper = F.upper(F.regexp_extract(bare, r"^\(?([A-Za-z0-9])[).:]?$", 1))
    number = F.regexp_extract(bare, r"^([0-9]+)[).:]?$", 1).try_cast("int")
    place = F.array_position(F.transform(options, lambda o: F.lower(F.trim(o))), F.lower(bare))
    inline = F.upper(F.regexp_extract(bare, r"(?:^|[^A-Za-z])\(?([A-Ha-h])\)?(?:[^A-Za-z]|$)", 1))
    at = lambda i: F.get(labels, i - 1)
    return F.coalesce(
        F.when(F.array_contains(labels, upper), upper),
        F.when(number.between(1, F.size(labels)), at(number)),
        F.when(place > 0, at(place.cast("int"))),
        F.when(F.array_contains(labels, inline), inline),
    )


def unwrap_tags(text: Column) -> Column:
    """``<x>`` as ``x``, squeezed."""
    return squeeze(F.regexp_replace(text, "<([^<>]*)>", "$1"))


def compact_prefix(title: Column, words: int = 8) -> Column:
    """At most eight words of a title, ended by a comma."""
    cut = F.array_join(F.slice(_words(squeeze(title)), 1, words), " ")
    return F.when(cut == "", F.lit("")).otherwise(F.concat(F.regexp_replace(cut, "[,.;:]+$", ""), F.lit(",")))


def json_payload(text: Column) -> Column:
    """The fenced block of a model's output, else the outermost braces, else
    the outermost brackets; null if there is none."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    brackets = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(*[F.when(F.btrim(c, F.lit(" \n\r\t")) != "", F.btrim(c, F.lit(" \n\r\t"))) for c in (fence, braces, brackets)])


def spans_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """If half-open spans share a place."""
    return (a0 < b1) & (b0 < a1)


def yes_no(text: Column) -> Column:
    """"yes" or "no" from the first such word; null without one."""
    found = F.lower(F.regexp_extract(text, r"(?i)\b(yes|no)\b", 1))
    return F.when(found != "", found)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """100 for equal texts down to 0, by edit distance over both lengths."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100 * (1 - F.levenshtein(a, b) / longest))
