"""Operator 4: line-first quality rules, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, lower case.
BOILERPLATE = ("cookie", "all rights reserved", "terms of use", "privacy policy", "licensed under", "javascript", "subscribe", "lorem ipsum")
MAX_LOST = 0.4


def words_of(text: Column) -> Column:
    """The words of a text without outer white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _removed(text: Column, letters: str) -> Column:
    """How many code points of ``text`` are among ``letters``."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def measured(lines: Column) -> Column:
    """Each line with its words: split once, judged by several rules."""
    return F.transform(lines, lambda line: F.struct(line.alias("line"), F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words")))


def line_verdict(line: Column, words: Column) -> Column:
    """Null for a line that passes (or has no word), else the rule it fails.

    navigation: two bars or more, and a bar for every three words; symbols:
    five words or more with as many symbols; shouting: three "!!" or more, one
    for every two words; boilerplate: a phrase of page furniture; repetition:
    ten words or more of which a quarter differ; punctuation: four words or
    more without any mark that ends a sentence or clause.
    """
    n = F.size(words)
    bars, symbols = _removed(line, "|"), _removed(line, SYMBOLS)
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    lower = F.lower(line)
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | F.contains(lower, F.lit(phrase))
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when((bars >= 2) & (3 * bars >= n), "navigation")
        .when((n >= 5) & (symbols >= n), "symbols")
        .when((shouts >= 3) & (2 * shouts >= n), "shouting")
        .when(furniture, "boilerplate")
        .when((n >= 10) & (4 * F.size(F.array_distinct(words)) < n), "repetition")
        .when((n >= 4) & (_removed(line, ".!?:;…\"'”’)]") == 0), "punctuation")
    )


def _repeated(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in a three-word window found twice or more.

    Windows are hashed to 64 bits and sorted with their places in the low bits
    of one long, so equal windows are neighbours; the places of equal ones are
    sorted again and the words that they cover counted. Texts in which all
    windows differ stop after the hash set.
    """
    three = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 2), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2)))
    hashed = docs.withColumn("h", F.when(F.col("n_words") >= 3, three).otherwise(F.array().cast("array<bigint>")))
    hashed = hashed.withColumn("repeats", F.size("h") > F.size(F.array_distinct("h")))
    mask = F.expr("shiftleft(1L, length(bin(size(h)))) - 1")
    hashed = hashed.withColumn("mask", mask)
    packed = F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("mask"))).bitwiseOR(i.cast("long"))))
    hashed = hashed.withColumn("packed", F.when(F.col("repeats"), packed))
    at = lambda x: F.get(F.col("h"), x.bitwiseAND(F.col("mask")).cast("int"))
    places = F.filter("packed", lambda x, i: F.coalesce(at(x) == at(F.get(F.col("packed"), i - 1)), F.lit(False)) | F.coalesce(at(x) == at(F.get(F.col("packed"), i + 1)), F.lit(False)))
    hashed = hashed.withColumn("places", F.when(F.col("repeats"), F.sort_array(F.transform(places, lambda x: x.bitwiseAND(F.col("mask"))))))
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(F.col("places"), i + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    return hashed.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(F.lit(0).cast("long"))).drop("h", "repeats", "mask", "packed", "places")


def quality_rules(docs: DataFrame, max_lost: float = MAX_LOST, carry: str | None = None) -> DataFrame:
    """Judges ``docs(doc_id, text)`` line first; one row for each.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, lost (share of word characters in lines that
    fail a rule), kept and clean_text (the lines that pass, joined again).
    ``kept`` is false if base_failed, or if more than ``max_lost`` is lost.
    Null and empty texts have no words, hence fail. One pass over the table,
    without a shuffle; each row is judged alone, so repeated rows and ties give
    repeated rows, texts of any length are judged whole, an empty table gives no
    rows, and other columns are not read.
    """
    text, kept = F.coalesce("text", F.lit("")), [F.col(carry).alias("_carried")] if carry else []
    counted = docs.select("doc_id", text.alias("text"), *kept).withColumn("words", words_of(F.col("text")))
    counted = counted.withColumn("n_words", F.size("words").cast("long"))
    counted = _repeated(counted).drop("words")
    lines = F.split("text", "\n")
    counted = counted.withColumn("lines", lines)
    worded = F.filter("lines", lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counted = counted.withColumn("worded", worded).withColumn("measured", measured(F.col("lines")))
    chars = lambda x: F.length(F.translate(x, SPACES, ""))
    counted = counted.select(
        "doc_id",
        "n_words",
        chars(F.col("text")).cast("long").alias("word_chars"),
        _removed(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        *[F.col("_carried")] * len(kept),
        F.array_join(F.transform(F.filter("measured", lambda m: line_verdict(m["line"], m["words"]).isNull()), lambda m: m["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.when(F.col("word_chars") == 0, 0.0).otherwise(1 - chars(F.col("clean_text")) / F.col("word_chars"))
    judged = counted.withColumn("base_failed", failed).withColumn("lost", lost).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
    return judged.withColumnRenamed("_carried", carry) if carry else judged


#: DuckDB SQL for the query over ``documents``.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
r AS (SELECT doc_id, list_transform(range(1, greatest(1, len(ws) - 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS wins FROM w),
u AS (SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM r),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM u),
c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM g WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, t, ws, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl,
  list_filter(ls, lambda x: NOT coalesce(CASE
    WHEN len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) = 0 THEN false
    WHEN len(regexp_extract_all(x, '\|')) >= 2 AND 3 * len(regexp_extract_all(x, '\|')) >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) THEN true
    WHEN len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 5 AND len(regexp_extract_all(x, '[#*$%&|<>]')) >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) THEN true
    WHEN len(regexp_extract_all(x, '!!')) >= 3 AND 2 * len(regexp_extract_all(x, '!!')) >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) THEN true
    WHEN regexp_matches(lower(x), 'cookie|all rights reserved|terms of use|privacy policy|licensed under|javascript|subscribe|lorem ipsum') THEN true
    WHEN len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 10 AND 4 * len(list_distinct(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) < len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) THEN true
    WHEN len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 4 AND NOT regexp_matches(x, '[.!?:;…"''”’)\]]') THEN true
    ELSE false END, false)) AS passed FROM w),
m AS (SELECT doc_id, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS sym,
  len(wl) - len(list_distinct(wl)) AS dup, list_sum(list_transform(regexp_extract_all(array_to_string(passed, chr(10)), '[^\x20\x09-\x0D]+'), lambda x: length(x))) AS left_chars FROM l)
SELECT m.doc_id, m.n_words::BIGINT AS n_words, coalesce(m.chars, 0)::BIGINT AS word_chars, m.sym::BIGINT AS n_symbols, m.dup::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  (m.n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * m.n_words) AS base_failed,
  NOT (m.n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * m.n_words) AND 1 - coalesce(m.left_chars, 0)::DOUBLE / greatest(1, coalesce(m.chars, 0)) <= 0.4 AS kept
FROM m LEFT JOIN c USING (doc_id)
"""
