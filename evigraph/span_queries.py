"""Registered queries of token spans and mentions, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import build, spans
from .token_queries import _TOKENS, _tokens


def hyphen_spans(s, d):
    """Every fifth event is a hyphen, or ends or begins with one."""
    mark = F.when(F.col("idx") % 5 == 3, "-").when(F.col("idx") % 7 == 2, F.concat("text", F.lit("-"))).when(F.col("idx") % 11 == 4, F.concat(F.lit("-"), "text")).otherwise(F.col("text"))
    return spans.hyphen_spans(_tokens(s, d).withColumn("text", mark)).select("graph", "start", "end")


def _chained(s, d):
    """Tokens that hang from the next noun or verb behind them."""
    t = _tokens(s, d)
    head = F.first(F.when(F.col("pos").isin("NOUN", "VERB"), F.col("idx")), ignorenulls=True).over(Window.partitionBy("graph").orderBy("idx").rowsBetween(1, Window.unboundedFollowing))
    named = F.element_at(F.array(*map(F.lit, ("advmod", "neg", "aux", "compound", "amod"))), (F.col("idx") % 5 + 1).cast("int"))
    dep = F.when(F.col("pos").isin("NOUN", "VERB"), "ROOT").otherwise(named)
    return t.withColumn("head", head).withColumn("dep", dep)


def noun_spans(s, d):
    t = _chained(s, d)
    scores = build.bigram_scores(t.select(F.col("graph").alias("doc"), F.col("idx").alias("place"), F.lower("text").alias("token")))
    return spans.noun_spans(t, scores.withColumn("llr", F.lit(9.0)).where("a like 'click%'")).select("graph", "start", "end")


def verb_spans(s, d):
    return spans.verb_spans(_chained(s, d)).select("graph", "start", "end")


def merged_tokens(s, d):
    t = _chained(s, d)
    return spans.merge_spans(t, spans.verb_spans(t)).select("graph", "idx", "text", "pos", "dep", "head", "ent")


def repeated_spans(s, d):
    return spans.repeated_spans(_tokens(s, d), 3).select("graph", "start", "end")


def level_order(s, d):
    return spans.level_order(_tokens(s, d), up=True).select("graph", "idx", F.col("depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"))


def tokens_of_chars(s, d):
    t = _tokens(s, d)
    w = Window.partitionBy("graph").orderBy("idx")
    end = F.sum(F.length("text") + 1).over(w)
    placed = t.select("graph", "idx", (end - F.length("text") - 1).alias("char_start"), (end - 1).alias("char_end"))
    asked = placed.where("idx % 10 = 3").select("graph", F.col("idx").alias("span"), (F.col("char_start") + 2).alias("char_start"), (F.col("char_end") + 9).alias("char_end"))
    return spans.tokens_of_chars(asked, placed).select("graph", "span", "start", "end")


def primary_mentions(s, d):
    t = _tokens(s, d)
    mentions = t.select("graph", F.floor(F.col("idx") / 4).alias("cluster"), "idx", "text", "pos", "ent", F.concat(F.lit("l_"), "text").alias("lemma"), (F.col("idx") % 3 == 0).alias("in_primary"))
    return spans.primary_mentions(mentions).select("graph", "idx", "primary", "resolved")


def entity_levels(s, d):
    paths = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.array(F.lit("thing"), F.col("p_type"), F.col("p_brand"), F.split("p_name", " ")[0]).alias("path"))
    names = s.createDataFrame([("thing", "CONCEPT"), ("PROMO", "PRODUCT"), ("small", "NOT_ENT"), ("Brand#2", "ORG"), ("ECONOMY", "ECONOMIC")], "name string, entity string")
    both = spans.entity_levels(paths, names, False).withColumnRenamed("entity", "of_span").join(spans.entity_levels(paths, names, True).withColumnRenamed("entity", "of_token"), "id")
    return both.select("id", "of_span", "of_token")


def step_vertices(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey")
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    k = F.col("o_orderkey")
    steps = o.select(F.col("o_custkey").alias("instance"), step.alias("step"), F.array(k % 7, k % 5).alias("local"), F.array(k % 11).alias("answer"), F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long")).alias("valid"))
    steps = steps.withColumn("question", F.concat(F.lit("what of #"), F.greatest(F.lit(1), F.col("step") - 1).cast("string"), F.lit(" and #9")))
    return spans.step_vertices(steps).select("instance", "step", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def group_links(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet").select(F.lit(0).alias("graph"), (F.col("l_orderkey") % 500).alias("group"), F.col("l_partkey").alias("node")).distinct()
    return spans.group_links(lines).select("a", "b", "bridge")


QUERIES = {f.__name__: f for f in (hyphen_spans, noun_spans, verb_spans, merged_tokens, repeated_spans, level_order, tokens_of_chars, primary_mentions, entity_levels, step_vertices, group_links)}

_CHAINED = f"{_TOKENS}, h AS (SELECT graph, idx, text, pos, ent, CASE WHEN pos IN ('NOUN', 'VERB') THEN 'ROOT' ELSE ['advmod','neg','aux','compound','amod'][idx % 5 + 1] END AS dep, min(CASE WHEN pos IN ('NOUN', 'VERB') THEN idx END) OVER (PARTITION BY graph ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS head FROM t), bg AS (SELECT DISTINCT lower(a.text) AS a, lower(b.text) AS b FROM t a JOIN t b ON a.graph = b.graph AND b.idx = a.idx + 1)"
# all tokens between two heads hang from the second: a run ends at the first that is not allowed
_PHRASE = "{c}, x AS (SELECT h.*, p.pos AS hp, bg.a IS NOT NULL AS strong FROM h JOIN h p ON p.graph = h.graph AND p.idx = h.head LEFT JOIN bg ON bg.a = lower(h.text) AND bg.b = lower(p.text)), b AS (SELECT graph, head, max(idx) FILTER (NOT ({ok})) AS stop, min(idx) AS low, count(*) AS n FROM x WHERE hp = '{pos}' GROUP BY 1, 2), sp AS (SELECT graph, coalesce(stop + 1, low) AS start, head + 1 AS \"end\" FROM b WHERE coalesce(stop + 1, low) < head)"
_VERB = _PHRASE.format(c=_CHAINED, ok="dep IN ('aux', 'neg', 'advmod')", pos="VERB")

ORACLE_SQL = {
    "hyphen_spans": f"WITH RECURSIVE {_TOKENS}, m AS (SELECT graph, idx, dep, CASE WHEN idx % 5 = 3 THEN '-' WHEN idx % 7 = 2 THEN text || '-' WHEN idx % 11 = 4 THEN '-' || text ELSE text END AS x FROM t), n AS (SELECT *, lag(dep) OVER w AS pb, lead(dep) OVER w AS pa FROM m WINDOW w AS (PARTITION BY graph ORDER BY idx)), "
    "c AS (SELECT graph, idx, CASE WHEN x = '-' THEN idx - 1 WHEN ends_with(x, '-') THEN idx ELSE idx - 1 END AS s, CASE WHEN x = '-' THEN idx + 2 WHEN ends_with(x, '-') THEN idx + 2 ELSE idx + 1 END AS e FROM n WHERE (x = '-' AND pb IS NOT NULL AND pa IS NOT NULL AND pb <> 'conj' AND pa <> 'conj') OR (x <> '-' AND ends_with(x, '-') AND pa IS NOT NULL) OR (x <> '-' AND NOT ends_with(x, '-') AND starts_with(x, '-') AND pb IS NOT NULL)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY idx) AS k FROM c), r AS (SELECT graph, k, s, e, true AS ok, e AS till FROM k WHERE k = 1 UNION ALL SELECT k.graph, k.k, k.s, k.e, k.s >= r.till, CASE WHEN k.s >= r.till THEN k.e ELSE r.till END FROM r JOIN k ON k.graph = r.graph AND k.k = r.k + 1) SELECT graph, s AS start, e AS \"end\" FROM r WHERE ok",
    "noun_spans": "WITH " + _PHRASE.format(c=_CHAINED, ok="dep IN ('advmod', 'neg', 'compound') OR (dep = 'amod' AND strong AND starts_with(lower(text), 'click'))", pos="NOUN") + ' SELECT graph, start, "end" FROM sp WHERE "end" - start <= 5',
    "verb_spans": f'WITH {_VERB} SELECT graph, start, "end" FROM sp',
    "merged_tokens": f'WITH {_VERB}, o AS (SELECT h.*, coalesce(s.start, h.idx) AS dst FROM h LEFT JOIN sp s ON s.graph = h.graph AND h.idx >= s.start AND h.idx < s."end"), g AS (SELECT o.*, p.dst AS hd FROM o LEFT JOIN o p ON p.graph = o.graph AND p.idx = o.head) '
    "SELECT graph, dst AS idx, string_agg(text, ' ' ORDER BY idx) AS text, arg_min(pos, idx) FILTER (hd IS NULL OR hd <> dst) AS pos, arg_min(dep, idx) FILTER (hd IS NULL OR hd <> dst) AS dep, arg_min_null(hd, idx) FILTER (hd IS NULL OR hd <> dst) AS head, arg_min(ent, idx) FILTER (hd IS NULL OR hd <> dst) AS ent FROM g GROUP BY 1, 2",
    "repeated_spans": f"WITH {_TOKENS}, r AS (SELECT graph, idx, lower(text) || ' ' || lower(lead(text) OVER w) || ' ' || lower(lead(text, 2) OVER w) AS x FROM t WINDOW w AS (PARTITION BY graph ORDER BY idx)), c AS (SELECT *, count(*) OVER (PARTITION BY graph, x) AS n FROM r WHERE x IS NOT NULL) SELECT graph, idx AS start, idx + 3 AS \"end\" FROM c WHERE n > 1",
    "level_order": f"WITH RECURSIVE {_TOKENS}, l AS (SELECT graph, idx, 0::BIGINT AS depth FROM t WHERE head IS NULL UNION ALL SELECT t.graph, t.idx, l.depth + 1 FROM l JOIN t ON t.graph = l.graph AND t.head = l.idx) SELECT graph, idx, depth, row_number() OVER (PARTITION BY graph ORDER BY depth DESC, idx) AS place FROM l",
    "tokens_of_chars": f"WITH {_TOKENS}, p AS (SELECT graph, idx, sum(length(text) + 1) OVER (PARTITION BY graph ORDER BY idx) - length(text) - 1 AS s, sum(length(text) + 1) OVER (PARTITION BY graph ORDER BY idx) - 1 AS e FROM t) SELECT a.graph, a.idx AS span, min(b.idx) AS start, max(b.idx) + 1 AS \"end\" FROM p a JOIN p b ON a.graph = b.graph AND b.s < a.e + 9 AND a.s + 2 < b.e WHERE a.idx % 10 = 3 GROUP BY 1, 2",
    "primary_mentions": f"WITH {_TOKENS}, m AS (SELECT graph, idx // 4 AS c, idx, text, pos, ent <> 'NOT_ENTITY' AS e, CASE pos WHEN 'VERB' THEN 10 WHEN 'AUX' THEN 10 WHEN 'NOUN' THEN 8 WHEN 'ADJ' THEN 6 WHEN 'ADP' THEN 3 WHEN 'PRON' THEN 0 ELSE 1 END AS r FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY graph, c ORDER BY e DESC, r DESC, (idx % 3 = 0) DESC, length(text) DESC, idx) AS k, count(*) OVER (PARTITION BY graph, c) AS n FROM m), "
    "b AS (SELECT graph, c, idx AS best, CASE WHEN pos IN ('VERB', 'AUX') THEN 'l_' || text ELSE text END AS given FROM o WHERE k = 1 AND n > 1) SELECT graph, idx, best AS \"primary\", CASE WHEN idx = best OR pos = 'PRON' THEN given END AS resolved FROM o JOIN b USING (graph, c)",
    "entity_levels": "WITH n(name, entity) AS (VALUES ('thing', 'CONCEPT'), ('PROMO', 'PRODUCT'), ('small', 'NOT_ENT'), ('Brand#2', 'ORG'), ('ECONOMY', 'ECONOMIC')), p AS (SELECT p_partkey AS id, unnest(['thing', p_type, p_brand, string_split(p_name, ' ')[1]]) AS name, unnest([0, 1, 2, 3]) AS depth FROM part), m AS (SELECT id, arg_max(entity, depth) FILTER (entity NOT IN ('CONCEPT', 'NOT_ENT')) AS a, arg_max(entity, depth) FILTER (entity <> 'CONCEPT') AS b FROM p JOIN n USING (name) GROUP BY 1) SELECT id, coalesce(a, 'CONCEPT') AS of_span, nullif(coalesce(b, 'CONCEPT'), 'NOT_ENT') AS of_token FROM m",
    "step_vertices": "WITH s AS (SELECT o_custkey AS instance, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS step FROM orders), o AS (SELECT *, list_filter([k % 7, k % 5, k % 11], lambda i: i <= 8) AS own, list_filter([k % 11], lambda i: i <= 8) AS ans FROM s), "
    "i AS (SELECT o.*, coalesce(p.ans, []) AS a, coalesce(q.ans, []) AS b FROM o LEFT JOIN o p ON p.instance = o.instance AND p.step = greatest(1, o.step - 1) AND p.step < o.step LEFT JOIN o q ON q.instance = o.instance AND q.step = 9 AND o.step > 9) SELECT instance, step, array_to_string(list_sort(list_distinct(list_concat(list_concat(own, a), b))), ',') AS ids FROM i",
    "group_links": "WITH g AS (SELECT DISTINCT l_orderkey % 500 AS g, l_partkey AS node FROM lineitem) SELECT x.g AS a, y.g AS b, min(node) AS bridge FROM g x JOIN g y USING (node) WHERE x.g < y.g GROUP BY 1, 2",
}
