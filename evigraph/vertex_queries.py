"""Registered queries of vertex predicates, texts of vertices and answers, and
matching rules, with DuckDB SQL: many functions of one kind in one query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import render, text, vertex
from .operators import match, metrics, retrieval

_TYPES = ("PERSON", "NORP", "GPE", "DATE", "MONEY", "LAW", "NOT_ENTITY", "PRODUCT")
_POSES = ("NOUN", "PROPN", "VERB", "AUX", "ADJ", "NUM", "PRON", "PUNCT")
_KINDS = ("PERSON", "COUNTRY", "CONCEPT", "NUMBER", "NOT_ENT", "TEMPORAL")


def _pick(names, number):
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def _vertices(s, d):
    """Parts as vertices: two entities, two parts of speech, a type each."""
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_name")
    k, n = F.col("p_partkey"), F.col("p_size")
    return p.select("p_partkey", F.col("p_name").alias("text"), F.array(_pick(_TYPES, k), _pick(_TYPES, n)).alias("ents"), F.array(_pick(_POSES, k + n), _pick(_POSES, n)).alias("poses"), F.array(_pick(_KINDS, k), _pick(_KINDS, n)).alias("kinds"), F.sequence(F.lit(0), (n % 3).cast("int")).alias("sources"))


def _pairs(s, d):
    v = _vertices(s, d)
    w = v.select((F.col("p_partkey") - 1).alias("p_partkey"), *[F.col(c).alias(f"{c}2") for c in ("text", "ents", "poses", "sources")])
    return v.join(w, "p_partkey")


def vertex_predicates(s, d):
    c = F.col
    return _vertices(s, d).select(
        "p_partkey",
        vertex.pos_range(c("poses"), F.lit("PROPN")).alias("noun_range"),
        vertex.ent_range(c("ents"), F.lit("NORP")).alias("person_range"),
        vertex.any_pos(c("poses"), "VERB", "AUX").alias("is_verb"),
        vertex.all_pos(c("poses"), "PRON").alias("is_pronoun"),
        vertex.vertex_type(c("kinds"), c("poses")).alias("vertex_type"),
        vertex.coarse(F.get("ents", 0)).alias("coarse"),
        vertex.level(F.get("kinds", 0)).alias("level"),
        vertex.is_critical(c("ents"), c("poses")).alias("critical"),
        render.is_valid_node(c("ents"), c("poses")).alias("valid"),
        render.is_content(c("poses"), F.lit(False)).alias("content"),
        render.should_refine(F.lit(None).cast("string"), c("poses"), F.lit(False)).alias("refine"),
        render.display(c("ents")).alias("shown"),
        render.type_label(F.lit(None).cast("string"), F.get("kinds", 0), F.get("poses", 0)).alias("label"),
        render.vertex_text(render.resolved_text(F.lit(""), F.when(c("p_partkey") % 2 == 0, "main"), F.lit("before"), c("text")), c("p_partkey") % 3 == 0).alias("name"),
    )


def vertex_pair_predicates(s, d):
    c = F.col
    return _pairs(s, d).select(
        "p_partkey",
        vertex.shared(c("ents"), c("ents2")).alias("same_ent"),
        vertex.shared(c("poses"), c("poses2")).alias("same_pos"),
        vertex.is_domain(c("ents"), c("ents2")).alias("domain"),
        vertex.same_provenance(c("sources"), c("sources2")).alias("provenance"),
        vertex.entities_compatible(c("ents"), c("ents2"), c("poses"), c("poses2")).alias("compatible"),
        F.round(vertex.match_confidence(c("text"), c("text2"), c("ents"), c("ents2"), c("poses"), c("poses2")), 3).alias("confidence"),
    )


def soft_matches(s, d):
    asked = F.when(F.col("p_partkey") % 4 == 0, _pick(("PERSON", "TIME", "LOCATION", "NUMBER", "WHAT", "ATTRIBUTE", "REASON", "BELONGS"), F.floor(F.col("p_partkey") / 4)))
    label = _pick(("entailment", "neutral", "contradiction"), F.col("p_partkey"))
    out = _pairs(s, d).select("p_partkey", match.soft_match(asked, F.col("text"), F.col("text2"), F.col("ents"), F.col("ents2"), F.col("poses2"), label).alias("a"), match.soft_match(asked, F.col("text"), F.col("text2"), F.col("ents"), F.col("ents2"), F.col("poses2"), label, True).alias("b"))
    return out.select("p_partkey", "a.allowed", "a.reason", F.col("b.allowed").alias("gated"))


def matched_vertices(s, d):
    """Nations are asked about, suppliers of the nation are data."""
    ents = F.array(F.lit("GPE"))
    q = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("instance"), F.col("n_nationkey").alias("vertex_id"), F.concat(F.lit("Supplier "), F.col("n_name")).alias("text"), ents.alias("ents"), F.lit(False).alias("virtual"))
    data = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("instance"), F.col("s_suppkey").alias("vertex_id"), F.col("s_name").alias("text"), F.when(F.col("s_suppkey") % 2 == 0, ents).otherwise(F.array(F.lit("DATE"))).alias("ents"), F.lit(False).alias("virtual"))
    return match.matched_vertices(q, data).select("instance", "u", "v", F.round("score", 6).alias("score"))


def simulation_quads(s, d):
    edges = s.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <= 2").select(F.lit(0).alias("instance"), F.col("l_orderkey").alias("edge"), F.col("l_suppkey").alias("vertex_id"))
    relation = s.read.parquet(f"{d}/supplier.parquet").select(F.lit(0).alias("instance"), F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("v"))
    return match.simulation_quads(edges, relation).select("u", "x", "v", "y")


def migrated_types(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    vertices = p.select(F.lit(0).alias("instance"), F.col("p_partkey").alias("vertex_id"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("type"))
    known = p.where("p_size > 40").select(F.lit(0).alias("instance"), F.upper("p_name").alias("text"), F.col("p_type").alias("type"), F.col("p_partkey").alias("place"))
    return match.migrate_types(vertices, known).select("vertex_id", "type", "change")


def canonical_types(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size")
    data = p.select(F.lit(0).alias("instance"), F.col("p_partkey").alias("vertex_id"), F.col("p_name").alias("text"), F.col("p_type").alias("type"))
    query = p.where("p_size = 7").select(F.lit(0).alias("instance"), F.upper("p_name").alias("text"), F.lower("p_type").alias("type"))
    return match.canonical_types(data, query).select("vertex_id", "type")


def vertices_of_nodes(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type")
    nodes = e.select(F.lit(0).alias("graph"), F.col("user_id").alias("vertex_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("text"), F.col("event_type").alias("pos"), (F.col("event_id") % 3).cast("string").alias("ent"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("query_type"), (F.col("event_id") % 4).alias("source"))
    out = match.vertices_of_nodes(nodes)
    return out.select("vertex_id", "text", F.array_join("poses", ",").alias("poses"), F.array_join("ents", ",").alias("ents"), "query_type", F.size("provenance").cast("long").alias("sources"))


def text_tools(s, d):
    t = F.col("text")
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.md5(render.fix_spacing(F.concat(t, F.lit(" end.of this!x")))).alias("spaced"),
        F.md5(render.without_reflection(F.concat(F.lit("[Relevant] "), t, F.lit("</s>[Utility:5]")))).alias("plain"),
        render.closed_answer(F.concat("role", F.lit(" yes")), "arc", F.lit("no yes user")).alias("closed"),
        render.closed_answer(F.when(F.col("turn") % 2 == 0, "SUPPORTS").otherwise("False"), "fever").alias("verdict"),
        F.md5(render.prompt(F.col("role"), t, "musique")).alias("prompt"),
        F.md5(render.between(t, F.substring(t, 3, 4), F.substring(t, -5, 3))).alias("between"),
        render.is_shorthand(F.concat(t, F.when(F.col("turn") % 2 == 0, " >> x").otherwise(""))).alias("shorthand"),
        F.md5(text.compact_prefix(t)).alias("prefix"),
        text.yes_no(F.concat(F.lit("well "), F.when(F.col("turn") % 2 == 0, "No, ").otherwise(""), F.lit("Yes"))).alias("judged"),
        F.md5(text.unwrap_tags(F.concat(F.lit("<a> "), t, F.lit(" <b c>")))).alias("unwrapped"),
        text.json_payload(F.concat(F.lit("so: "), F.when(F.col("turn") % 2 == 0, '{"k": 1}').otherwise("[1, 2]"))).alias("payload"),
        F.round(text.fuzzy_ratio(F.substring(F.md5(t), 1, 20), F.substring(F.md5(t), 3, 18)), 6).alias("fuzzy"),
        text.binary_label(F.col("role"), ("user",), "yes", "no").alias("binary"),
        text.resolve_placeholders(F.lit("#1 and #2 and #3"), F.array(F.col("role"), F.col("turn").cast("string"))).alias("placed"),
    )


def option_texts(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    texts = F.array("p_name", "p_brand", "p_type")
    lines = render.choice_lines(F.array(F.lit("1"), F.lit("B"), F.lit("3")), texts)
    answer = F.when(F.col("p_partkey") % 4 == 0, "B)").when(F.col("p_partkey") % 4 == 1, "3").when(F.col("p_partkey") % 4 == 2, F.upper("p_name")).otherwise("nothing")
    return p.select("p_partkey", render.instruction("Choose.", F.col("p_name"), lines).alias("prompt"), text.option_label(answer, F.array(F.lit("A"), F.lit("B"), F.lit("C")), texts).alias("chosen"))


def answer_scores(s, d):
    """Corpus means of exact match and containment, in percent."""
    t = s.read.parquet(f"{d}/conversations.parquet").select("role", "text")
    rows = t.select(text.exact_match(F.concat(F.lit("The "), "role"), F.lit("user")).alias("em"), text.answer_match(F.col("text"), F.array(F.lit("the"), F.lit(""), F.lit("on"))).alias("matched"))
    return metrics.corpus_means(rows, "em", "matched").select(F.round("em", 6).alias("em"), F.round("matched", 6).alias("matched"))


def timing_summary(s, d):
    return metrics.run_summary(s.read.parquet(f"{d}/events.parquet").select("event_type", F.col("value").cast("decimal(12,4)").alias("value")), "event_type", "value").select("event_type", "runs", F.col("total").cast("double").alias("total"), F.round(F.col("mean").cast("double"), 6).alias("mean"))


def first_hits(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumnRenamed("user_id", "question")
    return metrics.first_hit_counts(ranked.where("event_type = 'error'"), ranked, 20)


def rank_diagnostics(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    gold = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")) - 1).alias("g")
    listed = o.select("o_custkey", "o_orderkey", gold).groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "g"))), lambda x: x["g"]).alias("order"))
    return listed.select("o_custkey", metrics.inversions(F.col("order")).cast("long").alias("inversions"), F.round(metrics.mean_top(F.col("order"), 3), 6).alias("top"), metrics.last_gold(F.col("order"), 3).cast("long").alias("last"))


def preferred_order(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderpriority", "o_orderstatus")
    slices = o.groupBy(F.col("o_custkey").alias("instance"), F.col("o_orderpriority").alias("slice")).agg(F.count(F.lit(1)).alias("hits"))
    preferred = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("instance"), F.col("o_orderpriority").alias("slice"))
    return metrics.preferred_order(slices, preferred).select("instance", "slice", F.col("place").cast("long").alias("place"))


def graph_sizes(s, d):
    line = s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_returnflag")
    v = line.select(F.col("l_returnflag").alias("instance"), F.col("l_suppkey").alias("graph"))
    e = line.where("l_orderkey % 2 = 0").select(F.col("l_returnflag").alias("instance"), F.col("l_suppkey").alias("graph"))
    return metrics.mean_graph_sizes(v, e).select("instance", F.round("mean_vertices", 6).alias("mean_vertices"), F.round("mean_edges", 6).alias("mean_edges"))


def passages_met(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), "text")
    found = s.read.parquet(f"{d}/labels.parquet").select(F.col("quality").alias("query_id"), F.col("toxic").alias("rank"), F.col("doc_id").alias("id"))
    return retrieval.with_passages(found, docs).select("query_id", "rank", "id", F.md5(retrieval.passage_text(F.col("title"), F.col("text"), lower=True)).alias("embedded"))


def token_windows(s, d):
    """Chunks of ten tokens, and ids between begin and end with padding."""
    t = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").select("doc_id", text.tokens(F.col("text")).alias("w"))
    sizes = F.transform(F.slice("w", 1, 5), lambda w: F.length(w))
    ids, mask = retrieval.padded(retrieval.with_ends(sizes, 101, 102), 8)
    return t.select("doc_id", F.size(retrieval.token_chunks(F.col("w"), 10)).cast("long").alias("chunks"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"), F.size(F.filter(mask, lambda m: m)).cast("long").alias("filled"))


def ranking_metrics(s, d):
    e = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    ranked = e.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    judged = e.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("gain"))
    return retrieval.dcg_metrics(ranked, judged, 5).select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"), F.round("average_precision", 6).alias("average_precision"))


QUERIES = {f.__name__: f for f in (
    vertex_predicates, vertex_pair_predicates, soft_matches, matched_vertices, simulation_quads, migrated_types, canonical_types, vertices_of_nodes, text_tools, option_texts,
    answer_scores, timing_summary, first_hits, rank_diagnostics, preferred_order, graph_sizes, passages_met, token_windows, ranking_metrics,
)}

_SQL_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_V = (
    f"v AS (SELECT p_partkey, p_name AS text, [{_SQL_LIST(_TYPES)}[p_partkey % 8 + 1], {_SQL_LIST(_TYPES)}[p_size % 8 + 1]] AS ents, [{_SQL_LIST(_POSES)}[(p_partkey + p_size) % 8 + 1], {_SQL_LIST(_POSES)}[p_size % 8 + 1]] AS poses, "
    f"[{_SQL_LIST(_KINDS)}[p_partkey % 6 + 1], {_SQL_LIST(_KINDS)}[p_size % 6 + 1]] AS kinds, range(0, p_size % 3 + 1) AS sources FROM part)"
)
_LEVEL = "CASE {k} WHEN 'COUNTRY' THEN 5 WHEN 'PERSON' THEN 4 WHEN 'TEMPORAL' THEN 4 WHEN 'NUMBER' THEN 2 WHEN 'CONCEPT' THEN 1 ELSE 0 END"
_REAL = "list_filter({x}, lambda e: e <> 'NOT_ENTITY')"
_GROUPS = (("PERSON", "NORP"), ("GPE", "NORP"), ("DATE",), ("PRODUCT",), ("MONEY",), ("LAW",))
_PAIR = f"{_V}, p AS (SELECT a.*, b.text AS text2, b.ents AS ents2, b.poses AS poses2, b.sources AS sources2 FROM v a JOIN v b ON b.p_partkey = a.p_partkey + 1)"
_MEET = " OR ".join(f"(list_has_any(ents, {_SQL_LIST(g)}) AND list_has_any(ents2, {_SQL_LIST(g)}))" for g in _GROUPS)
# what counts as one with an entity is its first group
_DOMAIN = " OR ".join(f"(list_has_any(ents2, {_SQL_LIST(h)}) AND list_has_any(ents, {_SQL_LIST(g)}))" for g, h in ((("PERSON", "NORP"), ("PERSON", "NORP")), (("GPE", "NORP"), ("GPE",)), (("DATE",), ("DATE",)), (("PRODUCT",), ("PRODUCT",)), (("MONEY",), ("MONEY",)), (("LAW",), ("LAW",))))
_TOK = "regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{Z}}\\p{{C}}]')"

ORACLE_SQL = {
    "vertex_predicates": f"WITH {_V} SELECT p_partkey, list_has_any(poses, ['NOUN', 'PROPN', 'PRON']) AS noun_range, list_has_any(ents, ['PERSON', 'NORP']) AS person_range, list_has_any(poses, ['VERB', 'AUX']) AS is_verb, poses = ['PRON', 'PRON'] AS is_pronoun, "
    f"CASE WHEN kinds[1] = 'NOT_ENT' AND kinds[2] = 'NOT_ENT' THEN CASE WHEN list_contains(poses, 'NUM') THEN 'NUMBER' END WHEN kinds[2] <> 'NOT_ENT' AND (kinds[1] = 'NOT_ENT' OR {_LEVEL.format(k='kinds[2]')} >= {_LEVEL.format(k='kinds[1]')}) THEN kinds[2] ELSE kinds[1] END AS vertex_type, "
    f"CASE ents[1] WHEN 'NOT_ENTITY' THEN 'NOT_ENT' WHEN 'DATE' THEN 'TEMPORAL' WHEN 'MONEY' THEN 'NUMBER' ELSE ents[1] END AS coarse, {_LEVEL.format(k='kinds[1]')} AS level, len({_REAL.format(x='ents')}) > 0 OR list_has_any(poses, ['NOUN', 'PROPN']) AS critical, "
    "(poses[1] IN ('NOUN', 'PROPN') AND ents[1] NOT IN ('DATE', 'MONEY')) OR (poses[2] IN ('NOUN', 'PROPN') AND ents[2] NOT IN ('DATE', 'MONEY')) AS valid, NOT list_has_any(poses, ['VERB', 'AUX']) AS content, NOT list_has_any(poses, ['VERB', 'AUX', 'ADJ', 'ADV']) AS refine, "
    f"array_to_string({_REAL.format(x='ents')}, '|') AS shown, CASE WHEN poses[1] IN ('VERB', 'AUX') THEN NULL WHEN kinds[1] <> 'NOT_ENT' THEN kinds[1] WHEN poses[1] = 'ADJ' THEN 'ATTRIBUTE' END AS label, CASE WHEN p_partkey % 3 = 0 THEN '?' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN 'main' ELSE 'before' END AS name FROM v",
    "vertex_pair_predicates": f"WITH {_PAIR} SELECT p_partkey, list_has_any(ents, ents2) AS same_ent, list_has_any(poses, poses2) AS same_pos, len({_REAL.format(x='ents')}) > 0 AND len({_REAL.format(x='ents2')}) > 0 AND ({_DOMAIN}) AS domain, true AS provenance, "
    f"coalesce(({_REAL.format(x='ents')})[1], '') = coalesce(({_REAL.format(x='ents2')})[1], '') AND (len({_REAL.format(x='ents')}) > 0 OR (list_contains(poses, 'PROPN') AND list_contains(poses2, 'PROPN'))) AS compatible, "
    "round(CASE WHEN trim(text) = trim(text2) THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN list_has_any(ents, ents2) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN list_has_any(poses, poses2) THEN 0.2::DOUBLE ELSE 0 END, 3) AS confidence FROM p",
    "soft_matches": f"WITH {_PAIR}, q AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN ['PERSON','TIME','LOCATION','NUMBER','WHAT','ATTRIBUTE','REASON','BELONGS'][(p_partkey // 4) % 8 + 1] END AS asked, ['entailment','neutral','contradiction'][p_partkey % 3 + 1] AS label, {_MEET} AS meets, len({_REAL.format(x='ents')}) > 0 AND len({_REAL.format(x='ents2')}) > 0 AS typed FROM p), "
    "r AS (SELECT *, CASE asked WHEN 'PERSON' THEN list_has_any(ents2, ['PERSON', 'NORP']) WHEN 'TIME' THEN list_contains(ents2, 'DATE') WHEN 'LOCATION' THEN list_has_any(ents2, ['GPE', 'NORP']) WHEN 'NUMBER' THEN list_contains(ents2, 'MONEY') OR list_contains(poses2, 'NUM') WHEN 'BELONGS' THEN list_has_any(ents2, ['PERSON', 'NORP', 'GPE']) "
    f"WHEN 'WHAT' THEN len({_REAL.format(x='ents2')}) > 0 OR list_has_any(poses2, ['NOUN', 'PROPN', 'PRON']) WHEN 'ATTRIBUTE' THEN list_contains(poses2, 'ADJ') WHEN 'REASON' THEN NOT list_contains(poses2, 'PUNCT') END AS answered FROM q) "
    "SELECT p_partkey, CASE WHEN asked IS NOT NULL THEN answered WHEN typed THEN meets ELSE label <> 'contradiction' END AS allowed, CASE WHEN asked IS NOT NULL THEN 'query type' WHEN typed THEN 'entities' ELSE 'label' END AS reason, CASE WHEN asked IS NOT NULL THEN answered WHEN typed THEN meets AND label <> 'contradiction' ELSE label <> 'contradiction' END AS gated FROM r",
    "matched_vertices": f"WITH p AS (SELECT n_nationkey AS instance, n_nationkey AS u, s_suppkey AS v, list_distinct({_TOK.format(x='lower(s_name)')}) AS t, list_distinct({_TOK.format(x='''lower('Supplier ' || n_name)''')}) AS h FROM nation JOIN supplier ON s_nationkey = n_nationkey), c AS (SELECT *, len(list_intersect(t, h)) / len(h) AS score FROM p) SELECT instance, u, v, round(score, 6) AS score FROM c WHERE score >= 0.99 OR (score >= 0.2 AND v % 2 = 0)",
    "simulation_quads": "WITH e AS (SELECT DISTINCT l_orderkey AS edge, l_suppkey AS w FROM lineitem WHERE l_linenumber <= 2), p AS (SELECT DISTINCT a.w AS u, b.w AS x FROM e a JOIN e b USING (edge) WHERE a.w < b.w) SELECT u, x, s.s_nationkey AS v, t.s_nationkey AS y FROM p JOIN supplier s ON s.s_suppkey = u JOIN supplier t ON t.s_suppkey = x",
    "migrated_types": "WITH k AS (SELECT lower(trim(p_name)) AS key, arg_max(p_type, p_partkey) AS known FROM part WHERE p_size > 40 GROUP BY 1), v AS (SELECT p_partkey AS vertex_id, lower(trim(p_name)) AS key, CASE WHEN p_size % 3 = 0 THEN p_type END AS type FROM part) SELECT vertex_id, coalesce(known, type) AS type, CASE WHEN known IS NULL THEN 'unchanged' WHEN type IS NULL THEN 'filled' WHEN type <> known THEN 'fixed' ELSE 'unchanged' END AS change FROM v LEFT JOIN k USING (key)",
    "canonical_types": "WITH k AS (SELECT lower(trim(p_name)) AS key, min(lower(p_type)) AS forced FROM part WHERE p_size = 7 GROUP BY 1) SELECT p_partkey AS vertex_id, coalesce(forced, p_type) AS type FROM part LEFT JOIN k ON key = lower(trim(p_name))",
    "vertices_of_nodes": "SELECT user_id AS vertex_id, arg_min(event_type, event_id) AS text, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS poses, array_to_string(list_sort(list(DISTINCT (event_id % 3)::VARCHAR)), ',') AS ents, arg_min(event_type, event_id) FILTER (event_id % 5 = 0) AS query_type, count(DISTINCT event_id % 4) AS sources FROM events GROUP BY 1",
    "option_texts": "SELECT p_partkey, 'Choose.' || chr(10) || chr(10) || '### Input:' || chr(10) || p_name || chr(10) || 'A: ' || p_name || chr(10) || 'B: ' || p_brand || chr(10) || 'C: ' || p_type || chr(10) || 'D: ' AS prompt, CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' END AS chosen FROM part",
    "answer_scores": r"SELECT round(100 * avg((role = 'user')::INT), 6) AS em, round(100 * avg((contains(lower(text), 'the') OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}\p{M}_])on($|[^\p{L}\p{N}\p{M}_])'))::INT), 6) AS matched FROM conversations",
    "timing_summary": "SELECT event_type, count(*) AS runs, sum(value::DECIMAL(12,4))::DOUBLE AS total, round(sum(value::DECIMAL(12,4))::DOUBLE / count(*), 6) AS mean FROM events GROUP BY 1",
    "first_hits": "WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), f AS (SELECT user_id, min(r) AS first FROM e WHERE event_type = 'error' GROUP BY 1) SELECT k::INT AS k, (SELECT count(*) FROM f WHERE first <= k) AS n FROM range(1, 21) t(k)",
    "rank_diagnostics": "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), v AS (SELECT a.o_custkey, count(*) AS inversions FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.i < b.i AND a.g > b.g GROUP BY 1) SELECT o_custkey, coalesce(any_value(inversions), 0) AS inversions, round(count(*) FILTER (i <= 3 AND g < 3) / 3, 6) AS top, max(i) FILTER (g < 3) AS last FROM o LEFT JOIN v USING (o_custkey) GROUP BY 1",
    "preferred_order": "WITH s AS (SELECT o_custkey AS instance, o_orderpriority AS slice, count(*) AS hits, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY 1, 2) SELECT instance, slice, row_number() OVER (PARTITION BY instance ORDER BY hits DESC, NOT p, slice) AS place FROM s",
    "graph_sizes": "WITH g AS (SELECT l_returnflag AS instance, l_suppkey, count(*) AS v, count(*) FILTER (l_orderkey % 2 = 0) AS e FROM lineitem GROUP BY 1, 2) SELECT instance, round(avg(v), 6) AS mean_vertices, round(avg(e), 6) AS mean_edges FROM g GROUP BY 1",
    "passages_met": "SELECT quality AS query_id, toxic AS rank, doc_id AS id, md5(lower(CASE WHEN doc_id % 2 = 0 AND length(source) > 0 THEN source || ' ' ELSE '' END || text)) AS embedded FROM labels JOIN documents USING (doc_id)",
    "token_windows": f"WITH t AS (SELECT doc_id, {_TOK.format(x='text')} AS w FROM documents), i AS (SELECT doc_id, w, list_concat(list_concat([101], list_transform(w[1:5], lambda x: length(x))), [102]) AS ids FROM t) SELECT doc_id, ((len(w) + 9) // 10)::BIGINT AS chunks, array_to_string(list_concat(ids, list_transform(range(len(ids), 8), lambda x: 0)), ',') AS ids, len(ids)::BIGINT AS filled FROM i",
    "ranking_metrics": "WITH j AS (SELECT o_custkey AS q, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS gain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY gain DESC) AS n FROM j WHERE gain > 0), i AS (SELECT q, sum(gain / log2(n + 1)) FILTER (n <= 5) AS ideal, count(*) AS every FROM g GROUP BY 1), "
    "h AS (SELECT q, gain, r, row_number() OVER (PARTITION BY q ORDER BY r) AS nth FROM j WHERE gain > 0 AND r <= 5), s AS (SELECT q, sum(gain / log2(r + 1)) AS dcg, count(*) AS hits, sum(nth / r) AS ap FROM h GROUP BY 1) SELECT q AS query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(hits / every, 0), 6) AS recall, round(coalesce(ap / least(every, 5), 0), 6) AS average_precision FROM i LEFT JOIN s USING (q)",
    "text_tools": r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text || ' end.of this!x', '([\p{L}\p{N}\p{M}_])([.!?])([\p{L}\p{N}\p{M}_])', '\1\2 \3', 'g'), '([\p{L}\p{N}\p{M}_])([.!?])([\p{L}\p{N}\p{M}_])', '\1\2 \3', 'g')) AS spaced, md5(text) AS plain,
  CASE WHEN role = 'user' THEN 'user' ELSE 'yes' END AS closed, CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END AS verdict,
  md5('Answer from the passages, step by step.' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || role || chr(10) || '### Final Answer:') AS prompt,
  md5(CASE WHEN substr(text, 3, 4) <> substr(text, length(text) - 4, 3) AND strpos(text, substr(text, 3, 4)) < length(text) - strpos(reverse(text), reverse(substr(text, length(text) - 4, 3))) + 1 - 2
    THEN substr(text, strpos(text, substr(text, 3, 4)), length(text) - strpos(reverse(text), reverse(substr(text, length(text) - 4, 3))) + 2 - strpos(text, substr(text, 3, 4))) ELSE text END) AS between,
  turn % 2 = 0 OR contains(text, '>>') AS shorthand,
  md5(CASE WHEN trim(text) = '' THEN '' ELSE regexp_replace(array_to_string(list_slice(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), 1, 8), ' '), '[,.;:]+$', '') || ',' END) AS prefix,
  CASE WHEN turn % 2 = 0 THEN 'no' ELSE 'yes' END AS judged, md5(trim(regexp_replace(regexp_replace('<a> ' || text || ' <b c>', '<([^<>]*)>', '\1', 'g'), '\s+', ' ', 'g'))) AS unwrapped,
  CASE WHEN turn % 2 = 0 THEN '{"k": 1}' ELSE '[1, 2]' END AS payload,
  round(100 * (1 - levenshtein(substr(md5(text), 1, 20), substr(md5(text), 3, 18)) / 20), 6) AS fuzzy,
  CASE WHEN lower(trim(role)) = 'user' THEN 'yes' ELSE 'no' END AS binary, role || ' and ' || turn || ' and #3' AS placed FROM conversations""",
}
