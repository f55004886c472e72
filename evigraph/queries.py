"""Registered queries over the driver's tables, with DuckDB SQL where it can
say the same. Each shows one operator on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph_queries, span_queries, token_queries, vertex_queries
from .functions import text, vector, vertex
from .operators import build, fusion, graph, match, metrics, retrieval, simulation
from .plans import methods
from .sources import graphs


def _t(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").select(*columns)


def instance_id_md5(s, d):
    return _t(s, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", text.instance_id(F.col("text")).alias("instance_id"))


def clean_text(s, d):
    return _t(s, d, "documents", "doc_id", "text").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"), F.md5(text.normalize_special_chars(F.col("text"))).alias("unescaped"))


def normalize_answer(s, d):
    return _t(s, d, "documents", "doc_id", "text").select("doc_id", F.md5(text.normalize_answer(F.col("text"))).alias("normalised"))


def tokenize_counts(s, d):
    n = F.size(text.tokens(F.col("text")))
    return _t(s, d, "documents", "doc_id", "text").select("doc_id", n.cast("long").alias("n_tokens"))


def token_buckets(s, d):
    counted = _t(s, d, "documents", "text").select(metrics.token_bucket(F.size(text.tokens(F.col("text")))).alias("bucket"))
    return counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def has_answer(s, d):
    return _t(s, d, "documents", "doc_id", "text", "lang").select("doc_id", text.contains_tokens(F.col("text"), F.col("lang")).alias("found"))


def _turns(s, d):
    rows = _t(s, d, "conversations", "conv_id", "turn", "text")
    return rows.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")


def em_f1_match(s, d):
    p, t = F.col("text"), F.col("before")
    return _turns(s, d).select("conv_id", "turn", text.exact_match(p, t).alias("em"), F.round(text.token_f1(p, t), 6).alias("f1"), text.answer_match(p, F.array(t)).alias("matched"))


def postprocess_answer(s, d):
    return _t(s, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", text.postprocess_answer(F.col("text")).alias("p")).select("conv_id", "turn", "p.answer", "p.status", "p.fallback")


def dedup_keep_first(s, d):
    return metrics.keep_first(_t(s, d, "documents", "doc_id", "text"), "text", "doc_id").select("doc_id")


def confusion_prf(s, d):
    df = _t(s, d, "labels", "quality", "toxic").select((F.col("quality") == 0).alias("p"), (F.col("toxic") == 1).alias("g"))
    out = metrics.confusion(df, "p", "g")
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "negative_precision", "negative_recall", "negative_f1")])


def recall_at_k(s, d):
    events = _t(s, d, "events", "user_id", "event_id", "event_type", "ts")
    ranked = events.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumnRenamed("user_id", "question")
    return metrics.recall_at(ranked.where("event_type = 'error'"), ranked).select("k", F.round("recall", 6).alias("recall"))


def _typed(s, d):
    q = _t(s, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").alias("instance"), F.lit(0).cast("long").alias("vertex_id"), F.col("n_name").alias("text"), F.lit("GPE").alias("type"), F.array(F.lit("PROPN")).alias("poses"), F.lit(False).alias("virtual"), F.lit(None).cast("string").alias("query_type"))
    asked = q.withColumn("vertex_id", F.lit(1).cast("long")).withColumn("query_type", F.lit("PERSON"))
    side = lambda t, k, n, c, kind: _t(s, d, t, k, n, c).select(F.col(n).alias("instance"), F.col(k).alias("vertex_id"), F.col(c).alias("text"), F.lit(kind).alias("type"), F.array(F.lit("PROPN")).alias("poses"), F.lit(False).alias("virtual"))
    data = side("supplier", "s_suppkey", "s_nationkey", "s_name", "ORG").unionByName(side("customer", "c_custkey", "c_nationkey", "c_name", "PERSON"))
    return q.unionByName(asked), data


def hard_type_pairs(s, d):
    q, data = _typed(s, d)
    pairs = match.allowed_pairs(q, data, label=None)
    return pairs.select("instance", "u", "v", F.round("score", 6).alias("score"))


def strict_type_group(s, d):
    kind = F.when(F.col("p_size") > 40, "LAW").when(F.col("p_size") > 30, "PRODUCT").when(F.col("p_size") > 20, "NUMBER").when(F.col("p_size") > 10, "GPE")
    poses = F.when(F.col("p_type") == "PROMO", F.array(F.lit("VERB"))).when(F.col("p_type") == "MEDIUM", F.array(F.lit("ADJ"))).otherwise(F.array(F.lit("NOUN")))
    return _t(s, d, "part", "p_partkey", "p_size", "p_type").select("p_partkey", vertex.strict_type_group(kind, poses).alias("type_group"))


def top_b_per_vertex(s, d):
    lines = _t(s, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    pairs = lines.select(F.lit(0).alias("instance"), F.col("l_suppkey").alias("u"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("v"), F.col("l_extendedprice").alias("score"))
    return match.top_b(pairs.groupBy("instance", "u", "v").agg(F.max("score").alias("score")), 5).select("u", "v", "score", "rank")


def rank_with_ties(s, d):
    hits = _t(s, d, "orders", "o_custkey", "o_orderpriority", "o_orderkey").select(F.col("o_custkey").alias("instance"), F.col("o_orderpriority").alias("slice"), F.col("o_orderkey").alias("u"))
    return match.rank_slices(hits, hits, 2).select("instance", "slice", "hits", F.col("rank").cast("int").alias("rank"))


def vertex_provenance_slices(s, d):
    orders = _t(s, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    vertices = orders.groupBy(F.col("o_custkey").alias("vertex_id")).agg(F.collect_set("o_orderpriority").alias("provenance")).withColumn("instance", F.lit(0))
    pairs = orders.select(F.lit(0).alias("instance"), F.col("o_orderstatus").alias("u"), F.col("o_custkey").alias("v")).distinct()
    return match.provenance_slices(pairs, vertices).groupBy("slice", "u").agg(F.count(F.lit(1)).alias("n"))


def _tree(s, d):
    n, c = _t(s, d, "nation", "n_nationkey", "n_regionkey"), _t(s, d, "customer", "c_custkey", "c_nationkey")
    nation = n.select((F.col("n_nationkey") + 100).cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("parent"))
    customer = c.select((F.col("c_custkey") + 1000).alias("node"), (F.col("c_nationkey") + 100).cast("long").alias("parent"))
    return nation.unionByName(customer)


def _incidence(s, d):
    t = _tree(s, d)
    ends = F.explode(F.array("node", "parent")).alias("vertex")
    return t.select(F.lit(0).alias("graph"), F.col("node").alias("edge"), ends)


def _regions(s, d):
    return _t(s, d, "region", "r_regionkey").select(F.lit(0).alias("graph"), F.col("r_regionkey").cast("long").alias("src"))


def shortest_hyperpaths(s, d):
    return graph.shortest_hyperpaths(_incidence(s, d), _regions(s, d)).select("src", "dst", F.col("length").cast("long").alias("length"), F.array_join(F.transform("path", lambda e: e.cast("string")), ",").alias("path"))


def h_hop_neighbors(s, d):
    return graph.neighbours_within(_incidence(s, d), _regions(s, d), 1).select("src", "dst", F.col("hop").cast("long").alias("hop"))


def transitive_closure(s, d):
    return graph.transitive_closure(_tree(s, d).select(F.col("node").alias("src"), F.col("parent").alias("dst")))


def lca_pairs(s, d):
    c = _t(s, d, "customer", "c_custkey")
    pairs = c.select((F.col("c_custkey") + 1000).alias("a"), (F.col("c_custkey") + 1001).alias("b"))
    return graph.lowest_common_ancestors(_tree(s, d), pairs)


def merge_components(s, d):
    parts = _t(s, d, "part", "p_partkey", "p_name")
    near = parts.withColumn("before", F.lag("p_partkey").over(Window.partitionBy("p_name").orderBy("p_partkey")))
    return graph.components(near.where("before is not null").select(F.col("before").alias("a"), F.col("p_partkey").alias("b")))


def merge_graphs(s, d):
    parts = _t(s, d, "part", "p_partkey", "p_name", "p_size", "p_brand").select(F.col("p_partkey").alias("vertex_id"), F.col("p_name").alias("text"), F.col("p_brand").alias("source"), F.lit("PRODUCT").alias("type"), F.array(F.lit("PRODUCT")).alias("ents"), F.array(F.lit("NOUN")).alias("poses"))
    first = parts.groupBy("text").agg(F.min("vertex_id").alias("a"), F.count_distinct("source").alias("n"))
    links = parts.join(first, "text").where("n > 1 and a <> vertex_id").select("a", F.col("vertex_id").alias("b"))
    lines = _t(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select(F.col("l_orderkey").alias("edge"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("vertex"))
    _, merged, _ = fusion.merge_graphs(parts, lines, links)
    return merged.select("merged", "text", F.size("provenance").cast("long").alias("n_sources"))


def dmatch_aggregate(s, d):
    lines = _t(s, d, "lineitem", "l_returnflag", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    rows = lines.select(F.col("l_returnflag").alias("pair"), F.col("l_suppkey").alias("u"), F.col("l_linenumber").alias("v"), F.year("l_shipdate").alias("place"), (F.col("l_extendedprice") / 100_000).alias("score"))
    return match.dmatch_scores(rows, 0.7).select("pair", "u", "v", F.round("score", 9).alias("score"))


def greedy_one_to_one(s, d):
    lines = _t(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice")
    return match.greedy_one_to_one(lines.select(F.col("l_orderkey").alias("pair"), F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.col("l_extendedprice").alias("score")))


def _next_vectors(s, d):
    v = _t(s, d, "embeddings", "vec_id", "embedding")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


def cosine_threshold_pairs(s, d):
    scored = _next_vectors(s, d).select("vec_id", vector.cosine(F.col("embedding"), F.col("other")).alias("score"))
    return scored.where("score >= 0.1").select("vec_id", F.round("score", 5).alias("score"))


def hoyer_score(s, d):
    return _next_vectors(s, d).select("vec_id", F.round(vector.hoyer(F.col("embedding"), F.col("other")), 5).alias("hoyer"))


def _queries(s, d):
    return _t(s, d, "embeddings", "vec_id", "embedding").where("vec_id % 100 = 0")


def knn_exact(s, d):
    found = retrieval.exact_neighbours(_queries(s, d), _t(s, d, "embeddings", "vec_id", "embedding"), 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("score", 5).alias("score"))


def knn_cells(s, d):
    vectors = _t(s, d, "embeddings", "vec_id", "embedding")
    centres = retrieval.fit_cells(vectors, 16, 3)
    return retrieval.cell_neighbours(_queries(s, d), retrieval.assign_cells(vectors, centres), centres, 5, probes=10)


def context_trim_antijoin(s, d):
    orders = _t(s, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    ctx = orders.select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("ctx"), "o_orderpriority", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"))
    near = ctx.withColumn("i", F.lag("ctx").over(Window.partitionBy("question", "o_orderpriority").orderBy("ctx")))
    related = near.where("i is not null").select("question", "i", F.col("ctx").alias("j"))
    return retrieval.trim_contexts(ctx.drop("o_orderpriority"), related).select("question", "ctx")


def evidence_stats(s, d):
    events = _t(s, d, "events", "user_id", "event_type", "value")
    matches = events.where("event_type <> 'view'").select(F.col("user_id").alias("evidence"), F.least(F.lit(1.0), F.col("value") / 20).alias("confidence"))
    out = fusion.evidence_stats(events.select(F.col("user_id").alias("evidence")), matches)
    return out.select("evidence", "n", F.round("mean", 12).alias("mean"), "band")


def evidence_conflicts(s, d):
    events = _t(s, d, "events", "user_id", "event_type", "value")
    return fusion.conflicts(events.select(F.col("user_id").alias("query_text"), F.col("event_type").alias("answer"), (F.col("value") / 20).alias("confidence")))


def evidence_coverage(s, d):
    orders = _t(s, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    out = fusion.coverage(orders.select(F.col("o_custkey").alias("instance"), F.col("o_orderpriority").alias("component"), (F.col("o_orderstatus") == "F").alias("matched")))
    return out.select("instance", "covered", "total", F.array_join("missing", ",").alias("missing"))


def structured_context(s, d):
    events = _t(s, d, "events", "user_id", "event_id", "event_type", "value")
    return fusion.structured_context(events.select(F.col("user_id").alias("instance"), F.col("event_type").alias("evidence"), F.concat(F.lit("e"), "event_id").alias("query_text"), F.col("event_type").alias("answer"), F.least(F.lit(1.0), F.col("value") / 20).alias("confidence")))


def supporting_span(s, d):
    return _t(s, d, "documents", "doc_id", "text", "lang").select("doc_id", fusion.supporting_span(F.col("lang"), F.col("text")).alias("span"))


def chunk_split(s, d):
    parts = build.split_chunks(_t(s, d, "documents", "doc_id", "text"), "text", 3)
    return parts.select("doc_id", F.size("chunks").alias("n_chunks"), (F.array_join("chunks", "") == F.col("text")).alias("whole"))


def record_parse(s, d):
    row = F.concat(F.lit('("entity", "'), F.col("user_id").cast("string"), F.lit('", "user", "someone");("relationship", "'), F.col("user_id").cast("string"), F.lit('", "'), F.col("event_type"), F.lit('", "did", "at a time");<END_OUTPUT>("entity", "x", "y", "z");'))
    _, edges = build.parse_records(_t(s, d, "events", "user_id", "event_type").select(row.alias("text")))
    return edges


def resume_skip(s, d):
    return graphs.not_yet_done(_t(s, d, "documents", "doc_id"), _t(s, d, "labels", "doc_id"), "doc_id")


def sampling_weights(s, d):
    return metrics.sampling_weights(_t(s, d, "documents", "source"), "source", 0.5).select("source", F.round("weight", 9).alias("weight"))


def weighted_mean(s, d):
    return metrics.weighted_mean(_t(s, d, "lineitem", "l_returnflag", "l_discount", "l_quantity"), "l_returnflag", "l_discount", "l_quantity").select("l_returnflag", F.round("mean", 9).alias("mean"))


def tie_adjusted_rank(s, d):
    ranked = metrics.tie_adjusted_ranks(_t(s, d, "orders", "o_custkey", "o_orderstatus", "o_orderkey"), "o_custkey", "o_orderstatus", "o_orderkey")
    return ranked.select("o_orderkey", F.col("place").cast("int").alias("place"), F.col("tie_rank").cast("int").alias("tie_rank"))


def bounded_simulation(s, d):
    """Query: a BUILDING customer with an urgent order of a PROMO part, against
    all customers, orders and parts; slices are nations, ranked with ties."""
    c, o = _t(s, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), _t(s, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    line, p = _t(s, d, "lineitem", "l_orderkey", "l_partkey"), _t(s, d, "part", "p_partkey", "p_type")
    one = lambda df, key, u, cond, tag: df.where(cond).select(F.lit(0).alias("instance"), F.lit(u).alias("u"), F.concat(F.lit(tag), key).alias("v"))
    allowed = one(c, "c_custkey", 0, "c_mktsegment = 'BUILDING'", "c").unionByName(one(o, "o_orderkey", 1, "o_orderpriority = '1-URGENT'", "o")).unionByName(one(p, "p_partkey", 2, "p_type = 'PROMO'", "p"))
    arc = lambda df, a, b, ta, tb: df.select(F.lit(0).alias("instance"), F.concat(F.lit(ta), a).alias("src"), F.concat(F.lit(tb), b).alias("dst"))
    arcs = arc(o, "o_custkey", "o_orderkey", "c", "o").unionByName(arc(line, "l_orderkey", "l_partkey", "o", "p"))
    query = s.createDataFrame([(0, 0, 1), (0, 1, 2)], "instance int, src int, dst int")
    pairs = simulation.bounded_simulation(allowed, query, arcs, bound=1)
    nations = c.select(F.lit(0).alias("instance"), F.concat(F.lit("c"), "c_custkey").alias("vertex_id"), F.array("c_nationkey").alias("provenance"))
    slices = match.provenance_slices(pairs.where("u = 0"), nations).select("instance", "slice", F.col("v").alias("u"))
    return match.rank_slices(slices, slices, 5).select("slice", "hits", F.col("rank").cast("int").alias("rank"))


def bounded_two_hops(s, d):
    """Query: a BUILDING customer within two arcs of a PROMO part."""
    c, o = _t(s, d, "customer", "c_custkey", "c_mktsegment"), _t(s, d, "orders", "o_orderkey", "o_custkey")
    line, p = _t(s, d, "lineitem", "l_orderkey", "l_partkey"), _t(s, d, "part", "p_partkey", "p_type")
    one = lambda df, key, u, cond, tag: df.where(cond).select(F.lit(0).alias("instance"), F.lit(u).alias("u"), F.concat(F.lit(tag), key).alias("v"))
    arc = lambda df, a, b, ta, tb: df.select(F.lit(0).alias("instance"), F.concat(F.lit(ta), a).alias("src"), F.concat(F.lit(tb), b).alias("dst"))
    allowed = one(c, "c_custkey", 0, "c_mktsegment = 'BUILDING'", "c").unionByName(one(p, "p_partkey", 1, "p_type = 'PROMO'", "p"))
    arcs = arc(o, "o_custkey", "o_orderkey", "c", "o").unionByName(arc(line, "l_orderkey", "l_partkey", "o", "p"))
    query = s.createDataFrame([(0, 0, 1)], "instance int, src int, dst int")
    return simulation.bounded_simulation(allowed, query, arcs, bound=2).select("u", "v")


def edge_simulation(s, d):
    """Order lines as query edges: u is a supplier, v a part; matches are lines
    with a discount; a pair stays if all suppliers of some order are matched."""
    lines = _t(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_discount")
    edges = lines.select(F.lit(0).alias("instance"), F.col("l_orderkey").alias("edge"), F.col("l_suppkey").alias("u"))
    matched = lines.select(F.lit(0).alias("instance"), F.col("l_orderkey").alias("edge"), F.col("l_orderkey").alias("sc"), F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"))
    allowed = lines.where("l_discount > 0.02").select(F.lit(0).alias("instance"), F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"))
    return simulation.edge_simulation(allowed, edges, matched).select("u", "v")


def rule_graph(s, d):
    vertices, _ = build.rule_graph(_t(s, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("graph"), "text"))
    return vertices.groupBy("graph").agg(F.count(F.lit(1)).alias("n_vertices"), F.count("type").alias("n_numbers"))


def _instances(s, d):
    return _turns(s, d).select(F.col("conv_id").alias("instance"), F.col("turn").alias("doc"), F.col("before").alias("query"), "text")


def _method(name):
    def query(s, d):
        return methods.apply_method(name, _instances(s, d)).select("instance", "doc", F.md5("query").alias("query"), F.md5("text").alias("text"))

    query.__name__ = f"method_{name}"
    return query


QUERIES = {f.__name__: f for f in (
    instance_id_md5, clean_text, normalize_answer, tokenize_counts, token_buckets, has_answer, em_f1_match, postprocess_answer,
    dedup_keep_first, confusion_prf, recall_at_k, hard_type_pairs, strict_type_group, top_b_per_vertex, rank_with_ties,
    vertex_provenance_slices, shortest_hyperpaths, h_hop_neighbors, transitive_closure, lca_pairs, merge_components, merge_graphs,
    dmatch_aggregate, greedy_one_to_one, cosine_threshold_pairs, hoyer_score, knn_exact, knn_cells, context_trim_antijoin,
    evidence_stats, evidence_conflicts, evidence_coverage, structured_context, supporting_span, chunk_split, record_parse,
    resume_skip, sampling_weights, weighted_mean, tie_adjusted_rank, bounded_simulation, bounded_two_hops, edge_simulation, rule_graph,
    *map(_method, methods.METHODS),
)} | token_queries.QUERIES | vertex_queries.QUERIES | span_queries.QUERIES | graph_queries.QUERIES

_TREE = "tree AS (SELECT (n_nationkey + 100)::BIGINT AS node, n_regionkey::BIGINT AS parent FROM nation UNION ALL SELECT c_custkey + 1000, (c_nationkey + 100)::BIGINT FROM customer)"
_NEXT = "n AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"

ORACLE_SQL = {
    "instance_id_md5": r"SELECT conv_id, turn, substr(md5(lower(regexp_replace(text, '\s+', '', 'g'))), 1, 16) AS instance_id FROM conversations",
    "clean_text": r"SELECT doc_id, md5(translate(trim(regexp_replace(regexp_replace(text, '\[n\s+\d+\]', '', 'g'), '\s+', ' ', 'g')), '–—―', '---')) AS cleaned, md5(trim(regexp_replace(regexp_replace(text, '\\[nrtvfba]|[\n\r\t\x0B\f\x08\x07]', ' ', 'g'), '\s+', ' ', 'g'))) AS unescaped FROM documents",
    "tokenize_counts": r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'))::BIGINT AS n_tokens FROM documents",
    "token_buckets": r"SELECT CASE WHEN n <= 1000 THEN 1000 WHEN n <= 2000 THEN 2000 WHEN n <= 3000 THEN 3000 WHEN n <= 4000 THEN 4000 WHEN n <= 5000 THEN 5000 END AS bucket, count(*) AS n FROM (SELECT len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]')) AS n FROM documents) GROUP BY 1",
    "has_answer": r"SELECT doc_id, list_contains(list_transform(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'), lambda x: lower(x)), lang) AS found FROM documents",
    "dedup_keep_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(text)",
    "confusion_prf": "WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 1 AND toxic = 0) AS tn FROM labels), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fn, 0), 0) AS np, coalesce(tn / nullif(tn + fp, 0), 0) AS nr FROM c) SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(np, 6) AS negative_precision, round(nr, 6) AS negative_recall, round(coalesce(2 * np * nr / nullif(np + nr, 0), 0), 6) AS negative_f1 FROM r",
    "recall_at_k": "WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), f AS (SELECT user_id, min(r) FILTER (event_type = 'error') AS first FROM e GROUP BY 1) SELECT k::INT AS k, round(count(*) FILTER (first <= k) / count(*), 6) AS recall FROM f, (VALUES (5), (10), (20), (100)) AS t(k) GROUP BY k",
    "hard_type_pairs": "SELECT n_nationkey AS instance, 0::BIGINT AS u, s_suppkey AS v, 0.0::DOUBLE AS score FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE false UNION ALL SELECT n_nationkey, 0, s_suppkey, round(len(list_intersect(list_distinct(regexp_extract_all(lower(s_name), '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]')), list_distinct(regexp_extract_all(lower(n_name), '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]')))) / len(list_distinct(regexp_extract_all(lower(n_name), '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]'))), 6) FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey, 1, c_custkey, round(len(list_intersect(list_distinct(regexp_extract_all(lower(c_name), '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]')), list_distinct(regexp_extract_all(lower(n_name), '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]')))) / len(list_distinct(regexp_extract_all(lower(n_name), '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]'))), 6) FROM nation JOIN customer ON c_nationkey = n_nationkey",
    "strict_type_group": "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'VERB_GROUP' WHEN p_size > 40 THEN 'ENT::LAW' WHEN p_size > 30 THEN 'PRODUCT_GROUP' WHEN p_size > 20 THEN 'NUMBER_GROUP' WHEN p_size > 10 THEN 'LOC_ORG_GROUP' WHEN p_type = 'MEDIUM' THEN 'NO_ENT_ADJ_GROUP' ELSE 'NO_ENT_OTHER' END AS type_group FROM part",
    "top_b_per_vertex": "WITH p AS (SELECT l_suppkey AS u, l_orderkey * 10 + l_linenumber AS v, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2) SELECT u, v, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS rank FROM p) WHERE rank <= 5",
    "rank_with_ties": "WITH h AS (SELECT o_custkey AS instance, o_orderpriority AS slice, count(*) AS hits FROM orders GROUP BY 1, 2) SELECT instance, slice, hits, rank::INT AS rank FROM (SELECT *, rank() OVER (PARTITION BY instance ORDER BY hits DESC) AS rank FROM h) WHERE rank <= 2",
    "vertex_provenance_slices": "SELECT p.slice, s.u, count(*) AS n FROM (SELECT DISTINCT o_custkey AS v, o_orderpriority AS slice FROM orders) p JOIN (SELECT DISTINCT o_custkey AS v, o_orderstatus AS u FROM orders) s USING (v) GROUP BY 1, 2",
    "shortest_hyperpaths": f"WITH {_TREE} SELECT parent AS src, node AS dst, 1::BIGINT AS length, node::VARCHAR AS path FROM tree WHERE parent < 100 UNION ALL SELECT b.parent, a.node, 2, b.node || ',' || a.node FROM tree a JOIN tree b ON a.parent = b.node",
    "h_hop_neighbors": f"WITH {_TREE} SELECT parent AS src, node AS dst, 1::BIGINT AS hop FROM tree WHERE parent < 100",
    "transitive_closure": f"WITH {_TREE} SELECT node AS src, parent AS dst FROM tree UNION SELECT a.node, b.parent FROM tree a JOIN tree b ON a.parent = b.node",
    "lca_pairs": "SELECT a.c_custkey + 1000 AS a, a.c_custkey + 1001 AS b, CASE WHEN a.c_nationkey = b.c_nationkey THEN (a.c_nationkey + 100)::BIGINT WHEN x.n_regionkey = y.n_regionkey THEN x.n_regionkey::BIGINT END AS lca FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1 LEFT JOIN nation x ON x.n_nationkey = a.c_nationkey LEFT JOIN nation y ON y.n_nationkey = b.c_nationkey",
    "merge_components": "SELECT p_partkey AS id, m AS component FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS m, count(*) OVER (PARTITION BY p_name) AS n FROM part) WHERE n > 1",
    "merge_graphs": "SELECT min(p_partkey) AS merged, p_name AS text, count(DISTINCT p_brand) AS n_sources FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1 UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1)",
    "dmatch_aggregate": "SELECT pair, u, v, round(avg(best), 9) AS score FROM (SELECT l_returnflag AS pair, l_suppkey AS u, l_linenumber AS v, year(l_shipdate) AS place, max(l_extendedprice / 100000) AS best FROM lineitem GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING avg(best) > 0.7",
    "cosine_threshold_pairs": f"WITH {_NEXT} SELECT vec_id, round(list_cosine_similarity(x, y), 5) AS score FROM n WHERE list_cosine_similarity(x, y) >= 0.1",
    "hoyer_score": f"WITH {_NEXT}, g AS (SELECT vec_id, list_transform(list_zip(x, y), lambda p: p[1] - p[2]) AS g FROM n) SELECT vec_id, round((sqrt(len(g)) - list_sum(list_transform(g, lambda e: abs(e))) / sqrt(list_sum(list_transform(g, lambda e: e * e)))) / (sqrt(len(g)) - 1), 5) AS hoyer FROM g",
    "knn_exact": "SELECT query_id, rank::INT AS rank, vec_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 5",
    "context_trim_antijoin": "WITH c AS (SELECT o_custkey AS question, o_orderkey AS ctx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders) SELECT question, ctx FROM c WHERE rank <= 30 AND nth = 1",
    "evidence_stats": "WITH c AS (SELECT user_id AS evidence, count(*) FILTER (event_type <> 'view') AS n, sum(least(1.0::DOUBLE, value / 20)::DECIMAL(20,10)) FILTER (event_type <> 'view')::DOUBLE AS s FROM events GROUP BY 1) SELECT evidence, n, round(coalesce(s / nullif(n, 0), 0), 12) AS mean, CASE WHEN s / nullif(n, 0) >= 0.8 THEN 'high' WHEN s / nullif(n, 0) >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM c",
    "evidence_conflicts": "SELECT user_id AS query_text, count(*) AS n, count(DISTINCT event_type) FILTER (value / 20 >= 0.5) AS answers FROM events GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT event_type) FILTER (value / 20 >= 0.5) >= 2",
    "evidence_coverage": "WITH c AS (SELECT o_custkey AS instance, o_orderpriority AS c, bool_or(o_orderstatus = 'F') AS hit FROM orders GROUP BY 1, 2) SELECT instance, count(*) FILTER (hit) AS covered, count(*) AS total, coalesce(string_agg(c, ',' ORDER BY c) FILTER (NOT hit), '') AS missing FROM c GROUP BY 1",
    "record_parse": "SELECT DISTINCT user_id::VARCHAR AS src, event_type AS dst, 'did' AS type, 'at a time' AS desc FROM events",
    "resume_skip": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "sampling_weights": "WITH c AS (SELECT source, sqrt(count(*)) AS w FROM documents GROUP BY 1) SELECT source, round(w / sum(w) OVER (), 9) AS weight FROM c",
    "weighted_mean": "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem WHERE l_quantity > 0 GROUP BY 1",
    "tie_adjusted_rank": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderkey)::INT AS place, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC)::INT AS tie_rank FROM orders",
    "bounded_two_hops": "SELECT DISTINCT 0 AS u, 'c' || c_custkey AS v FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND p_type = 'PROMO' UNION ALL SELECT 1, 'p' || p_partkey FROM part WHERE p_type = 'PROMO'",
    "bounded_simulation": "WITH po AS (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT' AND p_type = 'PROMO'), h AS (SELECT c_nationkey AS slice, count(*) AS hits FROM customer JOIN po ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1) SELECT slice, hits, rank::INT AS rank FROM (SELECT *, rank() OVER (ORDER BY hits DESC) AS rank FROM h) WHERE rank <= 5",
} | token_queries.ORACLE_SQL | vertex_queries.ORACLE_SQL | span_queries.ORACLE_SQL | graph_queries.ORACLE_SQL

_WORD = r"\p{L}\p{N}\p{M}_"
_ARTICLE = rf"([^{_WORD}]|^)(a|an|the)([^{_WORD}]|$)"
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '{a}', '\1 \3', 'g'), '{a}', '\1 \3', 'g'), '\s+', ' ', 'g'))"


def _normal(x: str) -> str:
    return _NORMAL.replace("{x}", x).replace("{a}", _ARTICLE).replace("{{", "{").replace("}}", "}")


_TURNS = "t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), i AS (SELECT * FROM t WHERE before IS NOT NULL)"
_TOKENS = r"list_distinct(regexp_extract_all(lower({x}), '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'))"


def _score(premise: str, hypothesis: str) -> str:
    p, h = _TOKENS.replace("{x}", premise), _TOKENS.replace("{x}", hypothesis)
    return f"(CASE WHEN len({h}) = 0 THEN 0 ELSE len(list_intersect({p}, {h})) / len({h}) END)"


def _label(premise: str, hypothesis: str) -> str:
    s = _score(premise, hypothesis)
    return f"(CASE WHEN {s} >= 0.99 THEN 'entailment' WHEN {s} >= 0.2 THEN 'neutral' ELSE 'contradiction' END)"


_BARE = r"trim(replace(replace(text, '</s>', ''), '</think>', ''), E' \t\n\r\f\x0b')"
_EDGE = """ .,;:!?"''"""

ORACLE_SQL |= {
    "normalize_answer": f"SELECT doc_id, md5({_normal('text')}) AS normalised FROM documents",
    "em_f1_match": f"WITH {_TURNS}, n AS (SELECT *, {_normal('text')} AS p, {_normal('before')} AS g FROM i), w AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS pw, list_filter(string_split(g, ' '), lambda x: x <> '') AS gw FROM n), "
    "c AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(list_distinct(pw), list_distinct(gw)), lambda t: least(len(list_filter(pw, lambda x: x = t)), len(list_filter(gw, lambda x: x = t))))), 0)::BIGINT AS same FROM w) "
    "SELECT conv_id, turn, p = g AS em, CASE WHEN same = 0 THEN 0::DOUBLE ELSE round(2 * (same / len(pw)) * (same / len(gw)) / (same / len(pw) + same / len(gw)), 6) END AS f1, (length(before) > 2 AND contains(lower(text), lower(before)))::INT AS matched FROM c",
    "postprocess_answer": f"WITH b AS (SELECT conv_id, turn, coalesce(text, '') AS text, {_BARE} AS bare FROM conversations), l AS (SELECT *, list_filter(list_transform(string_split(bare, chr(10)), lambda x: trim(x, E' \\t\\r\\f\\x0b')), lambda x: x <> '' AND length(x) < 100 AND NOT regexp_matches(lower(x), 'step|reason|explain|note|context|paragraph|think|analysis|conclusion') AND NOT starts_with(x, '#') AND trim(x, '{_EDGE}') <> '') AS lines FROM b) "
    f"SELECT conv_id, turn, CASE WHEN text = '' THEN 'unanswerable' WHEN len(lines) > 0 THEN trim(lines[-1], '{_EDGE}') WHEN substr(trim(bare, '{_EDGE}'), 1, 200) = '' THEN 'unanswerable' ELSE substr(trim(bare, '{_EDGE}'), 1, 200) END AS answer, CASE WHEN text = '' THEN 'empty_input' WHEN len(lines) > 0 THEN 'parsed_last_line' ELSE 'fallback_truncated' END AS status, text = '' OR len(lines) = 0 AS fallback FROM l",
    "structured_context": "WITH m AS (SELECT user_id AS instance, event_type AS evidence, 'e' || event_id AS q, least(1.0::DOUBLE, value / 20) AS c FROM events), l AS (SELECT *, '- ' || q || ': ' || evidence || ' (' || round(c::DECIMAL(20,10), 2)::DECIMAL(12,2)::VARCHAR || ')' AS line FROM m), e AS (SELECT instance, evidence, sum(c::DECIMAL(20,10))::DOUBLE / count(*) AS mean, count(*) AS n, string_agg(line, chr(10) ORDER BY c DESC, line) AS body FROM l GROUP BY 1, 2) "
    "SELECT instance, string_agg('[' || evidence || '] mean ' || round(mean::DECIMAL(20,10), 2)::DECIMAL(12,2)::VARCHAR || ', ' || n || ' matches' || chr(10) || body, chr(10) ORDER BY mean DESC, n DESC, evidence) AS context FROM e GROUP BY 1",
    "supporting_span": "WITH a AS (SELECT doc_id, text, trim(lang) AS needle, CASE WHEN trim(lang) = '' THEN 0 ELSE strpos(text, trim(lang)) END AS p FROM documents), s AS (SELECT *, trim(substr(text, greatest(1, p - 50), p + length(needle) + 50 - greatest(1, p - 50))) AS span FROM a) SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN length(span) <= 200 THEN span ELSE substr(span, 1, 200) || '...' END WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 100) || '...' END AS span FROM s",
    "chunk_split": r"WITH c AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''), l AS (SELECT *, lead(ch) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM c), e AS (SELECT doc_id, n, i FROM l WHERE ch IN ('.', '!', '?') AND nx IS NOT NULL AND regexp_matches(nx, '[ \t\n\x0B\f\r]')), "
    "o AS (SELECT doc_id, arg_min(i, (abs(i - n / 3.0) * 3, i)) AS one FROM e GROUP BY 1), w AS (SELECT e.doc_id, arg_min(i, (abs(i - n * 2 / 3.0) * 3, i)) AS two FROM e JOIN o USING (doc_id) WHERE i > one GROUP BY 1) SELECT doc_id, (1 + (one IS NOT NULL)::INT + (two IS NOT NULL)::INT)::INT AS n_chunks, true AS whole FROM documents LEFT JOIN o USING (doc_id) LEFT JOIN w USING (doc_id)",
    "rule_graph": r"WITH w AS (SELECT doc_id AS graph, unnest(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]')) AS w FROM documents), v AS (SELECT DISTINCT graph, lower(w) AS w FROM w WHERE length(w) >= 4 OR regexp_full_match(w, '[0-9]+') OR lower(w) IN ('who', 'whose', 'what', 'which', 'when', 'where', 'why', 'how')) SELECT graph, count(*) AS n_vertices, count(*) FILTER (regexp_full_match(w, '[0-9]+')) AS n_numbers FROM v GROUP BY 1",
    "greedy_one_to_one": "WITH RECURSIVE s AS (SELECT l_orderkey AS pair, l_suppkey AS u, l_partkey AS v, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_partkey) AS k FROM lineitem), "
    "r AS (SELECT pair, k, u, v, score, true AS kept, [u] AS us, [v] AS vs FROM s WHERE k = 1 UNION ALL SELECT s.pair, s.k, s.u, s.v, s.score, NOT (list_contains(us, s.u) OR list_contains(vs, s.v)), CASE WHEN list_contains(us, s.u) OR list_contains(vs, s.v) THEN us ELSE list_append(us, s.u) END, CASE WHEN list_contains(us, s.u) OR list_contains(vs, s.v) THEN vs ELSE list_append(vs, s.v) END FROM r JOIN s ON s.pair = r.pair AND s.k = r.k + 1) SELECT pair, u, v, score FROM r WHERE kept",
    "method_vanilla": f"WITH {_TURNS} SELECT conv_id AS instance, turn AS doc, md5(before) AS query, md5(text) AS text FROM i",
    "method_contradoc": f"WITH {_TURNS} SELECT conv_id AS instance, turn AS doc, md5(before) AS query, md5(CASE WHEN {_label('text', 'before')} = 'contradiction' THEN '[CONTRADICTED] ' ELSE '' END || text) AS text FROM i",
    "method_cdit": f"WITH {_TURNS}, h AS (SELECT *, {_score('text', 'before')} >= 0.5 AS hit FROM i), m AS (SELECT *, bool_or(hit) OVER (PARTITION BY conv_id) AS any_hit FROM h) SELECT conv_id AS instance, turn AS doc, md5(before) AS query, md5(text) AS text FROM m WHERE hit OR NOT any_hit",
    "method_sentli": f"WITH {_TURNS} SELECT conv_id AS instance, turn AS doc, md5(before) AS query, md5('[SENTLI: ' || {_label('substr(text, 1, 512)', 'before')} || '] ' || text) AS text FROM i",
}
