"""Registered queries of the passes over token tables, with DuckDB SQL.

Events serve as tokens: a user's events are a sentence, and the token at place
i hangs from the one at (i - 1) / 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import vertex
from .operators import clusters, dependency

_DEPS = ("conj", "nsubj", "prep", "pobj", "relcl", "appos", "amod", "agent")
_POSES = ("NOUN", "VERB", "ADJ", "PRON", "PUNCT", "AUX", "ADP")


def _listed(names: tuple[str, ...], number) -> object:
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    staged = events.withColumn("idx", idx)
    i, e = F.col("idx"), F.col("event_id")
    head = F.when(i > 0, F.floor((i - 1) / 2).cast("long"))
    dep = F.when(i == 0, "ROOT").otherwise(_listed(_DEPS, e))
    ent = F.when(e % 11 == 0, "PERSON").otherwise(vertex.NONE)
    start = (F.floor(i / 8) * 8).cast("long")
    return staged.select(F.col("user_id").alias("graph"), "idx", F.concat("event_type", (e % 3).cast("string")).alias("text"), _listed(_POSES, e).alias("pos"), dep.alias("dep"), head.alias("head"), ent.alias("ent"), start.alias("sent_start"), (start + 8).alias("sent_end"))


_TOKENS = (
    "e AS (SELECT user_id AS graph, event_id AS e, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events), "
    "t AS (SELECT graph, idx, event_type || (e % 3)::VARCHAR AS text, ['NOUN','VERB','ADJ','PRON','PUNCT','AUX','ADP'][e % 7 + 1] AS pos, "
    "CASE WHEN idx = 0 THEN 'ROOT' ELSE ['conj','nsubj','prep','pobj','relcl','appos','amod','agent'][e % 8 + 1] END AS dep, "
    "CASE WHEN idx > 0 THEN (idx - 1) // 2 END AS head, CASE WHEN e % 11 = 0 THEN 'PERSON' ELSE 'NOT_ENTITY' END AS ent, (idx // 8) * 8 AS sent_start FROM e)"
)


def conjunctions(s, d):
    return dependency.solve_conjunctions(_tokens(s, d)).select("graph", "idx", "dep", "head")


def pronoun_antecedents(s, d):
    return dependency.pronoun_antecedents(_tokens(s, d)).select("graph", "idx", "dep", "head", "antecedent")


def prefixes(s, d):
    out = dependency.mark_prefixes(_tokens(s, d)).where("coalesce(prefix_prep, suffix_prep, prefix_agent, suffix_agent) is not null")
    return out.select("graph", "idx", "prefix_prep", "suffix_prep", "prefix_agent", "suffix_agent", "prefix_index", "suffix_index")


def _marked(s, d):
    return dependency.mark_vertices(_tokens(s, d).withColumn("antecedent", F.lit(None).cast("long")))


def vertices_marked(s, d):
    return _marked(s, d).select("graph", "idx", "is_vertex")


def compressed_dependencies(s, d):
    return dependency.compress_dependencies(_marked(s, d)).select("graph", "idx", "pred", F.col("skipped").cast("long").alias("skipped"))


def relationships(s, d):
    marked = _marked(s, d)
    edges, _ = dependency.relationships(marked, dependency.compress_dependencies(marked))
    return edges.select("graph", "edge", "start", "end", "father")


def relationship_members(s, d):
    marked = _marked(s, d)
    _, members = dependency.relationships(marked, dependency.compress_dependencies(marked))
    return members.select("graph", "edge", F.col("pos").cast("long").alias("pos"), "idx")


def vertex_numbers(s, d):
    return dependency.vertex_ids(_marked(s, d)).select("graph", "idx", F.col("vertex_id").cast("long").alias("vertex_id"))


def descendant_edges(s, d):
    tokens = _tokens(s, d)
    nodes = tokens.where("head is not null").select("graph", F.col("head").alias("edge"), "idx")
    return dependency.descendant_edges(tokens, tokens.where("idx % 16 = 1").select("graph", "idx"), nodes, 2)


def edge_orientation(s, d):
    t = _tokens(s, d).where("head is not null")
    other = t.select("graph", "head", F.col("idx").alias("other"), F.col("dep").alias("other_dep"))
    pairs = t.join(other, ["graph", "head"]).where("idx <> other")
    root = F.lit(False)
    return pairs.select("graph", "idx", "other", dependency.no_link(root, root, F.col("dep"), F.col("other_dep")).alias("no_link"), dependency.below(root, root, F.col("dep"), F.col("other_dep"), F.col("idx"), F.col("other")).alias("below"))


def current_nodes(s, d):
    """A part's order lines are its tokens, orders are edges of one source."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    edges = lines.groupBy(F.col("l_orderkey").alias("edge")).agg(F.min("l_linenumber").cast("long").alias("start"), F.max("l_linenumber").cast("long").alias("end"), F.min("l_suppkey").alias("source")).withColumn("graph", F.lit(0))
    members = lines.select(F.lit(0).alias("graph"), F.col("l_orderkey").alias("edge"), F.col("l_partkey").alias("vertex_id")).distinct()
    nodes = lines.select(F.lit(0).alias("graph"), F.col("l_partkey").alias("vertex_id"), F.col("l_linenumber").cast("long").alias("idx"), F.col("l_suppkey").alias("source")).distinct()
    return dependency.current_nodes(edges, members, nodes).select("edge", "vertex_id", "idx")


def _edges(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    pos = F.when(F.col("o_orderstatus") == "F", "VERB").when(F.col("o_orderstatus") == "O", "NOUN").otherwise("AUX")
    dep = F.when(F.col("o_orderpriority") == "1-URGENT", "relcl").when(F.col("o_orderpriority") == "2-HIGH", "advcl").when(F.col("o_orderpriority") == "5-LOW", "ccomp").otherwise("ROOT")
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    named = o.select("o_custkey", "o_orderkey", pos.alias("pos"), dep.alias("dep"))
    return named.select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("edge"), F.col("o_orderkey").alias("idx"), "pos", "dep", F.lag("o_orderkey").over(before).alias("head"), F.lag("pos").over(before).alias("head_pos"))


def combine_edges(s, d):
    """An order is an edge, the one before it the head of its root, and every
    third order has the next one as a child."""
    edges = _edges(s, d)
    after = edges.select("graph", F.col("head").alias("edge"), "idx", "pos").where("edge % 3 = 0")
    return clusters.combine_edges(edges, after).select("graph", "cluster", "edge", "rule")


def path_texts(s, d):
    """A customer's orders are steps, their lines tokens typed by return flag."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("node"), F.min("l_returnflag").alias("flag"))
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    kind = F.when(F.col("node") % 3 == 0, "PERSON").when(F.col("node") % 3 == 1, "NUMBER")
    steps = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("path"), F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("idx"), "node", F.concat(F.lit("p"), F.col("node").cast("string")).alias("text"), kind.alias("type"))
    ends = steps.groupBy("path").agg(F.max("node").alias("node")).select("path", "node", kind.alias("type"), F.lit(0).alias("end"))
    return clusters.path_texts(ends, steps).select("path", F.md5("text").alias("text"))


def triple_texts(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    nodes = lines.select(F.lit(0).alias("graph"), F.col("l_orderkey").alias("edge"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("pos"), F.concat(F.lit("p"), F.col("p").cast("string")).alias("text"))
    each = clusters.triples(nodes).select("graph", (F.col("edge") % 1000).alias("cluster"), "edge", "text")
    return clusters.triple_text(each).select("cluster", F.md5("text").alias("text"))


QUERIES = {f.__name__: f for f in (
    conjunctions, pronoun_antecedents, prefixes, vertices_marked, compressed_dependencies, relationships, relationship_members, vertex_numbers,
    descendant_edges, edge_orientation, current_nodes, combine_edges, path_texts, triple_texts,
)}

_KIDS = "k AS (SELECT graph, head AS idx, count(*) AS n FROM t WHERE head IS NOT NULL GROUP BY 1, 2)"
_MARKED = (
    f"{_TOKENS}, {_KIDS}, m AS (SELECT t.*, CASE WHEN pos IN ('SPACE', 'PUNCT') AND ent = 'NOT_ENTITY' THEN false ELSE (head IS NULL OR ent <> 'NOT_ENTITY' OR pos IN ('NOUN','PROPN','VERB','AUX','ADJ','NUM','PRON','ADV')) "
    "AND NOT (ent <> 'NOT_ENTITY' AND pos IN ('DET', 'PART', 'PUNCT')) AND NOT (pos = 'AUX' AND k.n IS NULL) END AS is_vertex FROM t LEFT JOIN k USING (graph, idx))"
)
_LINKS = (
    f"{_MARKED}, c AS (SELECT graph, idx, head AS pred, 0 AS skipped FROM m WHERE is_vertex AND head IS NOT NULL UNION ALL SELECT c.graph, c.idx, m.head, c.skipped + 1 FROM c JOIN m ON m.graph = c.graph AND m.idx = c.pred WHERE NOT m.is_vertex AND m.head IS NOT NULL), "
    "l AS (SELECT c.graph, c.idx, c.pred, c.skipped FROM c JOIN m ON m.graph = c.graph AND m.idx = c.pred WHERE m.is_vertex)"
)
_RELATIONS = (
    f"{_LINKS}, q AS (SELECT DISTINCT l.graph, l.pred AS edge, m.text, m.sent_start FROM l JOIN m ON m.graph = l.graph AND m.idx = l.pred), "
    "x AS (SELECT graph, edge, sent_start FROM (SELECT *, row_number() OVER (PARTITION BY graph, text, sent_start ORDER BY edge) AS n FROM q) WHERE n = 1), "
    "y AS (SELECT graph, edge, 0 AS pos, edge AS idx FROM x UNION ALL SELECT l.graph, l.pred, row_number() OVER (PARTITION BY l.graph, l.pred ORDER BY l.idx), l.idx FROM l JOIN x ON x.graph = l.graph AND x.edge = l.pred)"
)
_DEP = "CASE o_orderpriority WHEN '1-URGENT' THEN 'relcl' WHEN '2-HIGH' THEN 'advcl' WHEN '5-LOW' THEN 'ccomp' ELSE 'ROOT' END"
_TAKE = "list_contains({l}, {x}.head) THEN {l} ELSE list_concat({l}, [{x}.edge, {x}.head]) END"

ORACLE_SQL = {
    "conjunctions": f"WITH RECURSIVE {_TOKENS}, r AS (SELECT graph, idx, dep, head FROM t WHERE head IS NULL UNION ALL SELECT t.graph, t.idx, CASE WHEN t.dep = 'conj' OR (t.dep = 'appos' AND r.head IS NOT NULL) THEN r.dep ELSE t.dep END, CASE WHEN t.dep = 'conj' OR (t.dep = 'appos' AND r.head IS NOT NULL) THEN r.head ELSE t.head END FROM r JOIN t ON t.graph = r.graph AND t.head = r.idx) SELECT graph, idx, dep, head FROM r",
    "pronoun_antecedents": f"WITH {_TOKENS}, a AS (SELECT p.graph, p.idx, c.head AS antecedent, c.idx AS clause FROM t p JOIN t c ON c.graph = p.graph AND c.idx = p.head WHERE p.pos = 'PRON' AND p.ent = 'NOT_ENTITY' AND c.dep = 'relcl' AND c.head IS NOT NULL), s AS (SELECT DISTINCT graph, clause FROM a) SELECT t.graph, t.idx, CASE WHEN s.clause IS NULL THEN t.dep ELSE 'ROOT' END AS dep, CASE WHEN s.clause IS NULL THEN t.head END AS head, a.antecedent FROM t LEFT JOIN a USING (graph, idx) LEFT JOIN s ON s.graph = t.graph AND s.clause = t.idx",
    "prefixes": f"WITH {_TOKENS}, v AS (SELECT t.graph, CASE WHEN t.dep = 'pobj' THEN t.idx ELSE t.head END AS target, t.idx AS spot, CASE WHEN t.dep = 'pobj' THEN h.idx < t.idx ELSE t.idx < h.idx END AS pre, t.dep = 'agent' AS agent, CASE WHEN t.dep = 'pobj' THEN h.text ELSE t.text END AS word, CASE WHEN t.dep = 'pobj' THEN h.idx ELSE t.idx END AS place FROM t JOIN t h ON h.graph = t.graph AND h.idx = t.head WHERE t.dep IN ('agent', 'prep', 'pobj')) SELECT graph, target AS idx, arg_max(word, spot) FILTER (pre AND NOT agent) AS prefix_prep, arg_max(word, spot) FILTER (NOT pre AND NOT agent) AS suffix_prep, arg_max(word, spot) FILTER (pre AND agent) AS prefix_agent, arg_max(word, spot) FILTER (NOT pre AND agent) AS suffix_agent, arg_max(place, spot) FILTER (pre) AS prefix_index, arg_max(place, spot) FILTER (NOT pre) AS suffix_index FROM v GROUP BY 1, 2",
    "vertices_marked": f"WITH {_MARKED} SELECT graph, idx, is_vertex FROM m",
    "compressed_dependencies": f"WITH RECURSIVE {_LINKS} SELECT graph, idx, pred, skipped::BIGINT AS skipped FROM l",
    "relationships": f"WITH RECURSIVE {_RELATIONS} SELECT x.graph, x.edge, min(y.idx) AS start, max(y.idx) + 1 AS \"end\", max(f.edge) AS father FROM x JOIN y ON y.graph = x.graph AND y.edge = x.edge LEFT JOIN l ON l.graph = x.graph AND l.idx = x.edge LEFT JOIN x f ON f.graph = x.graph AND f.edge = l.pred AND f.sent_start = x.sent_start GROUP BY 1, 2",
    "relationship_members": f"WITH RECURSIVE {_RELATIONS} SELECT graph, edge, pos::BIGINT AS pos, idx FROM y",
    "vertex_numbers": f"WITH {_MARKED}, v AS (SELECT graph, idx, CASE WHEN pos IN ('PRON', 'AUX', 'VERB') THEN '@' || idx ELSE lower(text) END AS key FROM m WHERE is_vertex), f AS (SELECT graph, key, min(idx) AS first FROM v GROUP BY 1, 2), n AS (SELECT graph, key, row_number() OVER (PARTITION BY graph ORDER BY first) AS vertex_id FROM f) SELECT graph, idx, vertex_id FROM v JOIN n USING (graph, key)",
    "descendant_edges": f"WITH {_TOKENS}, b AS (SELECT graph, idx AS start, idx FROM t WHERE idx % 16 = 1), c AS (SELECT b.graph, b.start, t.idx FROM b JOIN t ON t.graph = b.graph AND t.head = b.idx), g AS (SELECT c.graph, c.start, t.idx FROM c JOIN t ON t.graph = c.graph AND t.head = c.idx), a AS (SELECT * FROM b UNION SELECT * FROM c UNION SELECT * FROM g) SELECT DISTINCT a.graph, a.start, t.head AS edge FROM a JOIN t ON t.graph = a.graph AND t.idx = a.idx WHERE t.head IS NOT NULL",
    "edge_orientation": f"WITH {_TOKENS}, p AS (SELECT a.graph, a.idx, b.idx AS other, a.dep, b.dep AS od, CASE WHEN a.dep IN ('nsubj', 'agent') THEN 0 WHEN a.dep = 'pobj' THEN 1 ELSE 2 END AS ra, CASE WHEN b.dep IN ('nsubj', 'agent') THEN 0 WHEN b.dep = 'pobj' THEN 1 ELSE 2 END AS rb FROM t a JOIN t b ON a.graph = b.graph AND a.head = b.head AND a.idx <> b.idx) SELECT graph, idx, other, ra < 2 AND rb < 2 AS no_link, CASE WHEN ra <> rb THEN ra < rb ELSE idx < other END AS below FROM p",
    "current_nodes": "WITH e AS (SELECT l_orderkey AS edge, min(l_linenumber) AS s, max(l_linenumber) AS n, min(l_suppkey) AS src FROM lineitem GROUP BY 1), v AS (SELECT DISTINCT l_orderkey AS edge, l_partkey AS vertex_id FROM lineitem), n AS (SELECT DISTINCT l_partkey AS vertex_id, l_linenumber AS idx, l_suppkey AS src FROM lineitem), r AS (SELECT v.edge, v.vertex_id, n.idx, row_number() OVER (PARTITION BY v.edge, v.vertex_id ORDER BY CASE WHEN n.src = e.src AND n.idx >= e.s AND n.idx < e.n THEN 0 WHEN n.src = e.src THEN 1 WHEN n.idx >= e.s AND n.idx < e.n THEN 2 ELSE 3 END, n.idx) AS k FROM v JOIN e USING (edge) JOIN n USING (vertex_id)) SELECT edge, vertex_id, idx::BIGINT AS idx FROM r WHERE k = 1",
    "combine_edges": f"WITH RECURSIVE o AS (SELECT o_custkey AS graph, o_orderkey AS edge, CASE o_orderstatus WHEN 'F' THEN 'VERB' WHEN 'O' THEN 'NOUN' ELSE 'AUX' END AS pos, {_DEP} AS dep, lag(o_orderkey) OVER w AS head FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), "
    "n AS (SELECT p.graph, p.edge AS cluster, c.edge AS child FROM o p JOIN o c ON c.graph = p.graph AND c.head = p.edge WHERE p.edge % 3 = 0 AND p.pos = 'NOUN' AND c.pos <> 'NOUN'), nu AS (SELECT graph, cluster, cluster AS edge FROM n UNION SELECT graph, cluster, child FROM n), g AS (SELECT DISTINCT graph FROM o), "
    "s AS (SELECT graph, coalesce(list(edge) FILTER (edge IS NOT NULL), []) AS used FROM g LEFT JOIN nu USING (graph) GROUP BY 1), "
    "a1 AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY edge) AS k FROM o WHERE dep = 'relcl' AND head IS NOT NULL), "
    f"r1 AS (SELECT graph, 0::BIGINT AS k, used, NULL::BIGINT AS got FROM s UNION ALL SELECT r1.graph, a1.k, CASE WHEN {_TAKE.format(l='r1.used', x='a1')}, CASE WHEN list_contains(r1.used, a1.head) THEN NULL ELSE a1.edge END FROM r1 JOIN a1 ON a1.graph = r1.graph AND a1.k = r1.k + 1), "
    "u1 AS (SELECT graph, arg_max(used, k) AS used FROM r1 GROUP BY 1), "
    "a2 AS (SELECT c.*, row_number() OVER (PARTITION BY c.graph ORDER BY c.edge) AS k FROM o c JOIN o h ON h.graph = c.graph AND h.edge = c.head WHERE c.dep IN ('advcl', 'ccomp') AND c.pos <> 'NOUN' AND h.pos <> 'NOUN'), "
    f"r2 AS (SELECT graph, 0::BIGINT AS k, used, NULL::BIGINT AS got FROM u1 UNION ALL SELECT r2.graph, a2.k, CASE WHEN {_TAKE.format(l='r2.used', x='a2')}, CASE WHEN list_contains(r2.used, a2.head) THEN NULL ELSE a2.edge END FROM r2 JOIN a2 ON a2.graph = r2.graph AND a2.k = r2.k + 1), "
    "f AS (SELECT graph, cluster, edge, 'noun' AS rule FROM nu UNION ALL SELECT o.graph, o.edge, unnest([o.edge, o.head]), 'relative' FROM r1 JOIN o ON o.graph = r1.graph AND o.edge = r1.got UNION ALL SELECT o.graph, o.edge, unnest([o.edge, o.head]), 'clause' FROM r2 JOIN o ON o.graph = r2.graph AND o.edge = r2.got) "
    "SELECT graph, cluster, edge, rule FROM f UNION ALL SELECT graph, edge, edge, 'single' FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.graph = o.graph AND f.edge = o.edge)",
    "path_texts": "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS node FROM lineitem GROUP BY 1, 2), s AS (SELECT o_custkey AS path, l_orderkey AS step, l_linenumber AS idx, node, CASE node % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'NUMBER' END AS type FROM l JOIN orders ON o_orderkey = l_orderkey), "
    "u AS (SELECT path, node, type, row_number() OVER (PARTITION BY path ORDER BY step, idx) AS spot FROM s UNION ALL SELECT path, max(node), CASE max(node) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'NUMBER' END, 0 FROM s GROUP BY 1), f AS (SELECT path, node, type, min(spot) AS spot FROM u WHERE type IS NOT NULL GROUP BY ALL), n AS (SELECT path, node, type || '#' || row_number() OVER (PARTITION BY path, type ORDER BY spot) AS label FROM f), "
    "w AS (SELECT s.path, s.step, string_agg(coalesce(label, 'p' || node), ' ' ORDER BY idx) AS line FROM s LEFT JOIN n USING (path, node) GROUP BY 1, 2) SELECT path, md5(string_agg(line, '. ' ORDER BY step)) AS text FROM w GROUP BY 1",
    "triple_texts": "WITH l AS (SELECT l_orderkey AS edge, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), n AS (SELECT edge, 'p' || p AS text, row_number() OVER (PARTITION BY edge ORDER BY l_linenumber) AS k FROM l), t AS (SELECT edge, min(text) FILTER (k = 1) || '(' || coalesce(string_agg(text, ', ' ORDER BY k) FILTER (k > 1), '') || ')' AS text FROM n GROUP BY 1) SELECT edge % 1000 AS cluster, md5(string_agg(text, ' & ' ORDER BY edge)) AS text FROM t GROUP BY 1",
}
