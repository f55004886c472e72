"""Registered queries of paths, fusion, near texts, hierarchies and rings, with
DuckDB SQL.

An order's lines hang from each other by half their number, and orders of one
customer are bridged by their last lines. Parts hang below parts of a third and
a fifth of their number.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import vertex
from .plans.tables import saved
from .operators import fusion, fuzzy, graph, hierarchy, match, mentions, simulation, token_paths


def _t(s, d, name, *columns):
    return s.read.parquet(f"{d}/{name}.parquet").select(*columns)


def _lines(s, d):
    """(graph, o, n, idx): a customer's orders and their different lines, counted."""
    lines = _t(s, d, "lineitem", "l_orderkey", "l_linenumber").distinct()
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    counted = lines.withColumn("n", n).join(_t(s, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return counted.select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("o"), "n", (F.col("o_orderkey") * 64 + F.col("n")).alias("idx"))


def token_paths_across_groups(s, d):
    """From the last line of a customer's first order to that of the last one."""
    lines = _lines(s, d)
    heads = lines.select("graph", "idx", F.when(F.col("n") > 1, F.col("o") * 64 + F.floor(F.col("n") / 2)).alias("head"))
    last = lines.groupBy("graph", "o").agg(F.max("idx").alias("last"))
    before = last.select("graph", "o", F.lag("last").over(Window.partitionBy("graph").orderBy("o")).alias("bridge"))
    below = heads.where("head is not null").select("graph", F.col("head").alias("edge"), "idx")
    top = lines.where("n = 1").select("graph", "o", F.col("idx").alias("edge"))
    members = below.union(below.select("graph", "edge", F.col("edge").alias("idx"))).union(top.select("graph", "edge", F.col("edge").alias("idx")))
    members = members.union(top.join(before.where("bridge is not null"), ["graph", "o"]).select("graph", "edge", F.col("bridge").alias("idx"))).distinct()
    ends = last.groupBy("graph").agg(F.min_by("last", "o").alias("v"), F.max_by("last", "o").alias("w"))
    nodes = members.select("graph", "edge", F.col("idx").alias("vertex"), "idx")
    roots = members.select("graph", "edge", F.col("edge").alias("idx")).distinct()
    return token_paths.token_paths(heads, nodes, roots, ends).select("graph", F.col("step").cast("long").alias("step"), "idx")


def _fused(s, d):
    """An order's lines are vertices of three sources, that ask for two parts."""
    part = F.min("l_partkey").alias("part")
    lines = _t(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(part, (F.min("l_suppkey") % 3).alias("source"))
    kind = F.when(F.col("part") % 3 == 0, "PERSON")
    vertices = lines.select(F.col("l_orderkey").alias("instance"), F.col("l_linenumber").cast("long").alias("vertex_id"), "source", F.concat(F.lit("p"), (F.col("part") % 10).cast("string")).alias("text"), kind.alias("type"), F.array(F.coalesce(kind, F.lit(vertex.NONE))).alias("ents"), F.array(F.when(F.col("part") % 2 == 0, "NOUN").otherwise("VERB")).alias("poses"), F.lit(False).alias("virtual"))
    vertices = saved(vertices)
    members = vertices.select("instance", F.floor(F.col("vertex_id") / 2).alias("edge"), (F.col("vertex_id") % 2).cast("int").alias("pos"), "vertex_id")
    orders = _t(s, d, "orders", "o_orderkey", "o_custkey")
    asked = orders.select(F.col("o_orderkey").alias("instance"), F.posexplode(F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 10)).alias("u", "n"))
    query = asked.select("instance", F.col("u").cast("long").alias("vertex_id"), F.concat(F.lit("p"), F.col("n").cast("string")).alias("text"), F.array(F.lit("PERSON")).alias("ents"), F.array(F.lit("NOUN")).alias("poses"))
    listed = F.array_join(F.array_sort(F.collect_set("text")), " ")
    texts = vertices.groupBy("instance", "source").agg(F.concat(F.lit("holds "), listed).alias("text"))
    lineage, merged, moved = fusion.merge_instances(vertices, members, fusion.instance_links(vertices))
    relation = query.select("instance", F.col("vertex_id").alias("u"), "text").join(merged.select("instance", F.col("vertex_id").alias("v"), "text"), ["instance", "text"]).select("instance", "u", "v")
    return fusion.reverse_trace(query, relation, merged, lineage, texts), texts, moved


def fusion_trace(s, d):
    trace, _, _ = _fused(s, d)
    return trace.select("instance", "u", "query_text", "matched", F.col("evidence").cast("long").alias("evidence"), "answer", "supporting", F.round("confidence", 6).alias("confidence"))


def fusion_full_support(s, d):
    trace, _, _ = _fused(s, d)
    return fusion.full_support(trace).select("instance", F.col("evidence").cast("long").alias("evidence"))


def fusion_members(s, d):
    _, _, moved = _fused(s, d)
    return moved.select("instance", F.col("edge").cast("long").alias("edge"), F.col("pos").cast("long").alias("pos"), "vertex_id")


def fusion_reports(s, d):
    trace, texts, _ = _fused(s, d)
    report, lines = fusion.trace_report(trace, texts), F.split("context", "\n")
    return report.select("instance", F.get(lines, F.lit(0)).alias("coverage"), F.size(F.filter(lines, lambda x: x.startswith("["))).cast("long").alias("n_evidence"), F.size(F.filter(lines, lambda x: x.startswith("  - "))).cast("long").alias("n_lines"))


def _words(s, d):
    turns = _t(s, d, "conversations", "conv_id", "turn", "text")
    split = turns.select(F.col("conv_id").alias("graph"), "turn", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("n", "text"))
    return split.where("length(text) >= 3")


def near_words(s, d):
    """Words of a conversation that nearly equal another of it."""
    near = fuzzy.near_texts(_words(s, d).select("graph", "text"))
    return near.select("graph", "a", "b", F.round("score", 6).alias("score"))


def near_word_ids(s, d):
    """Ids of all words of a conversation, nearly equal ones sharing theirs."""
    words = _words(s, d).select("graph", (F.col("turn").cast("long") * 100_000 + F.col("n")).alias("idx"), "text", F.lit("NOUN").alias("pos"), F.when(F.length("text") % 2 == 0, "X").otherwise("Y").alias("ent"), F.lit(None).cast("long").alias("primary"))
    return fuzzy.fuzzy_vertex_ids(words).select("graph", "idx", F.col("vertex_id").cast("long").alias("vertex_id"))


def _arcs(s, d):
    n = F.col("p_partkey")
    up = F.explode(F.array_distinct(F.array(F.floor(n / 3), F.floor(n / 5))))
    return _t(s, d, "part", "p_partkey").where("p_partkey >= 3").select(n.alias("child"), up.alias("parent"))


def concepts_below(s, d):
    """If each part hangs below the part of a fourth of its number."""
    arcs, n = _arcs(s, d), F.col("p_partkey")
    labels = hierarchy.concept_labels(arcs)
    pairs = _t(s, d, "part", "p_partkey").select(n.alias("a"), F.floor(n / 4).alias("b"))
    return hierarchy.below(pairs, labels, hierarchy.covered_labels(arcs, labels)).select("a", "b", "below")


def domain_matches(s, d):
    """A customer's concepts are parts of some orders' numbers, some unknown."""
    tops = _t(s, d, "part", "p_partkey").where("p_partkey < 9").select(F.col("p_partkey").alias("concept"))
    held = _t(s, d, "orders", "o_orderkey", "o_custkey").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("vertex"), (F.col("o_orderkey") % 2300).alias("concept"))
    pairs = _t(s, d, "customer", "c_custkey").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return hierarchy.domain_matches(pairs, held, hierarchy.concept_domains(_arcs(s, d), tops)).select("a", "b", "match")


def _rings(s, d):
    """Parts hang from a third of their number; two in fifty hang from each other."""
    n = F.col("p_partkey")
    parent = F.when(n % 50 == 7, n + 1).when(n % 50 == 8, n - 1).when(n >= 3, F.floor(n / 3))
    return _t(s, d, "part", "p_partkey").select(n.alias("node"), parent.alias("parent"))


def roots_over_rings(s, d):
    return graph.ultimate_roots(_rings(s, d)).select("node", "root")


def unreached_nodes(s, d):
    return graph.unreached_nodes(_rings(s, d)).select("node")


def common_prefixes(s, d):
    """Where the root paths of neighbouring parts part."""
    n = F.col("p_partkey")
    arcs = _t(s, d, "part", "p_partkey").where("p_partkey >= 3").select(n.alias("child"), F.floor(n / 3).alias("parent"))
    labels = hierarchy.concept_labels(arcs).withColumn("label", F.transform("label", lambda x: x.cast("string")))
    side = lambda c, shift: labels.select((F.col("concept") - shift).alias("part"), F.col("label").alias(c))
    met = side("a", 0).join(side("b", 1).hint("merge"), "part").withColumn("m", graph.common_prefix(F.col("a"), F.col("b")))
    return met.select("part", F.col("m.concept").alias("concept"), F.col("m.depth").cast("long").alias("depth"))


def _incidence(s, d):
    """Orders are edges of a status; their customer, nation and segment vertices."""
    orders = _t(s, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").where("o_orderkey % 10 = 0")
    met = orders.join(_t(s, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    both = F.explode(F.array(F.col("c_custkey") + 1000, F.col("c_nationkey").cast("long")))
    return met.select(F.col("c_nationkey").alias("graph"), F.col("o_orderkey").alias("edge"), both.alias("vertex"), F.col("o_orderstatus").alias("source"))


def _nations(s, d):
    return _t(s, d, "nation", "n_nationkey").select(F.col("n_nationkey").alias("graph"), F.col("n_nationkey").cast("long").alias("src"))


def hyperpaths_of_one_source(s, d):
    """Paths from a nation to its customers over orders of one status."""
    out = graph.shortest_hyperpaths(_incidence(s, d), _nations(s, d), max_hops=2, local=True)
    return out.select("src", "dst", F.col("length").cast("long").alias("length"), F.get("path", F.lit(0)).alias("first"))


def simple_paths(s, d):
    """All paths of one or two orders between a nation and its customers."""
    n = F.col("dst")
    out = graph.paths_up_to(_incidence(s, d).drop("source"), _nations(s, d), 2)
    return out.groupBy("src", n).agg(F.count(F.lit(1)).alias("n_paths"), F.sum(F.element_at("path", -1)).alias("last_edges"))


def pruned_pairs(s, d):
    """A supplier stands for a part while a neighbouring supplier still has one
    that an order supports."""
    lines = _t(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_discount").where("l_orderkey % 4 = 0")
    pairs = lines.where("l_discount > 0.05").select(F.lit(0).alias("instance"), F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).distinct()
    beside = pairs.select("instance", "u").distinct().select("instance", "u", (F.col("u") + 1).alias("x"))
    own = lines.select("l_orderkey", F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).distinct()
    support = own.join(own.select("l_orderkey", F.col("u").alias("x"), F.col("v").alias("y")), "l_orderkey").where("x = u + 1").select(F.lit(0).alias("instance"), "u", "x", "v", "y").distinct()
    return simulation.prune_inconsistent(pairs, beside, support, require_all=True).select("u", "v")


def refined_slices(s, d):
    """Of a customer's orders whose priority is the answer only the last stays."""
    orders = _t(s, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    slices = orders.select(F.col("o_custkey").alias("instance"), F.col("o_orderstatus").alias("slice"), F.lit(1).alias("u"), F.col("o_orderkey").alias("v"), F.col("o_orderpriority").alias("v_text"))
    answers = _t(s, d, "customer", "c_custkey").select(F.col("c_custkey").alias("instance"), F.when(F.col("c_custkey") % 2 == 0, " 5-low ").otherwise("2-HIGH").alias("answer"))
    return match.refine_slices(slices, answers).select("instance", "slice", "v")


def _numbered(s, d):
    """(graph, n, part, supp): an order's different lines, counted."""
    lines = _t(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    return lines.select(F.col("l_orderkey").alias("graph"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("long").alias("n"), "part", "supp")


def updated_mentions(s, d):
    """Lines are tokens of ten places, some with a gap; mentions begin in them."""
    lines, n = _numbered(s, d), F.col("n")
    tokens = lines.select("graph", n.alias("idx"), (n * 10).alias("char_start"), (n * 10 + 3 + F.col("part") % 8).alias("char_end"))
    begin = n * 10 + F.col("part") % 5
    ranges = lines.select("graph", (F.col("supp") % 2).alias("cluster"), begin.alias("char_start"), (begin + F.col("supp") % 25 + 1).alias("char_end"), (F.col("part") % 3 == 0).alias("primary"))
    return mentions.updated_mentions(ranges, tokens).select("graph", "cluster", "start", "end", "primary")


def dropped_clusters(s, d):
    lines, n = _numbered(s, d), F.col("n")
    held = lines.select("graph", (F.col("supp") % 4).alias("cluster"), n.alias("start"), (n + F.col("part") % 5 + 1).alias("end"), F.floor(n / 2).alias("root"))
    return mentions.dropped_clusters(held).select("graph", "cluster")


def span_containment(s, d):
    """A customer's orders are spans that nest and cross."""
    start = F.col("o_orderkey") % 97
    held = _t(s, d, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("graph"), start.alias("start"), (start + F.col("o_orderkey") % 13 * 3 + 1).alias("end"))
    return mentions.containment(held).select("graph", "start", "end", "outer_start", "outer_end", "crossing")


QUERIES = {f.__name__: f for f in (
    updated_mentions, dropped_clusters, span_containment,
    token_paths_across_groups, fusion_trace, fusion_full_support, fusion_members, fusion_reports, near_words, near_word_ids, concepts_below, domain_matches,
    roots_over_rings, unreached_nodes, common_prefixes, hyperpaths_of_one_source, simple_paths, pruned_pairs, refined_slices,
)}

_LINES = "l AS (SELECT o_custkey AS graph, l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)"
_FUSED = (
    "l AS (SELECT l_orderkey AS i, l_linenumber::BIGINT AS x, min(l_partkey) AS part, min(l_suppkey) % 3 AS source FROM lineitem GROUP BY 1, 2), "
    "v AS (SELECT i, x, source, 'p' || part % 10 AS text, CASE WHEN part % 3 = 0 THEN 'PERSON' ELSE 'NOT_ENTITY' END AS ent, CASE WHEN part % 2 = 0 THEN 'NOUN' ELSE 'VERB' END AS pos FROM l), "
    "g AS (SELECT i, text, min(x) AS first, count(DISTINCT source) AS n FROM v GROUP BY 1, 2), "
    "m AS (SELECT v.*, CASE WHEN n > 1 THEN first ELSE x END AS merged FROM v JOIN g USING (i, text)), "
    "q AS (SELECT o_orderkey AS i, unnest([0, 1])::BIGINT AS u, unnest(['p' || o_custkey % 10, 'p' || o_orderkey % 10]) AS query_text FROM orders), "
    "k AS (SELECT i, merged, text, max((ent = 'PERSON')::INT) AS e, max((pos = 'NOUN')::INT) AS p FROM m GROUP BY ALL), "
    "s AS (SELECT i, source, 'holds ' || string_agg(DISTINCT text, ' ' ORDER BY text) AS body FROM v GROUP BY 1, 2), "
    "t AS (SELECT q.i AS instance, q.u, query_text, true AS matched, m.source AS evidence, k.text AS answer, body AS supporting, 0.5 + 0.3 * e + 0.2 * p AS confidence FROM q JOIN k ON k.i = q.i AND k.text = query_text JOIN (SELECT DISTINCT i, merged, source FROM m) m ON m.i = k.i AND m.merged = k.merged JOIN s ON s.i = q.i AND s.source = m.source "
    "UNION ALL SELECT q.i, q.u, query_text, false, NULL, NULL, NULL, 0 FROM q WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.i = q.i AND k.text = query_text))"
)
_ARCS = "a AS (SELECT DISTINCT p_partkey AS child, unnest([p_partkey // 3, p_partkey // 5]) AS parent FROM part WHERE p_partkey >= 3)"
_UP = f"{_ARCS}, u AS (SELECT p_partkey AS c, p_partkey AS anc FROM part UNION SELECT u.c, a.parent FROM u JOIN a ON a.child = u.anc)"
_RINGS = "r AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 50 = 7 THEN p_partkey + 1 WHEN p_partkey % 50 = 8 THEN p_partkey - 1 WHEN p_partkey >= 3 THEN p_partkey // 3 END AS parent FROM part)"
_NATION_EDGES = "e AS (SELECT c_nationkey AS src, c_custkey + 1000 AS dst, o_orderkey AS edge, o_orderstatus AS source FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 10 = 0)"

_NUMBERED = "l AS (SELECT l_orderkey AS graph, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, part, supp FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2))"

ORACLE_SQL = {
    "updated_mentions": f"WITH {_NUMBERED}, t AS (SELECT graph, n AS idx, n * 10 AS s, n * 10 + 3 + part % 8 AS e FROM l), r AS (SELECT graph, supp % 2 AS cluster, n * 10 + part % 5 AS s, n * 10 + part % 5 + supp % 25 + 1 AS e, part % 3 = 0 AS p FROM l) "
    'SELECT r.graph, r.cluster, a.idx AS start, b.idx + 1 AS "end", bool_or(r.p) AS "primary" FROM r JOIN t a ON a.graph = r.graph AND a.s <= r.s AND r.s < a.e JOIN t b ON b.graph = r.graph AND b.s < r.e AND r.e <= b.e GROUP BY 1, 2, 3, 4',
    "dropped_clusters": f"WITH {_NUMBERED}, m AS (SELECT graph, supp % 4 AS cluster, n // 2 AS root, part % 5 + 1 AS len FROM l), b AS (SELECT *, first_value(cluster) OVER (PARTITION BY graph, root ORDER BY len, cluster) AS best FROM m) SELECT DISTINCT graph, cluster FROM b WHERE cluster <> best",
    "span_containment": 'WITH o AS (SELECT DISTINCT o_custkey AS graph, o_orderkey % 97 AS s, o_orderkey % 97 + o_orderkey % 13 * 3 + 1 AS e FROM orders), p AS (SELECT a.*, b.s AS bs, b.e AS be, b.s <= a.s AND a.e <= b.e AS h, a.s <= b.s AND b.e <= a.e AS i FROM o a JOIN o b ON a.graph = b.graph AND (a.s <> b.s OR a.e <> b.e) AND b.s < a.e AND a.s < b.e), '
    "g AS (SELECT graph, s, e, min({'n': be - bs, 's': bs, 'e': be}) FILTER (h) AS m, bool_or(NOT h AND NOT i) AS c FROM p GROUP BY 1, 2, 3) SELECT o.graph, o.s AS start, o.e AS \"end\", m.s AS outer_start, m.e AS outer_end, coalesce(c, false) AS crossing FROM o LEFT JOIN g USING (graph, s, e)",
    "token_paths_across_groups": f"WITH RECURSIVE {_LINES}, b AS (SELECT graph, o, max(n) AS n, row_number() OVER (PARTITION BY graph ORDER BY o) AS k FROM l GROUP BY 1, 2), "
    "w AS (SELECT graph, o, k, n FROM b UNION ALL SELECT graph, o, k, n // 2 FROM w WHERE n > 1), "
    "c AS (SELECT graph, count(*) AS m FROM b GROUP BY 1) "
    "SELECT DISTINCT graph, step::BIGINT AS step, idx FROM (SELECT w.graph, k - 2 AS step, o * 64 + n AS idx FROM w WHERE k > 1 UNION ALL SELECT y.graph, y.k - 2, x.o * 64 + x.n FROM b x JOIN b y ON x.graph = y.graph AND x.k + 1 = y.k UNION ALL SELECT graph, 0, o * 64 + n FROM b JOIN c USING (graph) WHERE m = 1)",
    "fusion_trace": f"WITH {_FUSED} SELECT instance, u, query_text, matched, evidence::BIGINT AS evidence, answer, supporting, round(confidence, 6)::DOUBLE AS confidence FROM t",
    "fusion_full_support": f"WITH {_FUSED} SELECT instance, evidence::BIGINT AS evidence FROM t WHERE matched GROUP BY 1, 2 HAVING count(DISTINCT u) = 2",
    "fusion_members": f"WITH {_FUSED}, d AS (SELECT i, x // 2 AS edge, merged, min(x % 2) AS spot FROM m GROUP BY 1, 2, 3) SELECT i AS instance, edge, row_number() OVER (PARTITION BY i, edge ORDER BY spot) - 1 AS pos, merged AS vertex_id FROM d",
    "fusion_reports": f"WITH {_FUSED}, x AS (SELECT instance, query_text, max(matched::INT) AS hit FROM t GROUP BY 1, 2), y AS (SELECT instance, sum(hit) AS covered, count(*) AS total, count(*) - sum(hit) AS missing FROM x GROUP BY 1), z AS (SELECT instance, count(*) AS n FROM t WHERE matched GROUP BY 1), h AS (SELECT i AS instance, count(*) AS n FROM s GROUP BY 1) "
    "SELECT y.instance, 'covered ' || covered || ' of ' || total AS coverage, coalesce(h.n, 0)::BIGINT AS n_evidence, (coalesce(z.n, 0) + missing)::BIGINT AS n_lines FROM y LEFT JOIN z USING (instance) LEFT JOIN h USING (instance)",
    "near_words": r"WITH w AS (SELECT DISTINCT conv_id AS graph, unnest(string_split_regex(lower(text), '[^a-z]+')) AS text FROM conversations), l AS (SELECT * FROM w WHERE length(text) >= 9) SELECT x.graph, x.text AS a, y.text AS b, round(100 * (1 - levenshtein(x.text, y.text) / greatest(length(x.text), length(y.text))::DOUBLE), 6) AS score FROM l x JOIN l y ON x.graph = y.graph AND x.text < y.text AND abs(length(x.text) - length(y.text)) * 10 <= greatest(length(x.text), length(y.text)) WHERE levenshtein(x.text, y.text) * 10 <= greatest(length(x.text), length(y.text))",
    "concepts_below": f"WITH RECURSIVE {_UP} SELECT p_partkey AS a, p_partkey // 4 AS b, EXISTS (SELECT 1 FROM u WHERE u.c = p_partkey AND u.anc = p_partkey // 4) AS below FROM part",
    "domain_matches": f"WITH RECURSIVE {_UP}, h AS (SELECT o_custkey AS x, o_orderkey % 2300 AS c FROM orders WHERE o_orderkey % 5 = 0), k AS (SELECT DISTINCT x FROM h JOIN part ON p_partkey = c), g AS (SELECT DISTINCT h.x, u.anc FROM h JOIN u USING (c) WHERE u.anc >= 9) "
    "SELECT c_custkey AS a, c_custkey + 1 AS b, CASE WHEN c_custkey IN (SELECT x FROM k) AND c_custkey + 1 IN (SELECT x FROM k) THEN EXISTS (SELECT 1 FROM g p JOIN g q ON p.anc = q.anc WHERE p.x = c_custkey AND q.x = c_custkey + 1) END AS match FROM customer",
    "roots_over_rings": f"WITH RECURSIVE {_RINGS}, t AS (SELECT node, node AS root FROM r WHERE parent IS NULL OR node % 50 = 7 UNION ALL SELECT r.node, t.root FROM t JOIN r ON r.parent = t.node WHERE r.node % 50 <> 7) SELECT node, root FROM t",
    "unreached_nodes": f"WITH RECURSIVE {_RINGS}, t AS (SELECT node FROM r WHERE parent IS NULL UNION ALL SELECT r.node FROM t JOIN r ON r.parent = t.node) SELECT node FROM r WHERE node NOT IN (SELECT node FROM t)",
    "common_prefixes": "WITH RECURSIVE t AS (SELECT p_partkey AS c, p_partkey AS anc, 0 AS up FROM part UNION ALL SELECT c, anc // 3, up + 1 FROM t WHERE anc >= 3), n AS (SELECT c, max(up) AS far FROM t GROUP BY 1), x AS (SELECT t.c, t.anc, n.far - t.up AS depth FROM t JOIN n USING (c)), "
    "m AS (SELECT p.c AS part, max(p.depth) AS depth FROM x p JOIN x q ON q.c = p.c + 1 AND q.anc = p.anc AND q.depth = p.depth GROUP BY 1) SELECT a.p_partkey AS part, coalesce(x.anc::VARCHAR, '') AS concept, coalesce(m.depth, -1)::BIGINT AS depth FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 LEFT JOIN m ON m.part = a.p_partkey LEFT JOIN x ON x.c = a.p_partkey AND x.depth = m.depth WHERE a.p_partkey > 0",
    "hyperpaths_of_one_source": f"WITH {_NATION_EDGES} SELECT src::BIGINT AS src, dst, 1::BIGINT AS length, min(edge) AS first FROM e GROUP BY 1, 2",
    "simple_paths": f"WITH {_NATION_EDGES}, c AS (SELECT src, dst, count(*) AS n, sum(edge) AS s FROM e GROUP BY 1, 2) SELECT src::BIGINT AS src, dst, n AS n_paths, s::BIGINT AS last_edges FROM c",
    "pruned_pairs": "WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS u, l_partkey AS v FROM lineitem WHERE l_orderkey % 4 = 0), p AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM lineitem WHERE l_orderkey % 4 = 0 AND l_discount > 0.05), s AS (SELECT DISTINCT x.u, x.v, y.v AS y FROM b x JOIN b y ON x.o = y.o AND y.u = x.u + 1), "
    "t AS (SELECT 0 AS k, list({'u': u, 'v': v}) AS r FROM p UNION ALL SELECT k + 1, (SELECT list({'u': q.u, 'v': q.v}) FROM (SELECT unnest(t.r, recursive := true)) q WHERE EXISTS (SELECT 1 FROM s JOIN (SELECT unnest(t.r, recursive := true)) z ON z.u = s.u + 1 AND z.v = s.y WHERE s.u = q.u AND s.v = q.v)) FROM t WHERE k < 110 AND len(r) > 0) "
    "SELECT u, v FROM (SELECT unnest(r, recursive := true) FROM t WHERE k = (SELECT max(k) FROM t))",
    "refined_slices": "WITH o AS (SELECT *, lower(o_orderpriority) = CASE WHEN o_custkey % 2 = 0 THEN '5-low' ELSE '2-high' END AS hit FROM orders), m AS (SELECT *, max(o_orderkey) FILTER (hit) OVER (PARTITION BY o_custkey, o_orderstatus) AS best FROM o) SELECT o_custkey AS instance, o_orderstatus AS slice, o_orderkey AS v FROM m WHERE best IS NULL OR o_orderkey = best",
}
