"""Passes over given token tables, from dependency trees to hyperedges.

A token is (graph, idx, text, pos, dep, head, ent), ``head`` the idx of its
parent or null for a root. The parser itself is a model and not part of this
package: its tokens are input. Trees are handled as joins of a token with its
parent, for all graphs at once; what climbs a tree loops until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vertex
from ..plans.tables import cut

#: Dependency names with a role of their own.
SUBJECTS = ("nsubj", "nsubjpass", "csubj", "csubjpass")
WIDE_SUBJECTS = (*SUBJECTS, "agent", "expl")
MAIN_ROLES = (*WIDE_SUBJECTS, "dobj", "iobj", "pobj", "dative", "attr", "oprd", "pcomp")
#: Parts of speech that make a token a vertex.
VERTEX_POS = ("NOUN", "PROPN", "VERB", "AUX", "ADJ", "NUM", "PRON", "ADV")
#: Words after "how" that ask for a number.
QUANTIFIERS = ("many", "much", "few", "little", "long", "often", "far")
#: Question words and what they ask for.
PRONOUNS = {"which": "WHICH", "what": "WHAT", "who": "PERSON", "whom": "PERSON"}
#: What asks without a type of its own, by word and by tag.
UNTYPED, ASKING_TAGS = ("whose",), ("WP", "WP$")
ADVERBS = {"when": "TIME", "where": "LOCATION", "why": "REASON"}


def _of(tokens: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """``tokens`` as the ``prefix`` of another: (graph, <prefix>, <prefix>_column...)."""
    return tokens.select("graph", F.col("idx").alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def solve_conjunctions(tokens: DataFrame) -> DataFrame:
    """Conjuncts take the dependency and the head of what they are joined to,
    along whole chains; appositions do too unless that one is a root."""
    now = cut(tokens.withColumn("_open", F.col("dep").isin("conj", "appos") & F.col("head").isNotNull()))
    while not now.where("_open").isEmpty():
        parent = now.where("not _open").select("graph", F.col("idx").alias("head"), F.col("dep").alias("_dep"), F.col("head").alias("_head"), F.lit(True).alias("_known"))
        met = now.join(parent, ["graph", "head"], "left")
        due = F.col("_open") & F.coalesce("_known", F.lit(False))
        moves = due & ((F.col("dep") == "conj") | F.col("_head").isNotNull())
        met = met.withColumns({"_new_dep": F.when(moves, F.col("_dep")).otherwise(F.col("dep")), "_new_head": F.when(moves, F.col("_head")).otherwise(F.col("head")), "_still": F.col("_open") & ~due})
        step = cut(met.select(*[F.col("_new_dep").alias(c) if c == "dep" else F.col("_new_head").alias(c) if c == "head" else F.col(c) for c in tokens.columns], F.col("_still").alias("_open")))
        # heads outside the table leave tokens open for ever
        if step.where("_open").count() == now.where("_open").count():
            now = step.withColumn("_open", F.lit(False))
            break
        now = step
    return now.drop("_open")


def pronoun_antecedents(tokens: DataFrame, is_query: bool = False) -> DataFrame:
    """Adds ``antecedent``. A relative clause with a pronoun that is no entity
    becomes a tree of its own, and its pronouns stand for the word it described.
    In questions the pronoun subject over a complement clause stands for the
    pronoun subject in it, the last of several."""
    clause = tokens.where("dep = 'relcl' and head is not null").select("graph", F.col("idx").alias("head"), F.col("head").alias("antecedent"))
    own = tokens.where(f"pos = 'PRON' and ent = '{vertex.NONE}'").join(clause, ["graph", "head"]).select("graph", "idx", "antecedent", F.col("head").alias("clause"))
    found = own.select("graph", "idx", "antecedent")
    if is_query:
        subject = tokens.where((F.col("pos") == "PRON") & F.col("dep").isin("nsubj", "nsubjpass"))
        inner = subject.select("graph", F.col("head").alias("clause"), F.col("idx").alias("inner"))
        over = tokens.where("dep = 'ccomp' and head is not null").select("graph", F.col("idx").alias("clause"), "head")
        formal = subject.select("graph", "idx", "head").join(over, ["graph", "head"]).join(inner, ["graph", "clause"])
        last = formal.groupBy("graph", "idx").agg(F.max(F.struct("clause", "inner")).alias("m")).select("graph", "idx", F.col("m.inner").alias("antecedent"))
        found = last.unionByName(found.join(last, ["graph", "idx"], "left_anti"))
    split = own.select("graph", F.col("clause").alias("idx")).distinct().withColumn("_split", F.lit(True))
    marked = tokens.join(found, ["graph", "idx"], "left").join(split, ["graph", "idx"], "left")
    root = F.coalesce("_split", F.lit(False))
    return marked.select(*[F.when(root, "ROOT").otherwise(F.col("dep")).alias(c) if c == "dep" else F.when(~root, F.col("head")).alias(c) if c == "head" else F.col(c) for c in tokens.columns], "antecedent")


def mark_prefixes(tokens: DataFrame) -> DataFrame:
    """Adds prefix_prep, suffix_prep, prefix_agent, suffix_agent and the places
    prefix_index, suffix_index: a preposition or agent before or behind its
    head, and the preposition that an object hangs from. The last one counts."""
    arcs = tokens.where(F.col("dep").isin("agent", "prep", "pobj") & F.col("head").isNotNull())
    met = arcs.join(_of(tokens, "head", "text"), ["graph", "head"])
    inside = F.col("dep") == "pobj"
    before = F.when(inside, F.col("head") < F.col("idx")).otherwise(F.col("idx") < F.col("head"))
    events = met.select(
        "graph",
        F.when(inside, F.col("idx")).otherwise(F.col("head")).alias("target"),
        F.col("idx").alias("at"),
        F.concat(F.when(before, "prefix_").otherwise("suffix_"), F.when(F.col("dep") == "agent", "agent").otherwise("prep")).alias("kind"),
        F.when(inside, F.col("head_text")).otherwise(F.col("text")).alias("word"),
        F.when(inside, F.col("head")).otherwise(F.col("idx")).alias("place"),
    )
    last = lambda value, *kinds: F.max_by(value, F.when(F.col("kind").isin(*kinds), F.col("at")))
    kinds = ("prefix_prep", "suffix_prep", "prefix_agent", "suffix_agent")
    out = events.groupBy("graph", F.col("target").alias("idx")).agg(*[last(F.col("word"), k).alias(k) for k in kinds], *[last(F.col("place"), f"{s}_prep", f"{s}_agent").alias(f"{s}_index") for s in ("prefix", "suffix")])
    return tokens.join(out, ["graph", "idx"], "left")


def _one_of(word: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for w, kind in table.items():
        out = F.when(word == w, kind).otherwise(out)
    return out


def mark_vertices(tokens: DataFrame, is_query: bool = False) -> DataFrame:
    """Adds ``is_vertex`` and, for questions, ``query_type`` and ``is_query``, which
    also marks pronouns that ask without a type: "whose", and by ``tag``, where the
    tokens have one, WP and WP$. Needs ``antecedent``. A vertex is a root, an entity, or a content word; white
    space and punctuation are none, nor are determiners that are entities, or
    auxiliaries without children. In questions, who, what, when and so on are
    vertices that ask for a type."""
    children = tokens.where("head is not null").groupBy("graph", F.col("head").alias("idx")).agg(F.count(F.lit(1)).alias("_children"), F.max(F.col("dep").isin("acl", "relcl")).alias("_clause_below"))
    staged = tokens.join(children, ["graph", "idx"], "left").join(_of(tokens, "head", "pos", "dep"), ["graph", "head"], "left")
    below = tokens.where(F.col("dep").isin("acl", "relcl") & F.col("head").isNotNull()).select("graph", "head").distinct().withColumn("_beside", F.lit(True))
    staged = staged.join(below, ["graph", "head"], "left")
    entity, low, pos = F.col("ent") != vertex.NONE, F.lower("text"), F.col("pos")
    blank = pos.isin("SPACE", "PUNCT") & ~entity
    content = F.col("head").isNull() | entity | pos.isin(*VERTEX_POS)
    bare = (pos == "AUX") & F.col("_children").isNull()
    plain = content & ~(entity & pos.isin("DET", "PART", "PUNCT")) & ~bare
    asked, asks = F.lit(None).cast("string"), F.lit(False)
    kept = F.when(blank, F.lit(False)).otherwise(plain)
    if is_query:
        helper = ((pos == "AUX") & (F.col("dep") == "aux") & (F.col("head_pos") == "VERB")) | ((pos == "PRON") & (F.col("dep") == "det"))
        how = F.btrim(F.regexp_replace(F.regexp_replace(low, "-", " "), r"\s+", " "), F.lit(" .,?!;:"))
        quantity = how.startswith("how") & F.regexp_extract(how, r"^\S+ (.*)$", 1).isin(*QUANTIFIERS)
        quality = how.startswith("how") & pos.isin("ADJ", "ADV")
        in_clause = F.coalesce(F.col("head_dep").isin("acl", "relcl"), F.lit(False)) | F.coalesce("_beside", F.lit(False))
        adverb = (pos == "ADV") | ((pos == "SCONJ") & ~in_clause)
        whose = (pos == "DET") & (F.col("dep") == "poss") & (low == "whose")
        place = F.when(adverb, _one_of(low, ADVERBS))
        asked = F.coalesce(place, F.when(whose, "BELONGS"), F.when((pos == "PRON") & F.col("antecedent").isNull(), _one_of(low, PRONOUNS)), F.when(quantity, "NUMBER").when(quality, "ATTRIBUTE"))
        asked = F.when(~blank & ~helper, asked)
        tagged = F.coalesce(F.col("tag").isin(*ASKING_TAGS), F.lit(False)) if "tag" in tokens.columns else F.lit(False)
        asks = asked.isNotNull() | (~blank & ~helper & (pos == "PRON") & F.col("antecedent").isNull() & (low.isin(*UNTYPED) | tagged))
        kept = F.when(blank | helper, F.lit(False)).otherwise(place.isNotNull() | whose | plain)
    return staged.select(*tokens.columns, F.coalesce(kept, F.lit(False)).alias("is_vertex"), asked.alias("query_type"), asks.alias("is_query"))


def compress_dependencies(tokens: DataFrame) -> DataFrame:
    """(graph, idx, pred, skipped): each vertex with its nearest ancestor that is
    one, and how many others lie between. Needs ``is_vertex``. Pointers over
    words that are no vertices double their reach in each round, so as many rounds
    as the number of words has binary digits settle all; what then still
    moves is caught in a ring of heads without a vertex and has no row."""
    up = cut(tokens.where("head is not null").select("graph", "idx", F.col("head").alias("pred"), F.lit(0).alias("skipped")))
    over = tokens.where("not is_vertex").select("graph", F.col("idx").alias("pred"), F.lit(True).alias("over"))
    for _ in range(max(1, tokens.count()).bit_length() + 1):
        hop = up.select("graph", F.col("idx").alias("pred"), F.col("pred").alias("next"), F.col("skipped").alias("more"))
        met = up.join(over, ["graph", "pred"], "left").join(hop, ["graph", "pred"], "left")
        stuck = F.col("over").isNotNull()
        # what is stuck under a root that is no vertex, or at a head without a
        # row, has no such ancestor
        stays = met.where(~stuck | F.col("next").isNotNull())
        moved = stays.select("graph", "idx", F.when(stuck, F.col("next")).otherwise(F.col("pred")).alias("pred"), F.when(stuck, F.col("skipped") + F.col("more") + 1).otherwise(F.col("skipped")).alias("skipped"), stuck.alias("moves"))
        moved = cut(moved)
        up = moved.drop("moves")
        if moved.where("moves").isEmpty():
            break
    # pointers that still stand on words that are no vertices go round a ring
    done = up.join(over, ["graph", "pred"], "left_anti")
    return done.join(tokens.where("is_vertex").select("graph", "idx"), ["graph", "idx"], "left_semi")


def relationships(tokens: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, members) of vertices and their successors.

    Every vertex with successors in ``links`` is the root of an edge; of roots
    with one text in one sentence only the first. Edges are (graph, edge, root,
    start, end, father), ``edge`` the root's idx, places half open, ``father``
    the edge of the root's own predecessor if the sentences contain each other;
    members are (graph, edge, pos, idx) with the root at 0.
    """
    roots = links.select("graph", F.col("pred").alias("idx")).distinct().join(tokens, ["graph", "idx"])
    first = Window.partitionBy("graph", "text", "sent_start").orderBy("idx")
    kept = cut(roots.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("graph", F.col("idx").alias("edge"), "sent_start", "sent_end"))
    inside = links.join(kept.select("graph", F.col("edge").alias("pred")), ["graph", "pred"])
    order = Window.partitionBy("graph", "pred").orderBy("idx")
    others = inside.select("graph", F.col("pred").alias("edge"), F.row_number().over(order).alias("pos"), "idx")
    members = kept.select("graph", "edge", F.lit(0).alias("pos"), F.col("edge").alias("idx")).unionByName(others)
    spans = members.groupBy("graph", "edge").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"))
    above = kept.select("graph", F.col("edge").alias("father"), F.col("sent_start").alias("_s"), F.col("sent_end").alias("_e"))
    up = links.select("graph", F.col("idx").alias("edge"), F.col("pred").alias("father")).join(kept, ["graph", "edge"]).join(above, ["graph", "father"]).where("sent_start >= _s and sent_end <= _e").select("graph", "edge", "father")
    edges = kept.select("graph", "edge").join(spans, ["graph", "edge"]).join(up, ["graph", "edge"], "left")
    return edges.select("graph", "edge", F.col("edge").alias("root"), "start", "end", "father"), members


def vertex_ids(tokens: DataFrame) -> DataFrame:
    """(graph, idx, vertex_id): vertices with one lower-case text share an id,
    numbered from 1 by first place. Pronouns and verbs have ids of their own,
    unless ``antecedent`` names whom they stand for."""
    own = tokens.where("is_vertex")
    virtual = F.col("pos").isin("PRON", "AUX", "VERB")
    key = F.when(F.col("antecedent").isNotNull(), F.concat(F.lit("@"), F.col("antecedent").cast("string"))).when(virtual, F.concat(F.lit("@"), F.col("idx").cast("string"))).otherwise(F.lower("text"))
    keyed = own.select("graph", "idx", key.alias("key"), F.col("antecedent"))
    # one who is stood for is known by place and by text: its text decides
    named = keyed.select("graph", F.concat(F.lit("@"), F.col("idx").cast("string")).alias("key"), F.col("key").alias("_named"))
    keyed = keyed.join(named, ["graph", "key"], "left").select("graph", "idx", F.coalesce("_named", "key").alias("key"))
    first = keyed.groupBy("graph", "key").agg(F.min("idx").alias("_first"))
    numbered = first.withColumn("vertex_id", F.row_number().over(Window.partitionBy("graph").orderBy("_first")))
    return keyed.join(numbered, ["graph", "key"]).select("graph", "idx", "vertex_id")


def current_nodes(edges: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph, edge, vertex_id, idx): the token by which a vertex stands in an
    edge. First those of the edge's source and within its places, then of its
    source, then within its places, then any; the earliest of equals. A minimum
    for each rank is a number, so that rows are hashed and not sorted."""
    met = members.select("graph", "edge", "vertex_id").distinct().join(edges.select("graph", "edge", "start", "end", F.col("source").alias("_source")), ["graph", "edge"]).join(nodes.select("graph", "vertex_id", "idx", "source"), ["graph", "vertex_id"])
    near = (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end"))
    same = F.coalesce(F.col("source") == F.col("_source"), F.lit(False))
    rank = F.when(same & near, 0).when(same, 1).when(near, 2).otherwise(3)
    best = met.select("graph", "edge", "vertex_id", "idx", rank.alias("r")).groupBy("graph", "edge", "vertex_id").agg(*[F.min(F.when(F.col("r") == r, F.col("idx"))).alias(f"_{r}") for r in range(4)])
    return best.select("graph", "edge", "vertex_id", F.coalesce(*[f"_{r}" for r in range(4)]).alias("idx"))


def no_link(is_root_a: Column, is_root_b: Column, dep_a: Column, dep_b: Column) -> Column:
    """If two places of an edge must not be joined: out of the root, or between
    two that both have a main role."""
    both = dep_a.isin(*MAIN_ROLES) & dep_b.isin(*MAIN_ROLES)
    return F.when(is_root_a | is_root_b, is_root_a).otherwise(both)


def below(is_root_a: Column, is_root_b: Column, dep_a: Column, dep_b: Column, idx_a: Column, idx_b: Column) -> Column:
    """Orientation: root first, then subject, then other main role, then place."""
    rank = lambda dep: F.when(dep.isin(*WIDE_SUBJECTS), 0).when(dep.isin(*MAIN_ROLES), 1).otherwise(2)
    by_rank = F.when(rank(dep_a) != rank(dep_b), rank(dep_a) < rank(dep_b)).otherwise(idx_a < idx_b)
    return F.when(is_root_a, F.lit(True)).when(is_root_b, F.lit(False)).otherwise(by_rank)


def descendant_edges(heads: DataFrame, starts: DataFrame, edge_nodes: DataFrame, hops: int = 2) -> DataFrame:
    """(graph, start, edge): edges (graph, edge, idx) that hold a token at most
    ``hops`` steps below ``starts`` (graph, idx) in ``heads`` (graph, idx, head)."""
    reached = front = cut(starts.select("graph", F.col("idx").alias("start"), "idx"))
    arcs = heads.where("head is not null").select("graph", F.col("head").alias("idx"), F.col("idx").alias("child"))
    for _ in range(hops):
        front = cut(front.join(arcs, ["graph", "idx"]).select("graph", "start", F.col("child").alias("idx")).distinct().join(reached, ["graph", "start", "idx"], "left_anti"))
        reached = reached.unionByName(front)
    return reached.join(edge_nodes.select("graph", "edge", "idx"), ["graph", "idx"]).select("graph", "start", "edge").distinct()
