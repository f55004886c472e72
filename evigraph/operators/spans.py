"""Spans of tokens that become one: joins, phrases, mentions, entity levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vertex
from ..plans.tables import cut
from .mentions import CHARS, buckets

#: Dependencies that a phrase takes in on its left and right.
NOUN_LEFT, NOUN_RIGHT = ("advmod", "neg", "nummod", "quantmod", "npadvmod", "compound"), ("case", "advmod", "neg", "nummod", "quantmod", "npadvmod")
VERB_LEFT, VERB_RIGHT = ("aux", "auxpass", "neg", "advmod"), ("prt", "advmod", "acomp", "xcomp", "ccomp")
ADJ_LEFT, ADJ_RIGHT = ("advmod", "neg"), ("advmod", "neg", "npadvmod")
ARTICLES = ("the", "a", "an")
LONGEST, LEAST_SCORE = 5, 7.5
#: How well a part of speech stands for a mention's cluster.
MENTION_RANK = {"VERB": 10, "AUX": 10, "NOUN": 8, "PROPN": 8, "ADJ": 6, "NUM": 5, "ADV": 4, "ADP": 3, "PART": 2, "PRON": 0}


def first_free(items: DataFrame) -> DataFrame:
    """Those of ``items`` (graph, order, keys: an array) that are accepted when
    they are taken by rising order and one is refused if an accepted one has a
    key of it. Rounds: an item with the least order at all its keys is taken."""
    now, out = cut(items.select("graph", "order", "keys").distinct()), None
    while not now.isEmpty():
        at = now.select("graph", "order", F.explode("keys").alias("key"))
        first = at.groupBy("graph", "key").agg(F.min("order").alias("first"))
        late = at.join(first, ["graph", "key"]).where("first < order").select("graph", "order").distinct()
        free = cut(now.join(late, ["graph", "order"], "left_anti"))
        out = free if out is None else out.unionByName(free)
        taken = free.select("graph", F.explode("keys").alias("key"))
        hit = at.join(taken, ["graph", "key"], "left_semi").select("graph", "order").distinct()
        now = cut(now.join(hit, ["graph", "order"], "left_anti"))
    return now if out is None else out


def _free_spans(spans: DataFrame) -> DataFrame:
    """Spans (graph, order, start, end) that overlap none accepted before."""
    kept = first_free(spans.withColumn("keys", F.sequence("start", F.col("end") - 1)))
    return spans.join(kept.select("graph", "order"), ["graph", "order"]).select("graph", "start", "end")


def hyphen_spans(tokens: DataFrame) -> DataFrame:
    """(graph, start, end) of words joined by a hyphen that is a token of its
    own (unless a conjunct stands beside it) or an end of one; leftmost first."""
    w = Window.partitionBy("graph").orderBy("idx")
    seen = tokens.select("graph", "idx", "text", F.lag("dep").over(w).alias("before"), F.lead("dep").over(w).alias("after"))
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    alone = (F.col("text") == "-") & both & (F.col("before") != "conj") & (F.col("after") != "conj")
    right = (F.col("text") != "-") & F.col("text").endswith("-") & F.col("after").isNotNull()
    left = (F.col("text") != "-") & ~F.col("text").endswith("-") & F.col("text").startswith("-") & F.col("before").isNotNull()
    found = seen.where(alone | right | left).select("graph", F.col("idx").alias("order"), F.when(right, F.col("idx")).otherwise(F.col("idx") - 1).alias("start"), F.when(left, F.col("idx") + 1).otherwise(F.col("idx") + 2).alias("end"))
    return _free_spans(found)


def _run(children: DataFrame, ok: Column, left: bool) -> DataFrame:
    """(graph, head, n): how many children next to their head on one side are
    taken in, one after the other, until one is missing or not allowed."""
    side = children.where(F.col("idx") < F.col("head") if left else F.col("idx") > F.col("head"))
    order = Window.partitionBy("graph", "head").orderBy(F.desc("idx") if left else "idx")
    placed = side.withColumn("_n", F.row_number().over(order))
    near = F.abs(F.col("idx") - F.col("head")) == F.col("_n")
    whole = placed.withColumn("_ok", F.min((ok & near).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.where("_ok = 1").groupBy("graph", "head").agg(F.count(F.lit(1)).alias("n"))


def phrase_spans(tokens: DataFrame, poses: tuple[str, ...], left: Column, right: Column, longest: int | None = None) -> DataFrame:
    """(graph, start, end) of tokens of ``poses`` with the children beside them
    for which ``left`` or ``right`` holds, of two tokens to ``longest``; of
    those that overlap the first stays."""
    heads = tokens.where(F.col("pos").isin(*poses)).select("graph", F.col("idx").alias("head"), F.col("text").alias("head_text"))
    children = tokens.where("head is not null").join(heads, ["graph", "head"])
    sides = heads.join(_run(children, left, True).withColumnRenamed("n", "_l"), ["graph", "head"], "left").join(_run(children, right, False).withColumnRenamed("n", "_r"), ["graph", "head"], "left").fillna(0, ["_l", "_r"])
    spans = sides.select("graph", F.col("head").alias("order"), (F.col("head") - F.col("_l")).alias("start"), (F.col("head") + F.col("_r") + 1).alias("end")).where("end - start > 1")
    return _free_spans(spans if longest is None else spans.where(F.col("end") - F.col("start") <= longest))


def noun_spans(tokens: DataFrame, scores: DataFrame | None = None, is_query: bool = False) -> DataFrame:
    """Noun phrases of up to ``LONGEST`` tokens. An adjective belongs to one if
    the two words' log-likelihood in ``scores`` (a, b, llr) is ``LEAST_SCORE``
    or more; a determiner if it is no article. In questions, proper nouns and
    question words stay apart."""
    likely = F.lit(False)
    if scores is not None:
        heads = tokens.select("graph", F.col("idx").alias("head"), F.lower("text").alias("_b"))
        strong = scores.where(F.col("llr") >= LEAST_SCORE).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_strong"))
        tokens = tokens.withColumn("_a", F.lower("text")).join(heads, ["graph", "head"], "left").join(strong, ["_a", "_b"], "left").drop("_a", "_b")
        likely = F.coalesce("_strong", F.lit(False))
    plain = F.col("dep").isin(*NOUN_LEFT) | ((F.col("dep") == "det") & ~F.lower("text").isin(*ARTICLES))
    if is_query:
        plain = plain & ~((F.col("dep") == "compound") & (F.col("pos") == "PROPN")) & ~((F.col("dep") == "det") & F.lower("text").isin("which", "what", "whichever", "whatever"))
    return phrase_spans(tokens, ("NOUN",), F.when(F.col("dep") == "amod", likely).otherwise(plain), F.col("dep").isin(*NOUN_RIGHT), LONGEST)


def verb_spans(tokens: DataFrame) -> DataFrame:
    return phrase_spans(tokens, ("VERB",), F.col("dep").isin(*VERB_LEFT), F.col("dep").isin(*VERB_RIGHT))


def adjective_spans(tokens: DataFrame) -> DataFrame:
    return phrase_spans(tokens, ("ADJ",), F.col("dep").isin(*ADJ_LEFT), F.col("dep").isin(*ADJ_RIGHT))


def repeated_spans(tokens: DataFrame, n: int) -> DataFrame:
    """(graph, start, end) of runs of ``n`` tokens whose lower-case words occur
    more than once in their graph."""
    w = Window.partitionBy("graph").orderBy("idx").rowsBetween(0, n - 1)
    runs = tokens.select("graph", "idx", F.collect_list(F.lower("text")).over(w).alias("_w")).where(F.size("_w") == n)
    often = runs.groupBy("graph", "_w").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    return runs.join(often, ["graph", "_w"]).select("graph", F.col("idx").alias("start"), (F.col("idx") + n).alias("end"))


def merge_spans(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """(graph, idx, text, pos, dep, head, ent) with the tokens of each span in
    one, at the span's start: words joined by a space, the rest of the token
    whose head lies outside (the first of several)."""
    held = tokens.select("graph", "idx").join(spans.select("graph", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"), F.col("start").alias("_to")), ["graph", "idx"])
    placed = tokens.join(held, ["graph", "idx"], "left").withColumn("_to", F.coalesce("_to", "idx"))
    heads = held.select("graph", F.col("idx").alias("head"), F.col("_to").alias("_head"))
    moved = placed.join(heads, ["graph", "head"], "left").withColumn("_head", F.coalesce("_head", "head"))
    outside = F.when(F.col("_head").isNull() | (F.col("_head") != F.col("_to")), F.col("idx"))
    best = lambda c: F.min_by(c, outside).alias(c)
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    return moved.groupBy("graph", F.col("_to")).agg(words.alias("text"), best("pos"), best("dep"), F.min_by("_head", outside).alias("head"), best("ent")).select("graph", F.col("_to").alias("idx"), "text", "pos", "dep", "head", "ent")


def level_order(tokens: DataFrame, up: bool = False) -> DataFrame:
    """(graph, idx, depth, place): tokens by depth, or from the deepest ``up``,
    then by idx. Tokens that reach no root have no place."""
    front = cut(tokens.where("head is null").select("graph", "idx", F.lit(0).alias("depth")))
    arcs, out = tokens.where("head is not null").select("graph", F.col("head"), F.col("idx").alias("child")), front
    while not front.isEmpty():
        front = cut(front.withColumnRenamed("idx", "head").join(arcs, ["graph", "head"]).select("graph", F.col("child").alias("idx"), (F.col("depth") + 1).alias("depth")))
        out = out.unionByName(front)
    order = Window.partitionBy("graph").orderBy(F.desc("depth") if up else "depth", "idx")
    return out.withColumn("place", F.row_number().over(order))


def tokens_of_chars(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """(graph, span, start, end): the tokens (graph, idx, char_start, char_end)
    that the character spans (graph, span, char_start, char_end) touch."""
    at = tokens.select("graph", "idx", F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    at = at.withColumn("_bucket", F.explode(buckets(F.col("_s"), F.col("_e"), CHARS)))
    asked = spans.withColumn("_bucket", F.explode(buckets(F.col("char_start"), F.col("char_end"), CHARS)))
    met = asked.join(at, ["graph", "_bucket"]).where((F.col("_s") < F.col("char_end")) & (F.col("char_start") < F.col("_e")))
    return met.groupBy("graph", "span").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"))


def primary_mentions(mentions: DataFrame) -> DataFrame:
    """``mentions`` (graph, cluster, idx, text, pos, ent, lemma, in_primary)
    with ``primary``, the place of the one that stands for the cluster, and
    ``resolved``: its text, a verb's lemma, for itself and for pronouns.

    It is an entity before others, then by part of speech, in a primary span,
    longer, and earlier; a bare "to" comes last. Clusters of one are left out."""
    rank = F.lit(1)
    for pos, n in MENTION_RANK.items():
        rank = F.when(F.col("pos") == pos, n).otherwise(rank)
    rank = rank - F.when((F.col("pos") == "PART") & (F.lower("text") == "to"), 100).otherwise(0)
    verb = F.col("pos").isin("VERB", "AUX")
    own = F.when(verb & ~F.lower("text").startswith("to ") & F.col("lemma").isNotNull() & ~F.lower("lemma").isin("to") & (F.lower("lemma") != F.lower("text")), F.col("lemma")).otherwise(F.col("text"))
    given = F.when(verb, F.coalesce("lemma", "text")).otherwise(F.col("text"))
    order = F.struct((F.col("ent") != vertex.NONE).cast("int"), rank, F.col("in_primary").cast("int"), F.length("text"), -F.col("idx"))
    best = mentions.groupBy("graph", "cluster").agg(F.max_by(F.struct("idx", given.alias("given")), order).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("graph", "cluster", F.col("m.idx").alias("primary"), F.col("m.given").alias("_given"))
    resolved = F.when(F.col("idx") == F.col("primary"), own).when(F.col("pos") == "PRON", F.col("_given"))
    return mentions.join(best, ["graph", "cluster"]).withColumn("resolved", resolved).drop("_given")


def entity_levels(paths: DataFrame, names: DataFrame, stop_at_none: bool) -> DataFrame:
    """(id, entity) of hypernym paths (id, path: from the root to the word) by
    a dictionary (name, entity): the deepest entry's, CONCEPT only if there is
    nothing better. An entry NOT_ENT is passed over, or ends the search (no
    entity) if ``stop_at_none``. Without an entry NOT_ENT, or null."""
    met = paths.select("id", F.posexplode("path").alias("depth", "name")).join(names, "name")
    real = met.where("entity <> 'CONCEPT'" if stop_at_none else "entity not in ('CONCEPT', 'NOT_ENT')")
    deepest = real.groupBy("id").agg(F.max_by("entity", "depth").alias("_best"))
    concept = met.where("entity = 'CONCEPT'").select("id").distinct().withColumn("_concept", F.lit("CONCEPT"))
    joined = paths.select("id").join(deepest, "id", "left").join(concept, "id", "left")
    if stop_at_none:
        # a concept deeper than the entry that ends the search does not count
        return joined.select("id", F.when(F.coalesce("_best", "_concept") != "NOT_ENT", F.coalesce("_best", "_concept")).alias("entity"))
    return joined.select("id", F.coalesce("_best", "_concept", F.lit("NOT_ENT")).alias("entity"))


def step_vertices(steps: DataFrame) -> DataFrame:
    """(instance, step, question, ids) of (instance, step from 1, question,
    local, answer, valid: arrays of ids): own ids that are valid, and the answer
    ids of each earlier step that ``#k`` in the question names."""
    usable = lambda c: F.array_distinct(F.filter(c, lambda i: F.array_contains("valid", i)))
    own = steps.select("instance", "step", "question", usable("local").alias("local"), usable("answer").alias("answer"))
    named = own.select("instance", "step", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(r"#(\d+)"), F.lit(1)), lambda k: k.cast("int")))).alias("_k")).where("_k < step")
    given = own.select("instance", F.col("step").alias("_k"), F.col("answer").alias("_ids"))
    more = named.join(given, ["instance", "_k"]).groupBy("instance", "step").agg(F.flatten(F.collect_list("_ids")).alias("_more"))
    ids = F.array_sort(F.array_union(F.array_union("local", "answer"), F.coalesce("_more", F.array().cast("array<bigint>"))))
    return own.join(more, ["instance", "step"], "left").select("instance", "step", "question", ids.alias("ids"))


def group_links(groups: DataFrame) -> DataFrame:
    """(graph, a, b, bridge): groups (graph, group, node) that share nodes, with
    the smallest shared one; paths of groups are hyperpaths over nodes."""
    side = lambda n: groups.select("graph", F.col("group").alias(n), "node")
    return side("a").join(side("b"), ["graph", "node"]).where("a < b").groupBy("graph", "a", "b").agg(F.min("node").alias("bridge"))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
