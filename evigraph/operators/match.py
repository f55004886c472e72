"""Typed vertex matching: allowed pairs, top-b, slices, D-Match."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, vector, vertex
from ..plans.tables import Rounds

Scorer = Callable[[Column, Column], Column]


def lexical_entailment(premise: Column, hypothesis: Column) -> Column:
    """Default scorer, lexical and deterministic: the share of the hypothesis's
    distinct tokens that the premise has. It is no language model."""
    p, h = F.array_distinct(text.tokens(premise, True)), F.array_distinct(text.tokens(hypothesis, True))
    return F.when(F.size(h) == 0, 0.0).otherwise(F.size(F.array_intersect(p, h)) / F.size(h))


def lexical_label(premise: Column, hypothesis: Column) -> Column:
    """entailment from .99, neutral from .2, else contradiction."""
    score = lexical_entailment(premise, hypothesis)
    return F.when(score >= 0.99, "entailment").when(score >= 0.2, "neutral").otherwise("contradiction")


def allowed_pairs(query: DataFrame, data: DataFrame, scorer: Scorer = lexical_entailment, label: Scorer | None = lexical_label) -> DataFrame:
    """(instance, u, v, score) of query and data vertices that match in type.

    Both have instance, vertex_id, text, type, poses, virtual; the query side
    also query_type. Vertices without a question word meet by an equi-join on
    their type group; those with one by a join on what answers it, a rule per
    group. Pairs labelled contradiction go; the data text is the premise. The
    lexical label needs a common token, so with it pairs meet by tokens instead.
    """
    usable = lambda df: df.where("trim(text) <> '' and not virtual")
    q = usable(query).select("instance", F.col("vertex_id").alias("u"), F.col("text").alias("u_text"), vertex.strict_type_group(F.col("type"), F.col("poses")).alias("u_group"), "query_type")
    d = usable(data).select("instance", F.col("vertex_id").alias("v"), F.col("text").alias("v_text"), F.col("type").alias("v_type"), F.col("poses").alias("v_poses"), vertex.strict_type_group(F.col("type"), F.col("poses")).alias("v_group"))
    columns, on = ["instance", "u", "v", "u_text", "v_text"], []
    if label is lexical_label:
        on = ["_token"]
        met = lambda df, body: df.withColumn("_token", F.explode(F.array_distinct(text.tokens(F.col(body), True))))
        q, d = met(q, "u_text"), met(d, "v_text")
    kinds = [k for k in (*vertex.ANSWERS, "WHAT", "WHICH", "ATTRIBUTE", "REASON")]
    able = F.filter(F.array(*[F.when(vertex.answers_query(F.lit(k), F.col("v_type"), F.col("v_poses")), k) for k in kinds]), lambda k: k.isNotNull())
    if on:
        # tokens meet in few places, so types are compared there: one join, and no row for each kind
        met = q.join(d, ["instance", *on])
        fits = F.when(F.col("query_type").isNull(), F.col("u_group") == F.col("v_group")).otherwise(F.array_contains(able, F.col("query_type")))
        pairs = met.where(fits).select(columns).dropDuplicates(["instance", "u", "v"])
    else:
        plain = q.where("query_type is null").join(d.withColumnRenamed("v_group", "u_group"), ["instance", "u_group"])
        asked = q.where("query_type is not null").join(d.withColumn("query_type", F.explode(able)), ["instance", "query_type"])
        pairs = plain.select(columns).unionByName(asked.select(columns))
    if label is not None:
        pairs = pairs.where(label(F.col("v_text"), F.col("u_text")) != "contradiction")
    return pairs.select("instance", "u", "v", scorer(F.col("v_text"), F.col("u_text")).alias("score"))


def soft_match(query_type: Column, u_text: Column, v_text: Column, u_ents: Column, v_ents: Column, v_poses: Column, label: Column, label_gates_entities: bool = False) -> Column:
    """Struct (allowed, reason) of a pair by the soft rules: empty texts never;
    a question word by what can answer it; two entities by a group that holds
    both, and by the label too if ``label_gates_entities``; else by the label,
    which must not be contradiction."""
    ranged = lambda *names: vertex.shared(v_ents, F.array(*[F.lit(n) for e in names for n in next((g for g in vertex.ENT_GROUPS if e in g), (e,))]))
    real = lambda ents: F.exists(ents, lambda e: e != vertex.NONE)
    answered = (
        F.when(query_type == "PERSON", ranged("PERSON"))
        .when(query_type == "TIME", ranged("DATE", "TIME"))
        .when(query_type == "LOCATION", ranged("GPE", "LOC"))
        .when(query_type == "NUMBER", ranged("CARDINAL", "QUANTITY") | vertex.any_pos(v_poses, "NUM"))
        .when(query_type == "BELONGS", ranged("PERSON", "ORG", "GPE"))
        .when(query_type.isin("WHAT", "WHICH"), real(v_ents) | vertex.any_pos(v_poses, "NOUN", "PROPN", "PRON"))
        .when(query_type == "ATTRIBUTE", vertex.any_pos(v_poses, "ADJ", "ADV"))
        .when(query_type == "REASON", ~vertex.any_pos(v_poses, "PUNCT"))
        .otherwise(F.lit(False))
    )
    meets = F.lit(False)
    for group in vertex.ENT_GROUPS:
        held = F.array(*map(F.lit, group))
        meets = meets | (vertex.shared(u_ents, held) & vertex.shared(v_ents, held))
    if label_gates_entities:
        meets = meets & (label != "contradiction")
    out = lambda ok, why: F.struct(F.coalesce(ok, F.lit(False)).alias("allowed"), F.lit(why).alias("reason"))
    return (
        F.when((F.trim(u_text) == "") | (F.trim(v_text) == ""), out(F.lit(False), "empty"))
        .when(query_type.isNotNull(), out(answered, "query type"))
        .when(real(u_ents) & real(v_ents), out(meets, "entities"))
        .otherwise(out(label != "contradiction", "label"))
    )


def entailed_or_neutral(label: Column, same_domain: Column) -> Column:
    """An entailed pair, or a neutral one of one domain."""
    return (label == "entailment") | ((label == "neutral") & same_domain)


def matched_vertices(query: DataFrame, data: DataFrame, scorer: Scorer = lexical_entailment, label: Scorer = lexical_label) -> DataFrame:
    """(instance, u, v, score) of vertices (instance, vertex_id, text, ents,
    virtual) that are entailed, or neutral and of one domain. Each pair of texts
    is labelled once. Only the vertices of one instance meet."""
    side = lambda df, n: df.where("not virtual").select("instance", F.col("vertex_id").alias(n), F.col("text").alias(f"{n}_text"), F.col("ents").alias(f"{n}_ents"))
    pairs = side(query, "u").join(side(data, "v"), "instance")
    texts = pairs.select("u_text", "v_text").distinct()
    scored = texts.withColumns({"label": label(F.col("v_text"), F.col("u_text")), "score": scorer(F.col("v_text"), F.col("u_text"))})
    met = pairs.join(scored, ["u_text", "v_text"]).where(entailed_or_neutral(F.col("label"), vertex.is_domain(F.col("u_ents"), F.col("v_ents"))))
    return met.select("instance", "u", "v", "score")


def simulation_quads(edge_vertices: DataFrame, relation: DataFrame) -> DataFrame:
    """(instance, u, x, v, y): two vertices of one edge (the smaller first) and
    a match of each."""
    side = lambda n: edge_vertices.select("instance", "edge", F.col("vertex_id").alias(n))
    pairs = side("u").join(side("x"), ["instance", "edge"]).where("u < x").select("instance", "u", "x").distinct()
    return pairs.join(relation.select("instance", "u", "v"), ["instance", "u"]).join(relation.select("instance", F.col("u").alias("x"), F.col("v").alias("y")), ["instance", "x"])


def canonical_types(data: DataFrame, query: DataFrame) -> DataFrame:
    """``data`` (instance, text, type, …) with the type of the query vertex of
    the same lower-case text, the smallest of several; others keep theirs."""
    key = F.lower(F.trim("text"))
    forced = query.where("type is not null").groupBy("instance", key.alias("_key")).agg(F.min("type").alias("_forced"))
    joined = data.withColumn("_key", key).join(forced, ["instance", "_key"], "left")
    return joined.select(*[F.coalesce("_forced", "type").alias(c) if c == "type" else F.col(c) for c in data.columns])


def vertices_of_nodes(nodes: DataFrame) -> DataFrame:
    """(graph, vertex_id, text, poses, ents, query_type, provenance) of tokens
    (graph, vertex_id, idx, text, pos, ent, query_type, source): text and first
    type asked for by place, the others without repeats."""
    return nodes.groupBy("graph", "vertex_id").agg(
        F.min_by("text", "idx").alias("text"),
        F.array_sort(F.collect_set("pos")).alias("poses"),
        F.array_sort(F.collect_set("ent")).alias("ents"),
        F.min_by("query_type", F.when(F.col("query_type").isNotNull(), F.col("idx"))).alias("query_type"),
        F.array_sort(F.collect_set("source")).alias("provenance"),
    )


def migrate_types(vertices: DataFrame, known: DataFrame) -> DataFrame:
    """``vertices`` (instance, text, type, …) with the type that ``known``
    (instance, text, type, place) gives their lower-case text, the last place's."""
    key = lambda c: F.lower(F.trim(c))
    best = known.where("type is not null").groupBy("instance", key("text").alias("_key")).agg(F.max_by("type", "place").alias("_known"))
    joined = vertices.withColumn("_key", key("text")).join(best, ["instance", "_key"], "left")
    return joined.select(*[F.coalesce("_known", "type").alias(c) if c == "type" else F.col(c) for c in vertices.columns], F.when(F.col("_known").isNull(), "unchanged").when(F.col("type").isNull(), "filled").when(F.col("type") != F.col("_known"), "fixed").otherwise("unchanged").alias("change"))


def top_b(pairs: DataFrame, b: int = 5, by: tuple[str, ...] = ("instance", "u")) -> DataFrame:
    """The ``b`` best pairs of each query vertex; ties to the smaller v."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "v")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= b)


def provenance_slices(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(instance, slice, u, v): pairs under each source of their data vertex."""
    sources = vertices.select("instance", F.col("vertex_id").alias("v"), F.explode("provenance").alias("slice"))
    return pairs.join(sources, ["instance", "v"]).select("instance", "slice", "u", "v")


def rank_slices(slices: DataFrame, needed: DataFrame | None, k: int) -> DataFrame:
    """Slices by how many needed query vertices they cover; those that tie with
    the k-th stay, so more than k may. Without needed ones each counts 1."""
    if k <= 0:
        return slices.select("instance", "slice").limit(0).withColumns({"hits": F.lit(0).cast("long"), "rank": F.lit(0)})
    if needed is None:
        hits = slices.select("instance", "slice").distinct().withColumn("hits", F.lit(1).cast("long"))
    else:
        hit = slices.select("instance", "slice", "u").distinct().join(needed.select("instance", "u").distinct(), ["instance", "u"])
        hits = slices.select("instance", "slice").distinct().join(hit.groupBy("instance", "slice").agg(F.count(F.lit(1)).alias("hits")), ["instance", "slice"], "left").fillna(0, ["hits"])
    order = Window.partitionBy("instance").orderBy(F.desc("hits"))
    return hits.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= k)


def slice_consistency(slices: DataFrame, needed: DataFrame) -> DataFrame:
    """If a slice has every needed vertex; vacuously true for none."""
    want = needed.select("instance", "u").distinct()
    every = slices.select("instance", "slice").distinct()
    missing = every.join(want, "instance").join(slices.select("instance", "slice", "u").distinct(), ["instance", "slice", "u"], "left_anti").select("instance", "slice").distinct().withColumn("gap", F.lit(True))
    return every.join(missing, ["instance", "slice"], "left").select("instance", "slice", F.col("gap").isNull().alias("consistent"))


def refine_slices(slices: DataFrame, answers: DataFrame) -> DataFrame:
    """``slices(…, u, v, v_text)``: where a v's text is the answer, only the
    last such v stays for its u."""
    joined = slices.join(answers.select("instance", "answer"), "instance", "left")
    hit = F.lower(F.trim("v_text")) == F.lower(F.trim("answer"))
    last = Window.partitionBy("instance", "slice", "u")
    return joined.withColumn("best", F.max(F.when(hit, F.col("v"))).over(last)).where("best is null or v = best").drop("best", "answer")


def dmatch_scores(rows: DataFrame, delta: float = 0.7) -> DataFrame:
    """From (pair, u, v, place, score): the mean over places of each place's
    greatest score, where it is over ``delta``."""
    best = rows.groupBy("pair", "u", "v", "place").agg(F.max("score").alias("best"))
    return best.groupBy("pair", "u", "v").agg(F.avg("best").alias("score")).where(F.col("score") > delta)


def greedy_one_to_one(scores: DataFrame) -> DataFrame:
    """Of (pair, u, v, score), best first (ties to the smaller u, v), those of
    which neither end is taken yet.

    Rounds: rows that are best for both their ends are taken and their ends
    leave. As score, u and v order all rows, that gives the same rows as one
    pass from the top, and minima combine before the shuffle. A minimum is a
    whole row, so the best of both ends meet without the other rows."""
    now = scores.select("pair", "u", "v", "score").where("pair is not null and u is not null and v is not null")
    taken, left = Rounds(scores.sparkSession), Rounds(scores.sparkSession)
    first = F.struct((-F.col("score")).alias("s"), "u", "v")
    while True:
        best = lambda end: now.groupBy("pair", end).agg(F.min(first).alias(f"_{end}"))  # noqa: B023, E731
        of_v = best("v").select("pair", F.col("_v.u").alias("u"), "_v")
        both = best("u").join(of_v, ["pair", "u"]).where(F.col("_u") == F.col("_v"))
        found = taken.add(both.select("pair", "u", F.col("_u.v").alias("v"), (-F.col("_u.s")).alias("score")))
        if found.isEmpty():
            return taken.all().select(scores.columns)
        for end in ("u", "v"):
            now = now.join(found.select("pair", end), ["pair", end], "left_anti")
        now = left.add(now)


def cluster_pairs(query: DataFrame, data: DataFrame, sigma: float = 0.75) -> DataFrame:
    """(instance, q, d, score) of clusters with a cosine of ``sigma`` or more,
    and of one half in any case; clusters without text take no part."""
    side = lambda df, name: df.where("text <> ''").select("instance", F.col("cluster_id").alias(name), F.col("embedding").alias(f"{name}_vector"))
    pairs = side(query, "q").join(side(data, "d"), "instance").withColumn("score", vector.cosine(F.col("q_vector"), F.col("d_vector")))
    return pairs.where(F.col("score") >= max(sigma, 0.5)).select("instance", "q", "d", "score")


def word_overlap_pairs(query: DataFrame, data: DataFrame) -> DataFrame:
    """Pairs whose data text holds a query word of over three letters: met
    through an inverted index on words, not by a cross product."""
    words = lambda df, name: df.select("instance", F.col("vertex_id").alias(name), F.explode(F.array_distinct(text.tokens(F.col("text"), True))).alias("word"))
    q = words(query, "u").where("length(word) > 3")
    return q.join(words(data, "v"), ["instance", "word"]).select("instance", "u", "v").distinct()


def with_embedding(df: DataFrame, body: str, out: str, size: int = 64) -> DataFrame:
    """Adds ``out``, the default embedding, which is lexical: tokens counted in
    ``size`` hashed places, scaled to length 1. Staged, so that no step is
    computed again for each element."""
    places = F.transform(text.tokens(F.col(body), True), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    staged = df.withColumn("_places", places)
    counts = F.array(*[(F.size("_places") - F.size(F.array_remove("_places", i))).cast("double") for i in range(size)])
    norm = F.greatest(vector.norm(F.col("_counts")), F.lit(1e-10))
    # an outer lambda holds the norm: a column would be put in for each element
    scaled = F.get(F.transform(F.array(norm), lambda n: F.transform("_counts", lambda c: c / n)), F.lit(0))
    return staged.withColumn("_counts", counts).withColumn(out, scaled).drop("_places", "_counts")


def batches_of(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items, for scorers that work in batches."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
