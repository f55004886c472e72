"""Vertex algebra over columns ``poses``, ``ents`` (arrays) and ``type``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of speech that count as one; the first group decides.
POS_GROUPS = (("VERB", "AUX"), ("NOUN", "PROPN", "PRON"), ("CCONJ", "SCONJ"), ("PUNCT", "SYM", "X"))
#: Named entities that count as one; the first group decides.
ENT_GROUPS = (("PERSON", "NORP"), ("GPE", "LOC", "FAC", "ORG", "NORP"), ("DATE", "TIME"), ("PRODUCT", "WORK_OF_ART"), ("MONEY", "PERCENT", "QUANTITY", "CARDINAL"), ("EVENT", "LAW", "LANGUAGE"))
NONE = "NOT_ENTITY"
#: How specific each type is.
LEVELS = {
    0: ("NOT_ENT",),
    1: ("CONCEPT",),
    2: ("NUMBER", "PRODUCT", "EVENT", "ACTION"),
    3: ("ORGANISM", "FOOD", "MEDICAL", "ANATOMY", "SUBSTANCE", "ASTRO", "AWARD", "VEHICLE", "WORK_OF_ART", "THEORY", "FEATURE", "ECONOMIC", "SOCIOLOGY", "PHENOMENON"),
    4: ("TEMPORAL", "PERSON", "LOC", "ORG", "FAC", "GPE", "NORP", "LAW", "LANGUAGE", "OCCUPATION", "GROUP"),
    5: ("COUNTRY",),
}
#: Entities that become a coarser type; others keep their name.
COARSE = {"TEMPORAL": ("DATE", "TIME"), "NUMBER": ("PERCENT", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL")}
#: Types that match each other in hard mode.
TYPE_GROUPS = {
    "LOC_ORG_GROUP": ("LOC", "ORG", "FAC", "GPE", "NORP", "GROUP", "COUNTRY"),
    "PERSON_GROUP": ("PERSON",),
    "PRODUCT_GROUP": ("PRODUCT", "WORK_OF_ART"),
    "OCCUPATION_GROUP": ("OCCUPATION",),
    "NUMBER_GROUP": ("NUMBER",),
    "TEMPORAL_GROUP": ("TEMPORAL",),
    "ABSTRACT_GROUP": ("CONCEPT", "THEORY", "FEATURE", "PHENOMENON"),
    "EVENT_GROUP": ("EVENT",),
}
#: Types that answer a question word.
ANSWERS = {
    "PERSON": ("PERSON",),
    "TIME": ("TEMPORAL",),
    "LOCATION": ("GPE", "LOC", "FAC", "ORG", "COUNTRY"),
    "NUMBER": ("NUMBER",),
    "BELONGS": ("PERSON", "ORG", "GPE", "COUNTRY", "GROUP"),
}


def _grouped(value: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """The members that count as ``value``: its first group, or itself."""
    out = F.array(value)
    for g in reversed(groups):
        out = F.when(value.isin(*g), F.array(*map(F.lit, g))).otherwise(out)
    return out


def pos_range(poses: Column, pos: Column) -> Column:
    return F.arrays_overlap(poses, _grouped(pos, POS_GROUPS))


def ent_range(ents: Column, ent: Column) -> Column:
    return F.arrays_overlap(ents, _grouped(ent, ENT_GROUPS))


def shared(a: Column, b: Column) -> Column:
    """If two arrays share a member; empty ones share none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def is_domain(a: Column, b: Column, hypernyms_a: Column | None = None, hypernyms_b: Column | None = None) -> Column:
    """If both have entities, whether their groups meet; if one has, false; if
    none, whether hypernyms meet, and false where they are not known."""
    real = lambda ents: F.filter(ents, lambda e: e != NONE)
    has_a, has_b = F.size(real(a)) > 0, F.size(real(b)) > 0
    meets = F.exists(real(b), lambda e: ent_range(a, e))
    words = F.lit(False) if hypernyms_a is None else shared(hypernyms_a, hypernyms_b)
    return F.when(has_a & has_b, meets).when(has_a != has_b, F.lit(False)).otherwise(words)


def any_pos(poses: Column, *names: str) -> Column:
    return F.exists(poses, lambda p: p.isin(*names))


def all_pos(poses: Column, *names: str) -> Column:
    """True for no members at all."""
    return F.forall(poses, lambda p: p.isin(*names))


def same_provenance(a: Column, b: Column) -> Column:
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def coarse(ent: Column) -> Column:
    """The type of a named entity."""
    out = F.when(ent == NONE, "NOT_ENT").otherwise(ent)
    for name, members in COARSE.items():
        out = F.when(ent.isin(*members), name).otherwise(out)
    return out


def level(kind: Column) -> Column:
    out = F.lit(0)
    for n, members in LEVELS.items():
        out = F.when(kind.isin(*members), n).otherwise(out)
    return out


def vertex_type(kinds: Column, poses: Column) -> Column:
    """The most specific type of the nodes, the later of equals; else NUMBER
    if a node is NUM; else null."""
    real = F.filter(kinds, lambda k: k.isNotNull() & (k != "NOT_ENT"))
    best = F.array_max(F.transform(real, lambda k, i: F.struct(level(k).alias("l"), i.alias("i"), k.alias("k"))))["k"]
    return F.coalesce(best, F.when(F.array_contains(poses, "NUM"), "NUMBER"))


def strict_type_group(kind: Column, poses: Column) -> Column:
    """The group that hard matching compares: an equi-join key."""
    out = F.when(any_pos(poses, "ADJ"), "NO_ENT_ADJ_GROUP").when(any_pos(poses, "ADV"), "NO_ENT_ADV_GROUP").otherwise("NO_ENT_OTHER")
    out = F.when(kind.isNotNull() & (kind != "NOT_ENT"), F.concat(F.lit("ENT::"), kind)).otherwise(out)
    for name, members in TYPE_GROUPS.items():
        out = F.when(kind.isin(*members), name).otherwise(out)
    return F.when(any_pos(poses, "VERB"), "VERB_GROUP").otherwise(out)


def answers_query(query_type: Column, kind: Column, poses: Column) -> Column:
    """If a data vertex can answer a question word, by type and part of speech."""
    out = F.lit(False)
    for name, members in ANSWERS.items():
        out = F.when(query_type == name, kind.isin(*members)).otherwise(out)
    nounlike = (kind.isNotNull() & (kind != "NOT_ENT")) | any_pos(poses, "NOUN", "PROPN", "PRON")
    out = F.when(query_type.isin("WHAT", "WHICH"), nounlike).otherwise(out)
    out = F.when(query_type == "ATTRIBUTE", any_pos(poses, "ADJ", "ADV")).otherwise(out)
    out = F.when(query_type == "REASON", ~any_pos(poses, "PUNCT")).otherwise(out)
    return F.coalesce(out, F.lit(False))


def is_critical(ents: Column, poses: Column) -> Column:
    """A node to trace: an entity, or a noun."""
    return F.exists(ents, lambda e: e != NONE) | any_pos(poses, "NOUN", "PROPN")


def entities_compatible(a: Column, b: Column, poses_a: Column, poses_b: Column) -> Column:
    """The same first entity, or none in both and a proper noun in both."""
    main = lambda ents: F.coalesce(F.get(F.filter(ents, lambda e: e != NONE), 0), F.lit(NONE))
    proper = F.array_contains(poses_a, "PROPN") & F.array_contains(poses_b, "PROPN")
    return (main(a) == main(b)) & ((main(a) != NONE) | proper)


def match_confidence(text_a: Column, text_b: Column, ents_a: Column, ents_b: Column, poses_a: Column, poses_b: Column) -> Column:
    """.5 for equal texts, .3 for a shared entity, .2 for a shared part of speech."""
    part = lambda condition, weight: F.when(condition, weight).otherwise(0.0)
    return part(F.trim(text_a) == F.trim(text_b), 0.5) + part(shared(ents_a, ents_b), 0.3) + part(shared(poses_a, poses_b), 0.2)


#: Dependencies that may stand for each other.
ROLES = (("nsubj", "nsubjpass", "csubj", "agent"), ("dobj", "iobj", "pobj", "attr"), ("amod", "nmod", "advmod", "appos"), ("nmod", "dobj"))


def roles_compatible(dep_a: Column, dep_b: Column) -> Column:
    """If two dependencies have one role: subject, object, modifier, or a modifier
    of nouns and a direct object. False for others and for null."""
    out = F.lit(False)
    for role in ROLES:
        out = out | (dep_a.isin(*role) & dep_b.isin(*role))
    return F.coalesce(out, F.lit(False))


def legal(label: Column, domain: Column, dep_a: Column, dep_b: Column) -> Column:
    """If two vertices may stand for each other: their texts entail, or are neutral
    in one domain (unknown is none), and their roles are compatible."""
    meaning = (label == "entailment") | ((label == "neutral") & F.coalesce(domain, F.lit(False)))
    return F.coalesce(meaning, F.lit(False)) & roles_compatible(dep_a, dep_b)
