"""Operator 7: SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Words, connected_components, forget, small, stored
from .lines import candidates, rest_links, rest_places, sized_id
from .substrings import cut

SEED = 42
#: Entries of one key that a task compares with all probes of that key.
BLOCK = 4096
#: Documents that are fingerprinted together, which bounds a worker's memory.
STEP = 512
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half of the unsigned ``hashes``."""
    if not len(hashes):
        return 0
    lanes = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(8) * 256
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes)).tobytes(), "big")


def text_fingerprints(texts: list[str | None], shingle: int) -> list[int]:
    """The fingerprint of every text's word shingles, repeats counted."""
    words = Words([(t or "").encode().translate(_LOWER) for t in texts])
    digest, out = xxhash.xxh64_intdigest, []
    size = words.end - words.start + 1
    for text, first, last in zip(cut(words, np.zeros(len(words.start), bool)), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if first == last:
            out.append(0)
            continue
        joined = text.encode()
        ends = np.cumsum(size[first:last])
        begin, end = (ends - size[first:last]).tolist(), (ends - 1).tolist()
        end = end[shingle - 1 :] or end[-1:]
        out.append(fingerprint(np.array([digest(joined[s:e], SEED) for s, e in zip(begin, end)], np.uint64)))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long, content long) of ``docs(doc_id, text)``: the
    fingerprint's bits as a signed long, and a hash of id and text. Only A-Z are lower-cased. Null, empty and word-less texts have
    fingerprint 0, texts under ``shingle`` words are one shingle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                fps = np.array(text_fingerprints(batch.column(1).to_pylist(), shingle), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps), batch.column(2)], names=["doc_id", "fp", "content"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("content")).mapInArrow(of, "doc_id long, fp long, content long")


def forest(entries: np.ndarray, probes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``entries`` and between
    entries and ``probes``: breadth-first searches whose steps are vectors of
    whole Hamming distances. Probes are never compared with each other, so the
    work grows with entries times all rows."""
    edges: list[tuple[int, int]] = []
    while len(entries):
        todo, entries = [(entries[0], True)], entries[1:]
        while todo:
            x, entry = todo.pop()
            near = np.bitwise_count(entries ^ x) <= distance
            if near.any():
                edges.extend((int(x), int(y)) for y in entries[near])
                todo.extend((y, True) for y in entries[near])
                entries = entries[~near]
            if entry and len(probes):
                near = np.bitwise_count(probes ^ x) <= distance
                if near.any():
                    edges.extend((int(x), int(y)) for y in probes[near] if y != x)
                    todo.extend((y, False) for y in probes[near])
                    probes = probes[~near]
    return edges


def _table(fp: Column, low: int, wide: int, *of: Column) -> tuple[Column, Column]:
    """(key, keys of its ball of radius 1) of ``wide`` bits of ``fp``."""
    part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << wide) - 1).cast("long"))
    flips = [part.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(wide)]
    hashed = lambda x: F.xxhash64(*of, F.lit(low), x)
    return hashed(part), F.array(*map(hashed, flips))


def links(prints: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp``
    at ``distance`` or fewer bits.

    A fingerprint's two halves index two tables. Of two that differ in at most
    three bits one half differs in at most one, so probing each table with the
    Hamming ball of radius 1 around the half finds all; whole distances are
    checked, and each key gives a spanning forest, never its pairs. A key with
    over ``block`` entries is a table of its own, indexed by the two quarters of
    the other half: those differ in at most three bits together, so again one
    quarter is found by a ball of radius 1. Such a key holds 2**16 entries at
    most, for 48 of 64 bits are fixed.
    """
    if distance > 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    fp = F.col("fp")
    rows = []
    for low in (0, 32):
        key, ball = _table(fp, low, 32)
        rows.append(prints.select("fp", F.lit(low).alias("low"), key.alias("key"), ball.alias("ball")))
    both = rows[0].unionByName(rows[1])
    every = both.select("fp", "low", "key", F.lit(False).alias("probe")).unionByName(both.select("fp", "low", F.explode("ball").alias("key"), F.lit(True).alias("probe")))
    hot = stored(both.groupBy("key").count().where(F.col("count") > block).select("key", F.lit(True).alias("hot")), "simhash_hot")
    if not hot.isEmpty():
        marked = every.join(small(hot), "key", "left")
        finer = []
        for own in (0, 32):
            inside = marked.where(F.col("hot") & (F.col("low") == own))
            for low in (32 - own, 48 - own):
                key, ball = _table(fp, low, 16, F.col("key"))
                # entries of the key are probes too; the others are probes only
                finer += [inside.where("not probe").select("fp", key.alias("key"), "probe"), inside.select("fp", F.explode(ball).alias("key"), F.lit(True).alias("probe")), inside.where("probe").select("fp", key.alias("key"), "probe")]
        every = marked.where("hot is null").select("fp", "key", "probe")
        for part in finer:
            every = every.unionByName(part)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sorted rows in steps that end where a key ends."""
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "key", "probe")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            at = int(np.searchsorted(held[1], held[1][-1])) if len(held[1]) else 0
            if at:
                yield tuple(x[:at] for x in held)
                held = [x[at:] for x in held]
        if held is not None and len(held[0]):
            yield tuple(held)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, key, probe in groups(batches):
            fp = fp.view(np.uint64)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(begin[1:], len(fp))
            some = ~probe[begin] & (end - begin > 1)
            begin, end = begin[some], end[some]
            pairs = end - begin == 2
            a, b = fp[begin[pairs]], fp[begin[pairs] + 1]
            near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
            edges = set(zip(a[near].tolist(), b[near].tolist(), strict=True))
            for s, e in zip(begin[~pairs].tolist(), end[~pairs].tolist(), strict=True):
                entries = ~probe[s:e]
                edges.update(forest(np.unique(fp[s:e][entries]), np.unique(fp[s:e][~entries]), distance))
            a, b = np.array(list(edges), np.uint64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a.copy().view(np.int64)), pa.array(b.copy().view(np.int64))], names=["a", "b"])

    dealt = every.select("fp", "key", "probe").repartition("key").sortWithinPartitions("key", "probe")
    return dealt.mapInArrow(match, "a long, b long").distinct()


def near_dedup(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each group of near copies in ``docs``, with all its columns.

    The row with the smallest doc_id stays (null ids last; among rows with one
    id the one whose content hashes smallest, once). The rows meet their
    group's choice by id and content, so no task holds a group.
    """
    content = F.xxhash64("doc_id", "text")
    prints = stored(fingerprints(docs, shingle), "simhash").groupBy("fp", "doc_id").agg(F.min("content").alias("content"))
    own = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content"))
    distinct = stored(prints.groupBy("fp").agg(own.alias("own")), "simhash")
    members = connected_components(links(distinct.select("fp"), distance), "a", "b")
    labelled = distinct.join(members.withColumnRenamed("id", "fp"), "fp", "left")
    chosen = labelled.groupBy(F.coalesce("component", "fp")).agg(F.min("own").alias("own")).select(F.col("own.doc_id").alias("chosen_id"), F.col("own.content").alias("chosen_content"))
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("held_id"), content.alias("held_content"))
    joined = held.join(chosen, F.col("held_id").eqNullSafe(F.col("chosen_id")) & (F.col("held_content") == F.col("chosen_content")))
    return joined.dropDuplicates(["held_id", "held_content"]).select("row.*")


#: Smallest shingle hashes of a text that are its keys.
SMALLEST = 6


def _shingled(texts: DataFrame, shingle: int) -> DataFrame:
    """Adds ``norm`` (lower-case words, single-spaced), ``n_words`` and
    ``shingles``, hashes of all word shingles; fewer words are one shingle."""
    upper = "".join(map(chr, range(65, 91)))
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), F.lit(f"({WORD})"), F.lit(1))
    staged = texts.withColumn("_words", words).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_h")
    runs = F.transform(F.slice("_h", F.lit(1), n - (shingle - 1)), lambda x, i: F.xxhash64(x, *[F.get(F.col("_h"), i + j) for j in range(1, shingle)]))
    whole = F.array(F.xxhash64("_h"))
    return staged.select("*", F.array_join("_words", " ").alias("norm"), n.alias("n_words"), F.when(n >= shingle, runs).otherwise(whole).alias("shingles")).drop("_words", "_h")


def print_pairs(named: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids in ``named(fp, id)``: those of one
    fingerprint with its smallest id, and the smallest ids of linked ones."""
    named = stored(named.distinct(), "near_fingerprints")
    low = stored(named.groupBy("fp").agg(F.min("id").alias("low")), "near_fingerprints")
    of = lambda c: low.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low"))
    linked = links(low.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.least("a_low", "b_low").alias("a"), F.greatest("a_low", "b_low").alias("b"))
    return named.join(low, "fp").select(F.col("low").alias("a"), F.col("id").alias("b")).union(linked).where("a < b").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies in ``docs``, with all its columns.

    Linked are texts whose sets of word shingles have a Jaccard similarity of
    ``similarity`` or more, verified, if the SimHash fingerprints of their
    shingles are equal or linked by operator 7's search (``links``), or if they
    share one of their ``SMALLEST`` least shingle hashes (see
    ``lines.candidates``). The fingerprints find texts that differ little; at 0.8
    some 10 of 64 bits differ, which the search does not reach, and all least
    hashes differ with a probability of 0.2 ** SMALLEST. The row with the smallest doc_id stays (null
    ids last; among rows with one id the one whose content hashes smallest,
    once). Null, empty and word-less texts are equal. Texts of any length take
    part whole. An empty table gives no rows. Rows are held by id and content,
    so other columns may have any name, and no task holds a group.
    """
    content = F.xxhash64("doc_id", "text")
    named = _shingled(docs.select("doc_id", "text", content.alias("content")), shingle)
    keys = F.array_distinct(F.slice(F.sort_array("shingles"), 1, SMALLEST))
    prints = stored(named.select("doc_id", "content", sized_id(F.xxhash64("norm"), F.col("n_words")).alias("id"), keys.alias("keys")), "near_prints")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content"))
    distinct = stored(prints.groupBy("id").agg(own.alias("own"), F.min("keys").alias("keys")), "near_texts")

    def verify(asked: DataFrame) -> DataFrame:
        wanted = asked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        rows = stored(distinct.join(wanted, "id").select("id", "own.doc_id", "own.content"), "near_wanted")
        one = docs.select("doc_id", "text", content.alias("content")).join(small(rows.select("content", "id"), 2_000_000), "content")
        sets = _shingled(one, shingle).groupBy("id").agg(F.min(F.array_distinct("shingles")).alias("s"))
        sets = stored(sets, "near_sets")
        both = asked.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        both = both.withColumn("same", F.size(F.array_intersect("x", "y")))
        near = stored(both.where(F.col("same") >= similarity * (F.size("x") + F.size("y") - F.col("same")) - 1e-9).select("a", "b"), "near_links")
        forget(rows, sets)
        return near

    pairs, places = candidates(distinct.select("id", "keys"), similarity)
    prints_of = fingerprints(docs, shingle).select("content", "fp").distinct().join(prints.select("content", "id").distinct(), "content")
    found = verify(pairs.union(print_pairs(prints_of.select("fp", "id"))).distinct())
    members = stored(connected_components(found, "a", "b"), "near_groups")
    held, parts = rest_places(places, members)
    forget(places)
    if parts:
        more = rest_links(held, similarity, parts, verify)
        members = stored(connected_components(found.union(more), "a", "b"), "near_groups")
    forget(held)
    best = members.join(distinct, "id").groupBy("component").agg(F.min("own").alias("best"))
    alone = distinct.join(small(members.select("id")), "id", "left_anti").select(F.col("own").alias("best"))
    chosen = stored(best.select("best").union(alone).select("best.doc_id", "best.content"), "near_chosen")
    # what goes is the smaller part; only of repeated rows one must be picked
    counted = prints.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["content"] == y["content"])
    judged = counted.join(chosen.withColumnRenamed("doc_id", "d").withColumnRenamed("content", "c"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left")
    judged = stored(judged.select("doc_id", "content", "n", F.col("c").isNotNull().alias("stays")), "near_judged")
    held = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", content.alias("content"))
    gone = small(judged.where("not stays or n > 1"))
    out = held.join(gone, same(held, gone), "left_anti").select("row.*")
    repeated = judged.where("stays and n > 1")
    if not repeated.isEmpty():
        again = small(repeated)
        out = out.unionByName(held.join(again, same(held, again), "left_semi").dropDuplicates(["doc_id", "content"]).select("row.*"))
    return out


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex
    digits) and component_id, the smallest doc_id it reaches over links.

    Equal fingerprints are linked, texts without words (fingerprint 0)
    included. Repeated rows give repeated rows. A null doc_id is never the
    smallest; a component of null ids only has a null id. An empty table gives
    no rows. Copies of a text meet as one fingerprint with a smallest doc_id;
    only distinct fingerprints are compared. Texts of any length are taken whole;
    other columns are not read.
    """
    prints = stored(fingerprints(docs, shingle), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash")
    members = stored(connected_components(links(distinct.select("fp"), distance), "a", "b").withColumnRenamed("id", "fp"), "simhash")
    lowest = stored(members.join(distinct, "fp").groupBy("component").agg(F.min("low").alias("component_id")), "simhash")
    grouped = members.join(small(lowest), "component").select("fp", "component_id")
    alone = distinct.join(small(members.select("fp")), "fp", "left_anti").select("fp", F.col("low").alias("component_id"))
    owner = stored(grouped.union(alone), "simhash")
    return prints.join(small(owner), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
