import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evigraph.llm import simhash, substrings
from evigraph.llm.common import WORD, Words, connected_components

SCHEMA = "doc_id long, text string, fp string, chunk string"


def brute_substrings(rows, window):
    words = [re.findall(WORD, text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        drop = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                drop.update(range(i, i + window))
        out.append((doc_id, len(w), len(drop), " ".join(x for i, x in enumerate(w) if i not in drop)))
    return out


def odd_rows():
    rng = random.Random(7)
    letters = ["a", "b", "É", "漢字", "x" * 70, "yy", "z9"]
    rows = [(i, (rng.choice([" ", "\n", " \t "])).join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    shared = " ".join(rng.choice(letters) for _ in range(30))
    rows += [(200 + i, f"h{i} {shared}  t{i}") for i in range(20)]
    return rows + [(1, None), (2, ""), (None, "a a a a a a a a"), (5, rows[5][1]), (300, "q " * 5000), (301, "w" * 3000)]


def test_substrings_equal_brute_force(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, substrings.dedup_substrings(docs, window=6).collect()), key=repr)
    assert got == sorted(brute_substrings(rows, 6), key=repr)
    assert substrings.dedup_substrings(docs.limit(0), window=6).collect() == []


def test_words_and_hashes():
    words = Words([b"ab  cd", b"", b" \n", b"ab x", "é".encode() * 50, b"ab"])
    assert words.first.tolist() == [0, 2, 2, 2, 4, 5, 6]
    h = substrings.word_hashes(words)
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 4


def brute_fingerprint(text, shingle=3):
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    base = ["the Cat sat on A mat and looked " * 10 + " ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(3)]
    rows = odd_rows()
    for i in range(60):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = f"w{rng.randrange(5)}"
        rows.append((1000 + i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=repr)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    low = {}
    for (doc_id, _), root in zip(rows, roots):
        low[root] = min((x for x in (low.get(root), doc_id) if x is not None), default=None)
    assert got == sorted(((d, f"{fp:016x}", low[r]) for (d, _), fp, r in zip(rows, fps, roots)), key=repr)
    assert simhash.simhash_components(docs.limit(0)).collect() == []


def test_links_with_hot_keys(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, 4)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 6))) for c in centre for _ in range(150)}
    prints = spark.createDataFrame([(f,) for f in fps], "fp long")
    wanted = brute_components(sorted(fps))
    for block in (4096, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = dict(map(tuple, connected_components(simhash.links(prints), "a", "b").collect()))
        groups = {}
        for f, root in zip(sorted(fps), wanted):
            groups.setdefault(root, []).append(f)
        assert all({got.get(f, f) for f in g} == {min(g)} for g in groups.values())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}, 7000: 7000, 7001: 7000}


def test_sha_of_kept_text(spark):
    docs = spark.createDataFrame([(1, "é  b\nc")], "doc_id long, text string")
    row = substrings.dedup_substrings(docs).select(F.sha2("kept_text", 256)).first()
    assert row[0] == hashlib.sha256("é b c".encode()).hexdigest()


def test_a_key_with_many_fingerprints(spark):
    """One half is equal in 20,000 fingerprints: that key is indexed again by
    quarters. Components equal those of all pairs, found by numpy."""
    import numpy as np

    rng = np.random.default_rng(6)
    low = np.unique(rng.integers(0, 1 << 32, 20_000, dtype=np.uint64))
    fps = np.unique(np.concatenate([low | np.uint64(0xABCD1234 << 32), low[:500] ^ np.uint64(0b11), (low[:300] ^ np.uint64(1)) | np.uint64(0xABCD1235 << 32)]))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ x) <= 3).tolist():
            root[find(i)] = find(i + 1 + j)
    signed = fps.view(np.int64).tolist()
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(find(i), set()).add(x)
    wanted = {frozenset(g) for g in groups.values() if len(g) > 1}
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(prints)
    got = {}
    for r in connected_components(edges, "a", "b").collect():
        got.setdefault(r.component, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == wanted and len(wanted) > 200
    # a spanning forest: not many more edges than members
    assert edges.count() <= 4 * sum(len(g) for g in wanted)
