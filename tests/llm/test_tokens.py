import random
import zlib

import numpy as np
import pytest

from evigraph.llm import packing, token_files
from evigraph.llm.queries import vocabulary
from evigraph.llm.tokens import PartEncoder

SCHEMA = "doc_id long, text string, note string"
ODD = [(3, None, "x"), (1, "", None), (2, "a b", "y"), (2, "a b", "y"), (None, "Ünïcode 漢字 ́ x", ""), (9, "w" * 5000, ""), (7, " \n\t ", ""), (8, "one two three " * 3000, ""), (10, "a <|endoftext|> b<|startoftext|>", ""), (11, "<|endoftext|>", "")]


def library_ids(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_part_encoder_equals_library(name, spaces):
    rng = random.Random(3)
    letters = [*" \t\n\r  ab'sAB19é.,", "'s", "<|endoftext|>", "don't", "ß", "Ÿ", "ſ", "ŉ", "—", "Ö", "漢", "́", "　", "Σ"]
    encoder = PartEncoder(vocabulary(name), spaces, keep=50)
    ids = library_ids(name)
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(text), text


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_payload_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 50257, np.full(n, 7), rng.integers(0, 2**32, n), np.where(rng.random(n) < 0.05, 2**31, 5)):
        ids = ids.astype(np.uint32)
        payload = token_files.pack(ids)
        assert (token_files.unpack(payload) == ids).all()
        if n > 256:
            assert (token_files.unpack(payload, 1, 2) == ids[128:256]).all()


def test_token_files_cases(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = token_files.read_token_files(token_files.write_token_files(docs, vocabulary("byte_bpe_50k.json"), 2, segment_ids=100)).collect()
    ids, start = library_ids("byte_bpe_50k.json"), 0
    wanted = []
    for doc_id, text, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = np.array([*ids(text), 2], "<u4")
        wanted.append((doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == wanted
    none = token_files.read_token_files(token_files.write_token_files(docs.limit(0), vocabulary("byte_bpe_50k.json"), 2))
    assert none.collect() == []


def test_packing_cases(spark):
    rng = random.Random(5)
    many = ODD + [(100 + i, " ".join(rng.choice(["ab", "cde", "fgh"]) for _ in range(rng.randint(0, 900))), "") for i in range(300)]
    docs = spark.createDataFrame(many, SCHEMA)
    rows = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 1, capacity=512, pool=64).collect()
    ids = library_ids("word_bpe_49k.json")
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text, _ in many:
        if doc_id == 2:
            continue
        own, at = np.array([*ids(text), 1], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    assert len(by_doc[2]) >= 2
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert sum(r.length for r in rows) / (512 * len(by_sequence)) > 0.95
    assert packing.pack_documents(docs.limit(0), vocabulary("word_bpe_49k.json"), 1).collect() == []


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(200)]
    groups = packing.difference(sizes, 7)
    assert sorted(i for g in groups for i in g) == list(range(200))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 2
    assert packing.difference([5], 3) == [[0], [], []]
    assert packing.difference([], 2) == [[], []]


def test_window_count_rises_until_differencing_fits():
    rng = random.Random(8)
    for sizes in ([100] * 7, [60] * 9, [1], [rng.randint(1, 99) for _ in range(150)], [99] * 50 + [1] * 3):
        windows = packing.pack_pool(sizes, 100)
        assert all(sum(p[2] for p in w) <= 100 for w in windows)
        cuts = sorted(p for w in windows for p in w)
        for i, size in enumerate(sizes):
            at = 0
            for _, start, length in (c for c in cuts if c[0] == i):
                assert start == at
                at += length
            assert at == size
    sizes = [rng.randint(1, 2047) for _ in range(512)]
    assert sum(sizes) / (2048 * len(packing.pack_pool(sizes, 2048))) > 0.99
