import random

import numpy as np
import pytest
import sentencepiece

from evigraph.llm import sentencepiece_codec as codec
from evigraph.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(4)
    letters = ["the", " ", "  ", "ing", "é", "漢字", "\n", "😀", "a", "A1", "ñ", "▁", "\t", "x", ".", "qu", "und", "er", "́"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return [*out, "a" * 700, "ab" * 400 + " x", " lead", "trail  ", "\n", " "]


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


def test_merges_equal_library(library):
    for text, blob in zip(texts(), codec.encode_texts(texts(), PATH, viterbi=False)):
        assert ids(blob) == library.encode(text), text
        assert codec._loaded(PATH)[0].decode(blob) == library.decode(ids(blob))


def test_viterbi_finds_the_greatest_score(library):
    model = codec._loaded(PATH)[0]
    model_score = lambda p: model.scores.get(p)
    words = sorted({w for t in texts() for w in model.split(t.replace(" ", codec.SPACE)) if len(w) < 40})
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for length, same in by_length.items():
        for word, row_ends, row_ids in zip(same, *model.viterbi(same)):
            spans = [(s, int(e), int(row_ids[s])) for s, e in enumerate(row_ends) if e]
            assert "".join(word[s:e] for s, e, _ in spans) == word
            total = sum(model.scores[word[s:e]] if i >= 0 else model.worst for s, e, i in spans)
            best = [0.0] + [-np.inf] * length
            for e in range(1, length + 1):
                for s in range(max(0, e - model.longest), e):
                    score = model_score(word[s:e])
                    if score is None and e - s == 1:
                        score = model.worst
                    if score is not None:
                        best[e] = max(best[e], best[s] + score)
            assert total == best[length]


def test_documents_round_trip(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts()) if codec.SPACE not in t]
    rows += [(900, None, ""), (901, "", ""), (None, "no id", ""), (3, rows[3][1], ""), (902, "word " * 20000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = codec.decode_documents(codec.encode_documents(docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text, r.viterbi_text) for r in got), key=repr) == sorted(((i, t or "", t or "") for i, t, _ in rows), key=repr)
    assert sorted(map(tuple, codec.round_trip_documents(docs, PATH).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert all(ids(r.ids) == library.encode(r.text) for r in got)
    assert codec.encode_documents(docs.limit(0), PATH).collect() == []
