import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from evigraph.llm import middle, queries


def brute(doc_id, text):
    """A document's row of the registered query, by slices of the text."""
    text = text or ""
    n = len(text)
    d = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op13_middle(spark, sf_dir).collect()))
    assert got == sorted(brute(*d) for d in docs)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.sql(middle.SQL).fetchall()) == got


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = ["", None, "a", "<", "<P", "<P>x", "x<S>", "<M>", "<<", "漢😀é" * 3000, "P><S", "\n\n", "é" * 5]
    texts += ["".join(rng.choice("<PSM>ab😀\n ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)] + [(9, texts[9], "", None), (None, "null id", "", None), (-5, "negative", "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, restored string")
    made = middle.restore_middle(middle.fill_in_middle(docs))
    got = made.collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.restored) for r in got) == sorted((str(i), t or "") for i, t, *_ in rows)
    digest = lambda c: F.sha2(c, 256)
    some = made.where("doc_id is not null").select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
    assert sorted(map(str, map(tuple, some.collect()))) == sorted(str(brute(i, t)) for i, t, *_ in rows if i is not None)
    assert middle.restore_middle(middle.fill_in_middle(docs.limit(0))).collect() == []
    with pytest.raises(ValueError, match="sentinels"):
        middle.fill_in_middle(docs, sentinels=("<P>", "<S>", "<M<"))
    with pytest.raises(ValueError, match="unit"):
        middle.fill_in_middle(docs, unit="page")


@pytest.mark.parametrize("unit", ["word", "line", "code_point"])
def test_ropes_equal_slices(unit):
    """Splits and joins of ropes with tiny leaves, against lists of units."""
    rng = random.Random(7)
    pattern = middle.UNITS[unit]
    for _ in range(200):
        text = "".join(rng.choice("ab 漢\n\t") for _ in range(rng.randint(0, 200)))
        units = list(text) if pattern is None else re.findall(pattern, text)
        assert "".join(units) == text
        rope = middle.rope_of(text, pattern, leaf=3)
        assert (rope.units, rope.chars, middle.text_of(rope)) == (len(units), len(text), text)
        a, b = sorted(rng.randint(0, len(units)) for _ in range(2))
        for form in ("psm", "spm"):
            p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
            out, prefix, mid = middle.rearranged(rope, a, b, form)
            wanted = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
            assert (middle.text_of(out), prefix, mid) == (wanted, len(p), len(m))
            assert middle.restored(wanted, form) == text
        left, right = middle.split(rope, len(text) // 3, "chars")
        assert (middle.text_of(left), middle.text_of(right)) == (text[: len(text) // 3], text[len(text) // 3 :])


def depth_holds(rope):
    if isinstance(rope, middle.Leaf):
        return True
    return abs(rope.left.depth - rope.right.depth) <= 1 and depth_holds(rope.left) and depth_holds(rope.right)


def test_depth_stays_logarithmic():
    rng = random.Random(9)
    rope = middle.rope_of("x" * 40000, leaf=8)
    for _ in range(200):
        left, right = middle.split(rope, rng.randint(0, rope.units))
        rope = middle.join(right, left)
        assert rope.units == rope.chars == 40000
        assert depth_holds(rope)
    assert rope.depth < 24


def test_documents_by_words(spark):
    docs = spark.createDataFrame([(i, "one two  three\nfour " * i) for i in range(50)], "doc_id long, text string")
    marks = ("⟨pre⟩", "⟨suf⟩", "⟨mid⟩")
    made = middle.restore_middle(middle.fill_in_middle(docs, unit="word", plain=0, spm=50, sentinels=marks), marks)
    rows = made.collect()
    assert all(r.restored == "one two  three\nfour " * r.doc_id for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all(r.n == 4 * r.doc_id + (r.doc_id > 0) for r in rows)
