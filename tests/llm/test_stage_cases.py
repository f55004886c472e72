"""The pipeline's stages against brute force, and their odd cases."""

import re
import zlib

import duckdb
import numpy as np

import corpus_pipeline
from evigraph.llm import quality, secrets, simhash
from evigraph.llm.common import WORD
from tests.llm.test_tokens import library_ids

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, row string, n_chars long, spans string, keeper int"
LONG = " ".join(f"word{i} stands{i % 13}." for i in range(30_000))
PROSE = " ".join(f"alpha{i} beta{i % 7} gamma." for i in range(60))
ROWS = [
    (1, None, "a", 1, "s", 1), (2, "", "b", 2, "s", 2), (3, PROSE, "c", 3, None, 3), (3, PROSE, "c", 3, None, 3), (4, LONG, "d", 4, "s", 4), (None, PROSE + " more", "e", 5, "s", 5),
    (5, "token=abcdefghijklmnop and \n\n" + PROSE, "f", None, "s", 6), (6, " \n\t", None, 7, "s", 7), (7, PROSE.replace("alpha3 ", "changed "), "h", 8, "s", None),
]


def test_odd_rows_go_through_every_stage(spark, sf_dir):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, sf_dir).collect()
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
        if name != "packing":
            assert stage(spark, docs, sf_dir).columns == docs.columns
            assert all(r.n_chars == len(r.text) for r in out[name] if name != "near duplicates")
    by = lambda name: sorted((-1 if r.doc_id is None else r.doc_id) for r in out[name])
    every = sorted(-1 if r[0] is None else r[0] for r in ROWS)
    # word-poor texts fail; the others stay with their columns
    assert by("quality rules") == [-1, 3, 3, 4, 5, 7]
    assert {(r.doc_id, r.row, r.keeper) for r in out["quality rules"]} == {(r[0], r[2], r[5]) for r in ROWS if r[0] in (None, 3, 4, 5, 7)}
    # the null id comes first, so its line stays and the similar ones go
    assert by("line dedup") == every
    text = {(r.doc_id, r.row): r.text for r in out["line dedup"]}
    assert text[(None, "e")] == PROSE + " more" and text[(3, "c")] == "" and text[(7, "h")] == "" and text[(1, "a")] == "" and text[(4, "d")] == LONG
    # of copies and of empty texts the smallest id stays, once; null ids last
    assert by("near duplicates") == [1, 3, 4] and {r.row for r in out["near duplicates"]} == {"a", "c", "d"}
    assert by("secret scan") == every
    assert {r.text for r in out["secret scan"] if r.doc_id == 5} == {"[SECRET] and \n\n" + PROSE}
    assert {r.doc_id for r in out["packing"]} == {r[0] for r in ROWS}


def test_quality_stage_equals_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.text for r in STAGES["quality rules"](spark, docs, sf_dir).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    judged = con.sql(quality.SQL)
    at = {c: i for i, c in enumerate(judged.columns)}
    assert set(got) == {r[at["doc_id"]] for r in judged.fetchall() if r[at["kept"]]}
    whole = {r.doc_id: r.text.split("\n") for r in docs.collect()}
    for doc_id, text in got.items():
        lines = iter(whole[doc_id])
        assert all(line in lines for line in text.split("\n")), "kept lines stand in order"


def test_near_duplicate_stage_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sets = []
    for r in docs:
        words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) >= 0.8 * max(len(a), len(sets[j])) and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(docs):
        low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    got = STAGES["near duplicates"](spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(low.values())


def test_secret_stage_changes_spans_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: (r.text, r.spans) for r in secrets.find_secrets(docs.select("doc_id", "text")).collect()}
    hit = 0
    for r in STAGES["secret scan"](spark, docs, sf_dir).collect():
        text, spans = found[r.doc_id]
        out, at = "", 0
        for s in spans:
            if s["start"] >= at:
                out += text[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        hit += bool(spans)
        assert r.text == out + text[at:]
    assert hit > 0


def test_packing_stage_holds_every_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces, filled = {}, {}
    for r in STAGES["packing"](spark, docs, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append(r)
    ids = library_ids("word_bpe_49k.json")
    for d in docs.collect():
        own, at = np.array([*ids(d.text), 1], "<u4"), 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    for rows in filled.values():
        assert sum(r.length for r in rows) <= 2048
        assert [r.offset for r in sorted(rows, key=lambda r: r.offset)] == list(np.cumsum([0, *[r.length for r in sorted(rows, key=lambda r: r.offset)]])[:-1])


def test_near_copies_keep_columns_of_one_row(spark):
    rows = [(2, "one two three four five six", "x"), (1, "One two three four five six", "y"), (1, "One two three four five six", "z")]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string, id string")).collect()
    assert len(got) == 1 and got[0].doc_id == 1 and got[0].id in ("y", "z")
