import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evigraph.llm import quality, urls
from evigraph.llm.common import WORD

SCHEMA = "doc_id long, text string, words string, lines string, h string"


def rows_for_quality():
    rng = random.Random(11)
    vocabulary = ["the", "É", "漢", "x|y", "##", "No.", "end.", "a"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randint(0, 90)))) for i in range(80)]
    return rows + [(None, "a b c"), (500, None), (501, ""), (502, " \n\t\n"), (3, rows[3][1]), (503, "same word here " * 4000), (504, "menu | home | about | help |\n" + "Fine words are here, and they end well. " * 20), (505, "menu | a | b | c | d | e | f | g | h |\n" * 3 + "Good line of words. " * 15)]


def brute_quality(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_equals_brute_force_and_sql(spark):
    rows = rows_for_quality()
    docs = spark.createDataFrame([(*r, "clash", "clash", None) for r in rows], SCHEMA)
    got = quality.quality_rules(docs).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, r)
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r, wanted = by_id[doc_id], brute_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
    assert by_id[504].n_words > 50 and not by_id[504].clean_text.startswith("menu")
    documents = pd.DataFrame([r for r in rows if r[0] not in (None, 3)], columns=["doc_id", "text"])  # noqa: F841
    sql = {r[0]: r for r in duckdb.sql(quality.SQL).fetchall()}
    for doc_id, row in sql.items():
        r = by_id[doc_id]
        assert row == (doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
    assert quality.quality_rules(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("", None),
        ("a | b | c | d |", "navigation"),
        ("WIN!! NOW!! BUY!! IT!!", "shouting"),
        ("aa### bb$$$ cc%%% dd&&& ee***", "symbols"),
        ("Licensed under the Apache License.", "boilerplate"),
        ("der " * 12, "repetition"),
        ("four words no end", "punctuation"),
        ("A fine line, with an end.", None),
        ("Short title", None),
    ],
)
def test_line_rules(spark, line, rule):
    df = spark.createDataFrame([(line,)], "line string")
    m = quality.measured(F.array(df.line))[0]
    assert df.select(quality.line_verdict(m["line"], m["words"])).first()[0] == rule


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), re.split(r"[?#]", rest[cut:])[0]
    fits = [(h + p, v) for v, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: len(f[0]), default=None)
    return host, path, best


def test_urls_equal_brute_force(spark):
    rng = random.Random(9)
    hosts = ["adulthood.org", "free-money.org", "x.Payday-loans.org", "www.example.com", "example.com", "EXAMPLE.COM", "a.net", "net", "com", "www.casino-win.example.org", "xcom", "example.com:80", "", "myexample.com", "b.adult.org"]
    paths = ["/a/casino", "/POKER.html", "/pokerface", "/x_torrents-y", "/free/money", "", "/", "/en/", "/en/x?y=/fr/", "/enx/", "/es/1#t", "/fr/", "?q=://a.net/es/", "#/en/", "/EN/", "/a\n/en/"]
    found = [(i, f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}", "clash") for i in range(300)]
    found += [(900, None, None), (901, "", ""), (902, "no scheme/en/", ""), (None, "http://a.net/es/", ""), (5, found[5][1], ""), (903, "http://a.net/es/" + "x" * 20000, "")]
    pages = spark.createDataFrame(found, "page_id long, url string, token string")
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(found)
    wanted = sorted((i, *brute_url(u)[:2]) for i, u, _ in found if i is not None)
    assert sorted((r.page_id, r.host, r.path) for r in got if r.page_id is not None) == wanted
    for i, u, _ in found:
        host, path, best = brute_url(u)
        for r in got:
            if r.page_id == i:
                unwanted = bool(re.search(r"(?:^|[/._-])(casino|adult|poker|torrents|free-money|payday-loans|payday)(?:[/._-]|$)", (host + path).lower()))
                assert (r.rule, r.verdict) == (best or (None, "block" if unwanted else "allow")), u
    assert urls.judge_urls(pages.limit(0)).collect() == []
    with pytest.raises(ValueError, match="without a literal"):
        urls.judge_urls(pages, (urls.Rule("block", "x", ()),))
