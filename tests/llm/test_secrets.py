import hashlib
import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from evigraph.llm import secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_spans_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["password=", "Secret: '", "secret=token:", "api_key = ", "APIKEY:", "abcdefghijklm", "0123456789abcdef", "AKIA", "AKIAAKIA", "ABCDEFGHIJ0123", "é漢😀 ", " ", "\n", "=", "token", ":", '"', "short", "k", "ſecret=abcdefghijklmnop"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "clash") for i in range(400)]
    rows += [(900, None, ""), (901, "", None), (None, "token=abcdefghijklmnop", ""), (902, "a" * 30000 + " token=abcdefghijklmnop " + "b c" * 9000, ""), (3, rows[3][1], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.secrets_digest(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        wanted, r = brute(text or ""), by_id[doc_id]
        kinds = Counter(k for k, _, _ in wanted)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"]), text
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in wanted)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("entropy")) == joined
    assert secrets.secrets_digest(docs.limit(0)).collect() == []


def entropy(word):
    return -sum(c / len(word) * math.log2(c / len(word)) for c in Counter(word).values())


def test_window_entropy_equals_brute_force(spark):
    rng = random.Random(8)
    letters = secrets.CLASSES[1][0]
    words = ["".join(rng.choice(letters[: rng.choice([1, 3, 60])]) for _ in range(rng.randint(20, 70))) for _ in range(60)] + ["short"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for w, got in df.select("w", secrets.window_entropy(F.col("w"), letters)).collect():
        wanted = max((entropy(w[i : i + 20]) for i in range(len(w) - 19)), default=None)
        assert got is None if wanted is None else abs(got - wanted) < 1e-9


def test_entropy_finds_random_strings_and_allows_names(spark):
    found = "gH7kQ2zX9pL4vB8nM1cR5tW3yJ6d"
    texts = [(1, f"x {found} y"), (2, "thererendthinglyblehatheanstione and Some-Long-Hyphen-Words-In-Path"), (3, "=" * 60), (4, "EXAMPLEkeygH7kQ2zX9pL4vB8nM1c"), (5, f"token={found}")]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", secrets.listed(F.col("spans")).alias("s"), secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert [got[i].s for i in range(1, 6)] == ["entropy:2:30", "", "", "", "assign:0:34"]
    assert got[1].t == "x [SECRET] y" and got[5].t == "[SECRET]"


def test_recall_of_planted_keys(spark, sf_dir):
    """Random keys of five kinds in running text: at least 95 % of each kind are
    covered by a span, and the texts without them have no entropy span."""
    rng = random.Random(14)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {"base64": (lower + upper + digits + "+/", 40), "url": (lower + upper + digits + "-_", 32), "lower": (lower, 40), "upper": (upper + digits, 32), "hex": ("0123456789ABCDEF", 40)}
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text]
    rows, keys = [], []
    for kind, (letters, n) in kinds.items():
        for _ in range(100):
            words = rng.choice(texts).split(" ")[:60]
            key = "".join(rng.choice(letters) for _ in range(n))
            words.insert(rng.randrange(len(words) + 1), key)
            rows.append((len(rows), " ".join(words)))
            keys.append((kind, key))
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    found = Counter()
    for i, (kind, key) in enumerate(keys):
        at = rows[i][1].index(key)
        covered = {p for s in got[i].spans for p in range(s["start"], s["end"])}
        found[kind] += set(range(at, at + len(key))) <= covered
    print(dict(found))
    assert all(found[k] >= 95 for k in kinds)
    plain = secrets.secrets_digest(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert plain.where("spans like '%entropy%'").count() == 0


def timed(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    began = time.perf_counter()
    rows = secrets.find_secrets(frame).select("doc_id", "spans", secrets.redacted(F.col("text"), F.col("spans")).alias("safe")).collect()
    return {r.doc_id: r for r in rows}, time.perf_counter() - began


def test_long_runs_take_linear_time(spark):
    """One base64 run of up to a million characters, one run in which only the
    last window is random, a path of many names, many keys in one text."""
    rng = random.Random(3)
    letters = secrets.CLASSES[1][0][:64]
    run = lambda n: "".join(rng.choices(letters, k=n))
    timed(spark, ["x " + run(30)])
    _, first = timed(spark, ["at " + run(100_000) + " end"])
    big = run(1_000_000)
    got, second = timed(spark, ["é " + big + " end", "aB" * 5_000 + run(30), "abc/Def/" * 60_000, " ".join(run(40) for _ in range(8_000)), run(10_000)])
    assert [tuple(s) for s in got[0].spans if s["kind"] == 3] == [(3, 2, 1_000_002)] and got[0].safe == "é [SECRET] end"
    assert [tuple(s) for s in got[1].spans] == [(3, 0, 10_030)]
    assert got[2].spans == [] and got[2].safe == "abc/Def/" * 60_000
    assert len(got[3].spans) >= 7_900 and got[3].safe.count("[SECRET]") >= 7_900
    assert [tuple(s) for s in got[4].spans if s["kind"] == 3] == [(3, 0, 10_000)]
    print(first, second)
    assert second < 60


def test_running_values_equal_a_loop(spark):
    rows = [(i, [(7 * i + 3 * j) % 11 for j in range(n)]) for i, n in enumerate((0, 1, 127, 128, 129, 300, 1000))]
    frame = spark.createDataFrame(rows, "i int, v array<int>")
    got = frame.select("i", secrets.running(F.col("v"), lambda a, x: a + x, F.lit(0)).alias("s"), secrets.running(F.col("v"), lambda a, x: F.greatest(a, x), F.lit(0)).alias("m")).collect()
    for r, (_, v) in zip(sorted(got), rows, strict=True):
        assert r.s == [sum(v[:j]) for j in range(len(v))]
        assert r.m == [max(v[:j], default=0) for j in range(len(v))]
