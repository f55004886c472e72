"""Operator 8: secret spans by patterns and sliding entropy, as expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in listed order. The shortest lengths of the
#: last two are part of the pattern, which finds the same spans because their
#: runs are greedy and a run that is too short has no longer run inside.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Character classes: letters, and the entropy (bits a character) of some
#: window from which a candidate of that class counts as random.
CLASSES = (("0123456789abcdefABCDEF", 3.0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.6))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are no secrets. Words and names in one case or
#: capitalised, of up to 24 letters, paths of such words, numbers, and rules of
#: one repeated character. A longer run of letters is judged by its entropy.
ALLOWED = (r"^[-_/+=]*(?:[A-Z]?[a-z]{1,24}|[A-Z]{1,24}|[0-9]+)(?:[-_/+=]+(?:[A-Z]?[a-z]{1,24}|[A-Z]{1,24}|[0-9]+))*+[-_/+=]*$", r"^(.)\1+$")
#: Placeholders, with up to a window of the letters and digits around them.
PLACEHOLDER = r"[A-Za-z0-9]{0,20}(?i:example|placeholder|dummy|changeme|your[-_]?|x{6,}|0{8,}|1234567)[A-Za-z0-9]{0,20}"

_SPAN = "array<struct<kind:int,start:int,end:int>>"


#: Counts of a window are packed: so many of so many bits each in a long.
PACKED, COUNT_BITS = 12, 5
#: Logarithms are held as integers of that scale, so that sums have no error.
LOG_SCALE = 1 << 32
#: Elements that a running value goes through at a time, and code points of a
#: text that are looked up at a time.
BLOCK, CHUNK = 128, 4096


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element, ``op`` over all those before it. Arrays that grow by one
    are copied each time, hence blocks: first in each, then over their totals."""

    def ways(v: Column) -> Column:
        def within(b: Column) -> Column:
            return F.aggregate(b, F.array(zero), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))

        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: within(F.slice(v, i * BLOCK + 1, F.lit(BLOCK))))

        def shifted(parts: Column) -> Column:
            totals = within(F.transform(parts, lambda p: F.element_at(p, -1)))
            return _bound(totals, lambda t: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: op(F.get(t, i), x)))))

        return _bound(blocks, shifted)

    return _bound(values, ways)


def matches(text: Column, pattern: str, shortest: int = 0) -> Column:
    """What ``pattern`` finds: parts, each with the text before it (b), the match
    (m) and if it is kept, and the tail behind the last; null where it finds
    nothing. Matches whose group 1 has under ``shortest`` letters aren't kept."""

    def zipped(between: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if shortest else whole
        parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(between) - 1).alias("b"), whole.alias("m"), value.alias("v"))
        kept = F.transform(parts, lambda p: F.struct(p["b"].alias("b"), p["m"].alias("m"), (F.length(p["v"]) >= shortest).alias("kept")))
        return F.struct(kept.alias("parts"), F.element_at(between, -1).alias("tail"))

    return F.when(text.rlike(pattern), _bound(F.split(text, pattern, -1), zipped))


def placed(found: Column, kind: int) -> Column:
    """The kept matches with their places (code points, end exclusive), which
    follow from lengths alone; an empty array for null."""

    def span(p: Column, at: Column) -> Column:
        begin = at + F.length(p["b"])
        return F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(p["m"])).alias("end"), p["m"].alias("m"), p["kept"].alias("kept"))

    def spans(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p["b"]) + F.length(p["m"]))
        return F.filter(F.zip_with(parts, running(lengths, lambda a, x: a + x, F.lit(0)), span), lambda s: s["kept"])

    return F.coalesce(_bound(found["parts"], spans), F.array().cast("array<struct<kind:int,start:int,end:int,m:string,kept:boolean>>"))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def spans_of(text: Column, pattern: str, kind: int, shortest: int = 0) -> Column:
    """Spans (kind, start, end) of the kept matches of ``pattern``."""
    return _plain(placed(matches(text, pattern, shortest), kind))


def blanked(text: Column, pattern: str, shortest: int = 0) -> Column:
    """``text`` with every character of the kept matches made a space."""

    def joined(found: Column) -> Column:
        pieces = F.transform(found["parts"], lambda p: F.concat(p["b"], F.when(p["kept"], F.repeat(F.lit(" "), F.length(p["m"]))).otherwise(p["m"])))
        return F.when(found.isNull(), text).otherwise(F.array_join(F.concat(pieces, F.array(found["tail"])), ""))

    return _bound(matches(text, pattern, shortest), joined)


def window_entropy(word: Column, letters: str, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy of any ``window`` consecutive characters.

    One pass over the characters' places in ``letters``, with a count for each
    packed into a few longs: the character that enters and the one that leaves
    change two counts, and the sum of c * log2(c) by the difference of two table
    entries. Null if the word has fewer characters than a window.
    """
    if window >= 1 << COUNT_BITS:
        raise ValueError(f"a window has at most {(1 << COUNT_BITS) - 1} characters")
    table = F.array(*[F.lit(0 if c < 2 else round(c * math.log2(c) * LOG_SCALE)).cast("long") for c in range(window + 2)])
    zero = F.array_repeat(F.lit(0).cast("long"), len(letters) // PACKED + 1)
    start = F.struct(zero.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(1 << 62).cast("long").alias("least"))

    def place(x: Column) -> Column:
        return F.struct(F.floor(x / PACKED).cast("int").alias("w"), (x % PACKED * COUNT_BITS).alias("s"), F.call_function("shiftleft", F.lit(1).cast("long"), x % PACKED * COUNT_BITS).alias("one"))

    def moves(places: Column) -> Column:
        return F.transform(places, lambda x, i: F.struct(x.alias("enters"), F.get(places, i - window).alias("leaves"), (i >= window - 1).alias("full")))

    def many(counts: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, x["w"]), x["s"]).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")

    def step(state: Column, move: Column) -> Column:
        enters, leaves = move["enters"], move["leaves"]
        same = F.coalesce((enters["w"] == leaves["w"]) & (enters["s"] == leaves["s"]), F.lit(False))
        change = _bound(many(state["counts"], enters), lambda c: F.get(table, c + 1) - F.get(table, c))
        change = change - F.coalesce(_bound(many(state["counts"], leaves), lambda c: F.get(table, c) - F.get(table, c - 1)), F.lit(0).cast("long"))
        counts = F.transform(state["counts"], lambda c, j: c + F.when(j == enters["w"], enters["one"]).otherwise(F.lit(0).cast("long")) - F.when(j == leaves["w"], leaves["one"]).otherwise(F.lit(0).cast("long")))
        total = F.when(same, state["sum"]).otherwise(state["sum"] + change)
        least = _bound(total, lambda t: F.struct(t.alias("sum"), F.when(move["full"], F.least(state["least"], t)).otherwise(state["least"]).alias("least")))
        return _bound(least, lambda s: F.struct(F.when(same, state["counts"]).otherwise(counts).alias("counts"), s["sum"].alias("sum"), s["least"].alias("least")))

    places = F.transform(F.split(word, ""), lambda c: place(F.instr(F.lit(letters), c)))
    steps = F.aggregate(_bound(places, moves), start, step, lambda s: F.lit(math.log2(window)) - s["least"] / float(LOG_SCALE) / window)
    return F.when(F.length(word) >= window, steps)


def _random(word: Column) -> Column:
    """If a candidate is random enough for its class and not allow-listed."""
    verdict = F.lit(False)
    for letters, bits in reversed(CLASSES):
        pattern = "^[" + letters.replace("-", r"\-") + "]+$"
        verdict = F.when(word.rlike(pattern), window_entropy(word, letters) >= bits).otherwise(verdict)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(F.coalesce(verdict, F.lit(False)))


def find_secrets(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """Spans of secrets in ``docs(doc_id, text)``; one row for each.

    Returns doc_id, text and spans, an array of (kind, start, end) by start and
    kind, where kind indexes ``KINDS``. Kinds are searched one by one, so spans
    of different kinds may overlap; entropy is searched in what base spans and
    placeholders, blanked one kind after another, leave of a run. Null and empty
    texts have none. Each row is scanned alone and whole, without a shuffle, so
    repeated rows give repeated results, ids may tie or be null, and an empty
    table gives no rows. A text of any length is searched to its end, in time
    in proportion to its length and to that of its runs. Other columns are not
    read; the one named by ``carry`` is returned too.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([F.col(carry).alias("_carried")] if carry else []))
    text, kinds = F.col("text"), ((ASSIGN, ASSIGN_LENGTH), (ACCESS, 0), (HEX, 0))
    base = F.concat(*[spans_of(text, pattern, k, n) for k, (pattern, n) in enumerate(kinds)])

    def cleared(t: Column, left: tuple) -> Column:
        (pattern, n), *left = left
        return _bound(blanked(t, pattern, n), lambda r: cleared(r, left) if left else r)

    def runs(rest: Column) -> Column:
        return _plain(F.filter(placed(matches(rest, CANDIDATE), 3), lambda s: _random(s["m"])))

    more = F.when(text.rlike(CANDIDATE), _bound(cleared(text, (*kinds, (PLACEHOLDER, 0))), runs)).otherwise(F.array().cast(_SPAN))
    order = F.array_sort(F.transform(F.concat(base, more), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return rows.select("doc_id", "text", *([F.col("_carried").alias(carry)] if carry else []), _plain(order).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every maximal run of overlapping ``spans``, which stand by
    start, made ``mark``. What stays is looked up in chunks of the text."""
    length = F.length(text)

    def pieces(chunks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            held = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
            return F.when(a < b, F.substring(held, a % CHUNK + 1, b - a)).otherwise("")

        seen = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
        parts = F.zip_with(spans, seen, lambda s, at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit(mark))).otherwise(""))
        return F.array_join(F.concat(parts, F.array(between(F.array_max(F.transform(spans, lambda s: s["end"])), length))), "")

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _bound(chunks, pieces)).otherwise(text)


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    found = find_secrets(docs)
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
