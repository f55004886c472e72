"""Operator 12: personal data by patterns and a character-level tagger.

Base spans come from patterns. More spans come from a bidirectional LSTM with a
CRF (``tagger``), trained at the start of a run on labelled spans: windows of a
bounded sample of the table's own texts, with base spans labelled as they are
found and with planted spans of forms that no base pattern knows. Texts are
tagged in overlapping windows; what windows say of one text is reconciled over
the whole text, and a span is reported if it passes its kind's check.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tagger

#: The base kinds in listed order; "id" is only tagged.
KINDS = ("email", "ip", "card", "phone", "id")
#: Characters of a window, and how far the next one begins after it. The overlap
#: holds the longest form that is trained.
WINDOW, STEP = 96, 48
#: Texts that training windows are cut from, at most, the windows, their length.
SAMPLE, TRAINED, TRAINED_WINDOW = 1024, 16_000, 64
#: So much of a text is used to train on; all of it is tagged.
SAMPLED_CHARS = 1 << 16
#: Windows that are tagged together.
TOGETHER = 256
#: Every tagged span holds a digit, an at sign or an at in brackets: places
#: without one, further than a window away, need no window.
MARK = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match of the listed pattern begins at the first digit of a run, else it
#: would begin earlier; said in the pattern, long runs are passed once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their at signs: the local part is the run of
    its characters before one, back to the last match at most."""
    at, end = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield 0, begin, end
            at = text.find("@", end)
        else:
            # no match holds what stands before this sign
            end = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str, checked: bool = True) -> list[Span]:
    """(kind, start, end) of the base kinds, by kind and start, in time linear in
    the text's length. Without ``checked`` numbers of a card's length need not
    pass Luhn's check, nor parts of an address be small: no tagger can tell."""
    found = list(_emails(text))
    found += [(1, *m.span()) for m in _IP.finditer(text) if not checked or all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if len(m[0]) <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and (not checked or luhn(d))]
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


#: Forms of each kind, first those that base patterns find, then
#: others. d is any digit, h a hexadecimal one, N a name, H a host, E its end,
#: I a number up to 255; a backslash takes the next letter as it is.
FORMS = (
    (("N.N@H.E", "N_N@H.E", "Ndd@H.E", "N.dd@Hd.H.E", "N-N@H.H.E"), ("N.N [a\\t] H.E", "Ndd(a\\t)H.E", "N_N (a\\t) H (\\dot) E", "N.N[a\\t]H[\\dot]E", "N {a\\t} H.E", "N.N @ H.E", "Ñ.N@müller.E", "é.N@H.E")),
    (("I.I.I.I",), ("I[.]I[.]I[.]I", "I(.)I(.)I(.)I", "I[\\dot]I[\\dot]I[\\dot]I", "hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh", "hhhh:\\db8:hhhh:h:0:hhh:0:h")),
    (("dddddddddddddddd", "dddd dddd dddd dddd", "dddd-dddd-dddd-dddd"), ("dddd.dddd.dddd.dddd", "dddd  dddd  dddd  dddd", "dddd - dddd - dddd - dddd", "dddd/dddd/dddd/dddd")),
    (("+d (ddd) ddd-dddd", "+dd ddd ddd dddd", "+dd-dd-ddddddd", "+dd dd dddd dddd"), ("(ddd) ddd-dddd", "(ddd)ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "00dd dd ddddddd", "0ddd/ddddddd", "0d dd dd dd dd")),
    ((), ("ddd-dd-dddd", "D\\Edd dddd dddd dddd dddd dd", "FRdd dddd dddd dddd dddd dddd ddd", "GBdd dddd dddd dddd dddd", "\\ESdddddddddddddddddddddd", "\\NLdddddddddddddddd")),
)
HARMLESS = (
    "d", "dd", "ddd", "dddd", "ddddd", "dddddd", "dddddddd", "dddddddddd", "dddddddddddd", "d.d.", "d.d.d", "d.dd", "dd.ddd.ddd", "ddd,dd \\EUR", "20dd-dd-dd", "dd.dd.20dd", "dd/dd/20dd", "dd:dd", "dd:dd:dd", "vd.dd.d", "dddd-dddd", "dd-dd", "(d)", "[dd]", "§ddd",
    "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "hhhhhhhhhhhhhhhh", "hhhhhhhh", "hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh", "key=hhhhhhhhhhhhhhhhhhhh", "token: \"hhhhhhhhhhhhhhhhhhhhhhhh\"", "#ddddd", "\\No. dddd", "dd%", "dddd x ddd", "@", "@N", "d@dd", "add\\bd", "N [a\\t] N",
)
#: Kinds of what is planted, -1 for harmless digits; phones have the most forms.
MIX = (-1, -1, -1, 0, 1, 2, 3, 3, 3, 4)
_NAMES = ("anna", "otto", "maria", "jean", "luis", "petra", "kim", "sofia", "max", "ines", "paul", "lea")
_HOSTS = ("mail", "post", "web", "firma", "example", "uni", "shop", "net", "inbox", "home")
_ENDS = ("com", "org", "net", "de", "fr", "es", "info", "co.uk", "edu")


def _one(rng: random.Random, *of: str) -> str:
    return of[int(rng.random() * len(of))]


def filled(rng: random.Random, form: str) -> str:
    """``form`` with names, hosts and digits drawn."""
    out, letters = [], iter(form)
    for c in letters:
        if c == "\\":
            out.append(next(letters))
        elif c in "dh":
            out.append("0123456789abcdef"[int(rng.random() * (10 if c == "d" else 16))])
        elif c == "I":
            out.append(str(int(rng.random() * 256)))
        elif c in "NHE":
            out.append(_one(rng, *{"N": _NAMES, "H": _HOSTS, "E": _ENDS}[c]))
        else:
            out.append(c)
    return "".join(out)


def planted(rng: random.Random, kind: int) -> str:
    """A form of ``kind``; half of them are such that a base pattern finds."""
    common, others = FORMS[kind]
    return filled(rng, _one(rng, *(common if common and rng.random() < 0.5 else others)))


def training_windows(texts: list[str], many: int = TRAINED, seed: int = 5, window: int = TRAINED_WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, labels) of ``many`` windows cut from ``texts`` at random places,
    half of them near a digit. In most a planted span or harmless digits are put
    between two words; a window may cut a span."""
    rng = random.Random(seed)
    texts = [t for t in texts if t] or [" "]
    near = [(i, m.start()) for i, t in enumerate(texts) for m in MARK.finditer(t)]
    ids, labels = np.zeros((many, window), np.int64), np.zeros((many, window), np.int64)
    for k in range(many):
        if near and rng.random() < 0.3:
            i, place = near[int(rng.random() * len(near))]
            begin = max(0, place - int(rng.random() * window))
        else:
            i = int(rng.random() * len(texts))
            begin = int(rng.random() * max(1, len(texts[i]) - window))
        part = texts[i][begin : begin + window]
        spans = base_spans(part, checked=False)
        if rng.random() < 0.85:
            kind = rng.choice(MIX)
            put = filled(rng, _one(rng, *HARMLESS)) if kind < 0 else planted(rng, kind)
            places = [0, *(m.end() for m in re.finditer(r"[ \n]", part)), len(part)]
            place = places[int(rng.random() * len(places))]
            if not any(s < place < e for _, s, e in spans):
                glue = _one(rng, " ", " ", " ", ". ", ", ", "\n", "!! ", ": ", ") ")
                before = _one(rng, "", "", "", "", "(", "\"", "tel: ", "id ", ": ")
                part = part[:place] + before + put + glue + part[place:]
                shift = len(before) + len(put) + len(glue)
                spans = [(q, s + shift * (s >= place), e + shift * (s >= place)) for q, s, e in spans]
                if kind >= 0:
                    spans.append((kind, place + len(before), place + len(before) + len(put)))
                else:
                    spans += [x for x in base_spans(part, checked=False) if x not in spans]
        cut = int(rng.random() * max(1, len(part) - window + 1))
        part = part[cut : cut + window]
        ids[k, : len(part)] = tagger.symbols(part)
        for kind, s, e in spans:
            s, e, whole = max(0, s - cut), min(len(part), e - cut), s >= cut
            if s < e:
                labels[k, s:e] = 2 * kind + 2
                labels[k, s] = 2 * kind + (1 if whole else 2)
    return ids, labels


def trained(texts: list[str], many: int = TRAINED, seed: int = 5) -> tagger.Tagger:
    """A tagger fitted on windows of ``texts``; one for the same texts and seed."""
    return tagger.fit(*training_windows(texts, many, seed), kinds=len(KINDS))


def window_starts(text: str) -> list[int]:
    """Where windows begin: every ``STEP``, wherever a mark is in reach."""
    starts: list[int] = []
    for m in MARK.finditer(text):
        low, high = max(0, m.start() - WINDOW) // STEP, (m.start() + WINDOW // 2) // STEP
        starts += range(max(low, starts[-1] + 1 if starts else 0), high + 1)
    return [s * STEP for s in starts if s * STEP < len(text)]


def _pieces(start: int, path: np.ndarray, margin: np.ndarray, length: int, more: bool) -> list[tuple]:
    """(kind, start, end, weight, cut at left, cut at right) of one window."""
    out, label = [], path[:length]
    edge = np.flatnonzero(np.diff(label, prepend=0, append=0) != 0)
    begins = [t for t in edge if t < length and label[t] and (label[t] % 2 or t == 0)]
    for t in begins:
        kind, end = (int(label[t]) - 1) // 2, int(t) + 1
        while end < length and label[end] == 2 * kind + 2:
            end += 1
        out.append((kind, start + int(t), start + end, float(margin[t:end].sum()), t == 0 and start > 0, end == length and more))
    return out


def reconciled(pieces: list[tuple]) -> list[Span]:
    """One set of spans from the pieces that all windows of a text gave.

    Pieces of a kind that overlap or touch, of which one was cut by its window's
    edge there, are parts of one span; equal ones count once, by the greater
    weight. Of what still overlaps, the set of the greatest weight stays, which
    weighted interval scheduling finds over the whole text.
    """
    merged: list[list] = []
    last: dict[int, list] = {}
    for kind, s, e, weight, left, right in sorted(pieces):
        now = last.get(kind)
        if now and (s, e) == (now[1], now[2]):
            now[3], now[4], now[5] = max(now[3], weight), now[4] and left, now[5] and right
        elif now and s <= now[2] and (now[5] and e >= now[2] or left or now[1] == s and (now[5] or right)):
            now[3] = max(now[3], weight)
            now[5] = right if e > now[2] else now[5] and e == now[2]
            now[2] = max(now[2], e)
        else:
            now = [kind, s, e, weight, left, right]
            last[kind] = now
            merged.append(now)
    merged = sorted((m for m in merged if m[3] > 0), key=lambda m: (m[2], m[1]))
    ends = [m[2] for m in merged]
    best, take = [0.0], []
    for i, m in enumerate(merged):
        before = bisect_right(ends, m[1], 0, i)
        take.append(before if best[before] + m[3] > best[-1] else -1)
        best.append(max(best[-1], best[before] + m[3]))
    out, i = [], len(merged)
    while i:
        if take[i - 1] >= 0:
            out.append(tuple(merged[i - 1][:3]))
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


_MAIL = re.compile(r"[\w.%+-]+(?:\s?(?:@|[\[({]\s?at\s?[\])}])\s?)[\w-]+(?:(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\.)[\w-]+)+")
_DEFANGED = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)[0-9]{1,3}){3}")
_IPV6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")


def passes(kind: int, text: str) -> bool:
    """If a tagged span is what its kind says."""
    digits = _digits(text)
    if kind == 0:
        return bool(_MAIL.fullmatch(text))
    if kind == 1:
        return bool(_IPV6.fullmatch(text)) or bool(_DEFANGED.fullmatch(text)) and all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search("[^0-9 ./-]", text)
    if kind == 3:
        return 9 <= len(digits) <= 15 and not re.search(r"[^0-9 ()+./-]", text) and len(re.findall("[0-9]+", text)) > 1
    bare = text.replace(" ", "")
    if re.fullmatch("[A-Z]{2}[0-9]{14,30}", bare):
        return int(bare[4:] + str(ord(bare[0]) - 55) + str(ord(bare[1]) - 55) + bare[2:4]) % 97 == 1
    return bool(re.fullmatch("(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", text))


_EDGES = " \t\n\r.,;:!?\"'"


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _EDGES:
        start += 1
    while start < end and text[end - 1] in _EDGES:
        end -= 1
    return start, end


def settled(text: str, span: Span) -> Span | None:
    """A tagged span as it is reported. It is widened by what stands between it
    and white space, a window's length at most, if the whole passes a check; else
    taken as it is. It goes under its own kind's name if that check passes, else
    under the first that does, as tags of like forms may be mixed up."""
    kind, start, end = span
    low, high = start, end
    while low > 0 and start - low < WINDOW and not text[low - 1].isspace():
        low -= 1
    while high < len(text) and high - end < WINDOW and not text[high].isspace():
        high += 1
    for s, e in (_trimmed(text, low, high), _trimmed(text, start, end)):
        for k in (kind, *range(len(KINDS))):
            if s < e and passes(k, text[s:e]):
                return k, s, e
    return None


def all_spans(texts: list[str], model: tagger.Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and the spans that the tagger adds: those
    that pass a check and meet no base span but such as they hold whole."""
    waiting: list[tuple[int, int]] = []
    pieces: list[list[tuple]] = [[] for _ in texts]

    def tag() -> None:
        ids = np.zeros((len(waiting), WINDOW), np.int64)
        for k, (i, s) in enumerate(waiting):
            part = tagger.symbols(texts[i][s : s + WINDOW])
            ids[k, : len(part)] = part
        path, margin = tagger.decode(model, ids)
        for k, (i, s) in enumerate(waiting):
            length = min(WINDOW, len(texts[i]) - s)
            pieces[i] += _pieces(s, path[k], margin[k], length, s + length < len(texts[i]))
        waiting.clear()

    for i, text in enumerate(texts):
        for s in window_starts(text):
            waiting.append((i, s))
            if len(waiting) >= TOGETHER:
                tag()
    if waiting:
        tag()
    out = []
    for text, own in zip(texts, pieces, strict=True):
        base, more = base_spans(text) if MARK.search(text) or "+" in text else [], []
        taken = sorted((s, e) for _, s, e in base)
        ends = np.maximum.accumulate([e for _, e in taken]).tolist()
        for span in reconciled(own) if own else []:
            found = settled(text, span)
            if found and found not in more:
                _, s, e = found
                first, last = bisect_right(ends, s), bisect_right(taken, (e - 1, len(text)))
                # beside all base spans, or around those that it meets
                if all(s <= b and f <= e and (b, f) != (s, e) for b, f in taken[first:last]):
                    more.append(found)
        out.append((base, more))
    return out


SCHEMA = "doc_id long, base array<struct<kind:int,start:int,end:int>>, more array<struct<kind:int,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def find_personal(docs: DataFrame, sample: int = SAMPLE, many: int = TRAINED, seed: int = 5) -> DataFrame:
    """Spans of personal data in ``docs(doc_id, text)``; one row for each.

    Returns doc_id, base (spans of the base patterns) and more (what the tagger
    adds), arrays of (kind, start, end) in code points by kind and start, where
    kind indexes ``KINDS``. The tagger is fitted once, on ``many`` windows of at
    most ``sample`` different texts, those with the smallest hashes, up to
    ``SAMPLED_CHARS`` of each; so equal tables give equal spans. Null and empty texts have no spans. Texts of any
    length are searched whole, and a task holds one batch of texts and ``TOGETHER``
    windows. Each row is searched for itself, where it is read: repeated rows
    give repeated results, ids may tie or be null, and an empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # hashes are few bytes, so they alone are sorted; then their texts are fetched
    named = rows.where("text <> ''").select(F.xxhash64("text").alias("h"), "text")
    least = [r.h for r in named.select("h").distinct().orderBy("h").limit(sample).collect()]
    some = named.where(F.col("h").isin(least)).groupBy("h").agg(F.min(F.substring("text", 1, SAMPLED_CHARS)).alias("text"))
    texts = [r.text for r in some.orderBy("h").collect()] if least else []
    if not texts:
        return rows.select("doc_id", *[F.array().cast("array<struct<kind:int,start:int,end:int>>").alias(c) for c in ("base", "more")])
    model = spark.sparkContext.broadcast(trained(texts, many, seed))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = all_spans(batch.column(1).to_pylist(), model.value)
                named = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(f[k])] for f in found] for k in range(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, _SPANS) for n in named)], names=["doc_id", "base", "more"])

    return rows.mapInArrow(of, SCHEMA)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every run of overlapping spans made its kind's mark."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order of the array."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
