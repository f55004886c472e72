"""Operator 13: fill-in-the-middle by ropes.

A rope is a balanced tree over the units of a text. Its leaves hold a slice of
the text and the places where units end, and every node caches how many units
and how many code points stand below it. A text is cut by splitting its rope at
two unit ranks; the parts are concatenated in another order with sentinels
between them. The way back splits the rope of the output at the sentinels.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of a leaf, at most.
LEAF = 2048
#: Prefix, suffix and middle are marked by these, in this order.
SENTINELS = ("<P>", "<S>", "<M>")
#: Units by name: code points, or a pattern that matches one unit after another.
UNITS = {"code_point": None, "word": r"\s*\S+|\s+", "line": r"[^\n]*\n|[^\n]+"}
#: Of 100 documents so many stay plain, and of the others so many are spm.
PLAIN, SPM = 10, 20


@dataclass(frozen=True, slots=True)
class Leaf:
    """A slice of a text; ``ends`` has the code points at which its units end,
    or is None where every code point is a unit."""

    text: str
    ends: tuple[int, ...] | None
    units: int
    chars: int
    depth = 0


@dataclass(frozen=True, slots=True)
class Node:
    left: Node | Leaf
    right: Node | Leaf
    units: int
    chars: int
    depth: int


EMPTY = Leaf("", None, 0, 0)


def _node(a: Node | Leaf, b: Node | Leaf) -> Node:
    return Node(a, b, a.units + b.units, a.chars + b.chars, 1 + max(a.depth, b.depth))


def join(a: Node | Leaf, b: Node | Leaf) -> Node | Leaf:
    """The concatenation of two ropes. Of ropes of uneven depth the shallow one
    is hung into the deep one's near side, and a node that leans is rotated, so
    the depth stays logarithmic."""
    if not a.chars or not b.chars:
        return b if not a.chars else a
    if a.depth > b.depth + 1:
        right = join(a.right, b)
        if right.depth > a.left.depth + 1 and right.left.depth > right.right.depth:
            return _node(_node(a.left, right.left.left), _node(right.left.right, right.right))
        return _node(_node(a.left, right.left), right.right) if right.depth > a.left.depth + 1 else _node(a.left, right)
    if b.depth > a.depth + 1:
        left = join(a, b.left)
        if left.depth > b.right.depth + 1 and left.right.depth > left.left.depth:
            return _node(_node(left.left, left.right.left), _node(left.right.right, b.right))
        return _node(left.left, _node(left.right, b.right)) if left.depth > b.right.depth + 1 else _node(left, b.right)
    return _node(a, b)


def _cut(leaf: Leaf, units: int, chars: int) -> tuple[Leaf, Leaf]:
    left, right = leaf.text[:chars], leaf.text[chars:]
    if leaf.ends is None:
        return Leaf(left, None, chars, chars), Leaf(right, None, leaf.chars - chars, leaf.chars - chars)
    ends = tuple(e - chars for e in leaf.ends[units:])
    return Leaf(left, leaf.ends[:units], units, chars), Leaf(right, ends, leaf.units - units, leaf.chars - chars)


def split(rope: Node | Leaf, rank: int, by: str = "units") -> tuple[Node | Leaf, Node | Leaf]:
    """The rope's first ``rank`` units (or code points, ``by`` "chars") and the
    rest. Only the nodes on the way to the cut are made anew. A cut by code
    points inside a unit leaves it to the right part."""
    count = getattr(rope, by)
    if rank <= 0 or rank >= count:
        return (EMPTY, rope) if rank <= 0 else (rope, EMPTY)
    if isinstance(rope, Leaf):
        if rope.ends is None:
            return _cut(rope, rank, rank)
        if by == "units":
            return _cut(rope, rank, rope.ends[rank - 1])
        return _cut(rope, sum(e <= rank for e in rope.ends), rank)
    own = getattr(rope.left, by)
    if rank == own:
        return rope.left, rope.right
    if rank < own:
        left, right = split(rope.left, rank, by)
        return left, join(right, rope.right)
    left, right = split(rope.right, rank - own, by)
    return join(rope.left, left), right


def _balanced(leaves: list[Leaf]) -> Node | Leaf:
    if len(leaves) == 1:
        return leaves[0]
    half = len(leaves) // 2
    return _node(_balanced(leaves[:half]), _balanced(leaves[half:]))


def rope_of(text: str, unit: str | None = None, leaf: int = LEAF) -> Node | Leaf:
    """The rope of ``text``, whose units are code points or, left to right, the
    matches of the pattern ``unit``; what matches nothing belongs to the unit
    that follows it, or is the last one."""
    if unit is None:
        leaves: list[Leaf] = [Leaf(p, None, len(p), len(p)) for p in (text[i : i + leaf] for i in range(0, len(text), leaf))]
    else:
        ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()]
        if text and (not ends or ends[-1] < len(text)):
            ends.append(len(text))
        leaves, begin = [], 0
        for i in range(0, len(ends), leaf):
            own = ends[i : i + leaf]
            leaves.append(Leaf(text[begin : own[-1]], tuple(e - begin for e in own), len(own), own[-1] - begin))
            begin = own[-1]
    return _balanced(leaves) if leaves else EMPTY


def text_of(rope: Node | Leaf) -> str:
    parts, ahead = [], [rope]
    while ahead:
        at = ahead.pop()
        if isinstance(at, Leaf):
            parts.append(at.text)
        else:
            ahead += [at.right, at.left]
    return "".join(parts)


def rearranged(rope: Node | Leaf, first: int, second: int, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[Node | Leaf, int, int]:
    """(output, code points of the prefix, of the middle): the rope cut at the
    unit ranks ``first`` <= ``second``, in the order of ``form`` (psm or spm)."""
    rest, suffix = split(rope, second)
    prefix, middle = split(rest, first)
    p, s, m = (rope_of(x) for x in sentinels)
    parts = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    return reduce(join, parts), prefix.chars, middle.chars


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text from which ``output`` was made, from the output and its form."""
    if form == "plain":
        return output
    order = (0, 1, 2) if form == "psm" else (1, 0, 2)
    rest, parts, begin = rope_of(output), {}, 0
    places = [output.find(sentinels[i]) for i in order]
    for i, at, end in zip(order, places, (*places[1:], len(output)), strict=True):
        _, rest = split(rest, at - begin, "chars")
        marked, rest = split(rest, end - at, "chars")
        parts[i] = split(marked, len(sentinels[i]), "chars")[1]
        begin = end
    return text_of(join(join(parts[0], parts[2]), parts[1]))


def choice(doc_id: int | None, n: int, plain: int = PLAIN, spm: int = SPM, seed: int = 1) -> tuple[int, int, str]:
    """(first rank, second rank, form) of a document with ``n`` units, drawn from
    the sha256 of ``seed``, a colon and its id (nothing for a null id)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b), "plain" if h3 % 100 >= 100 - plain else "spm" if h4 % 100 < spm else "psm"


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _batches(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fill_in_middle(docs: DataFrame, unit: str = "code_point", sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, spm: int = SPM, seed: int = 1) -> DataFrame:
    """Rearranges ``docs(doc_id, text)`` for fill-in-the-middle training.

    Returns doc_id, n (units of the text), form, prefix_chars and middle_chars
    (code points, null if plain) and output. Form is plain if the text is empty
    or holds a sentinel, or for ``plain`` in 100 documents; else spm for ``spm``
    in 100, else psm. One row for each row of ``docs``, made where it is read,
    without a shuffle; a task holds a few texts. Null texts are "". A text of
    any length is cut whole. Rows of one doc_id are cut at the same draws; all
    null ids are drawn alike. An empty table gives no rows; other columns are
    not read. Each sentinel must begin with a character that none holds further on,
    so that texts and sentinels side by side never look like another sentinel.
    """
    if unit not in UNITS:
        raise ValueError(f"no unit {unit!r}; there are {', '.join(UNITS)}")
    if not all(sentinels) or len(set(sentinels)) < 3 or any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("sentinels must differ, and begin with a character that none holds further on")
    pattern = UNITS[unit]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _batches(whole):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = text or ""
                    rope = rope_of(text, pattern)
                    first, second, form = choice(doc_id, rope.units, plain, spm, seed)
                    if form == "plain" or not text or any(s in text for s in sentinels):
                        rows.append((doc_id, rope.units, "plain", None, None, text))
                    else:
                        output, prefix, middle = rearranged(rope, first, second, form, sentinels)
                        rows.append((doc_id, rope.units, form, prefix, middle, text_of(output)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, SCHEMA)


def restore_middle(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``made(form, output)`` and whatever else it holds, with ``restored``: the
    text rebuilt from output and form alone. Null outputs or forms give null;
    an empty table gives no rows."""
    rest = made.drop("restored")
    schema = rest.schema.simpleString()[7:-1]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _batches(whole):
                pairs = zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)
                texts = [None if o is None or f is None else restored(o, f, sentinels) for o, f in pairs]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.large_string())], names=[*batch.schema.names, "restored"])

    return rest.mapInArrow(back, f"{schema}, restored string")


#: DuckDB SQL for the query over ``documents``.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || x[1:8])::BIGINT % (n + 1) AS a, ('0x' || x[9:16])::BIGINT % (n + 1) AS b, ('0x' || x[17:24])::BIGINT % 100 AS p, ('0x' || x[25:32])::BIGINT % 100 AS s FROM d),
f AS (SELECT doc_id, t, n, least(a, b) AS a, greatest(a, b) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
  ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS output FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
