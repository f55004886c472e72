"""Token ids of whole texts through the tokenizers library, at corpus speed.

A text is split by its vocabulary's pattern before any merge, and the ids of a
part depend on nothing outside it. Natural text repeats parts, hence a worker
keeps the ids of parts it has met and asks the library for new ones only.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_LETTER = "A-Za-zÀ-ÖØ-öø-įĲ-ſ"
_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
#: Characters for which Python's ``re`` splits exactly as the library does.
_PLAIN = re.compile(rf"[\x20-\x7e\t\n\r{_LETTER}¡¿«»–—‘’“”…€]*")
#: The split patterns of the two vocabularies, for plain texts.
_BYTE_LEVEL = re.compile(rf"{_CONTRACTION}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(rf"{_CONTRACTION}|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")
_LONG = 64


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PartEncoder:
    """``encode`` gives a text's ids as little-endian unsigned 32-bit bytes.

    ``path`` names a tokenizers file with byte-level letters; ``spaces`` tells
    if white space yields ids (byte-level) or is dropped and letters lowered
    (word-level). At most about ``keep`` parts are remembered. Texts with
    characters outside Latin script go to the library whole, and so do those
    that hold the string of an added token, which is then one id as the library
    has it. Null and "" have no ids.
    """

    def __init__(self, path: str, spaces: bool, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merges = self.library.model
        self.find = (_BYTE_LEVEL if spaces else _WORD_LEVEL).findall
        self.lower = not spaces
        self.keep, self.known = keep, {}
        self.letters = _byte_letters()

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        shown = part.translate(self.letters) if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or any(a in text for a in self.added):
            return self.whole(text)
        parts = self.find(text.lower() if self.lower else text)
        known = self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) > self.keep:
            known.clear()
        ids = {p: self.part(p) for p in dict.fromkeys(parts) if p not in known}
        known.update((p, i) for p, i in ids.items() if len(p) <= _LONG)
        return b"".join([ids[p] if p in ids else known[p] for p in parts])


_encoders: dict[tuple, PartEncoder] = {}


def encoder(path: str, spaces: bool) -> PartEncoder:
    """One encoder for each file in a Python worker, kept between tasks."""
    key = (path, spaces)
    if key not in _encoders:
        _encoders[key] = PartEncoder(path, spaces)
    return _encoders[key]
