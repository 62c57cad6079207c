"""Token ids of whole texts by the tokenizers library, part by part.

The vocabulary file lower-cases a text and cuts it into runs of letters, single digits and runs of marks before it merges
anything, so a text's ids are its parts' ids in order. Parts repeat: each worker keeps the ids of those that it has seen
(``MOST_PARTS`` at most, then it starts anew). In texts of plain characters the parts go straight to the library's merge
model; texts with any other character, or with a special token's string, go through the library's whole encoder by word.
"""

from __future__ import annotations

import json
import re
from array import array

MOST_PARTS = 200_000
#: Anything but ASCII and the letters of Latin-1: for these alone lower case and composed form are one character each.
_OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_PART = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\x20\x09-\x0Da-z0-9ß-öø-ÿ]+")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 as it is, the rest from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in set(seen))
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Key to its ids as unsigned 32-bit integers in the machine's order; missing ones are encoded on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, key: str) -> bytes:
        ids = self[key] = array("I", self.encode(key)).tobytes()
        return ids


class TokenIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        model, letters = whole.model, byte_letters()
        letter = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        special = [re.escape(t["content"]) for t in json.loads(whole.to_str())["added_tokens"]]
        self.special = re.compile("|".join(special) or "(?!)")
        self.parts = _Known(lambda part: [t.id for t in model.tokenize(part.translate(letter))])
        self.words = _Known(lambda word: whole.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        if not text.isascii() and _OTHER.search(text) or self.special.search(text):
            known, found = self.words, _SPACES.split(text)
        else:
            known, found = self.parts, _PART.findall(text.lower())
        if len(known) > MOST_PARTS:
            known.clear()
        return b"".join(map(known.__getitem__, found))


_OPEN: dict[str, TokenIds] = {}


def encoder(path: str) -> TokenIds:
    """One encoder per worker and vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = TokenIds(path)
    return _OPEN[path]
