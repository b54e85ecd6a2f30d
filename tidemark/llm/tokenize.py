"""Token ids from public tokenizer files, with a bounded cache of what the tokenizer's own pieces encode to.

``encode`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``. Both supported kinds of file cut a
text by a pattern before any merge, so that a piece's ids don't depend on its neighbours: texts of ASCII and Latin letters are cut by
the same pattern here and looked up piece by piece. Other texts are cut at white space where that is sure, or encoded whole, as are
texts that may hold a special token's string. With ``special_as_text`` such strings are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Bytes that a worker keeps pieces and their ids in, half of them recent, half from the time before; longer pieces aren't kept.
CACHE_BYTES, LONGEST = 256 << 20, 256
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 200

#: White space that str methods know and the tokenizers' patterns don't, or don't in every version.
_ODD = re.compile("[\x1c-\x1f\u180e]")
_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
#: Characters of which it is sure, in any version, whether they are letters, digits or signs.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[ \t\n\r!-~{_LETTER}]*").fullmatch
# The cutting patterns of the two kinds of file, for plain characters.
_SPACED = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s0-9{_LETTER}]+|\\s+(?!\\S)|\\s+").findall
_ENDED = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+").findall


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def find(tokenizer: str) -> str:
    """A path as it is; a bare name is one of the public files installed on each machine."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


class Cache(dict):
    """What ``make`` gives for a key. Of ``limit`` bytes, half are recent; entries of the time before come back when asked for."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        self.make, self.half, self.held, self.before = make, limit // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST:
            return self.make(key)
        if self.held >= self.half:
            self.before, self.held = dict(self), 0
            self.clear()
        got = self.before.get(key)
        self[key] = got = self.make(key) if got is None else got
        self.held += ENTRY_BYTES + 2 * len(key) + len(got)
        return got


class Encoder:
    def __init__(self, tokenizer: str, limit: int = CACHE_BYTES, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(find(tokenizer))
        self.full.encode_special_tokens = special_as_text
        self.model = self.full.model
        told = json.loads(self.full.to_str())
        pre, self.folds = told["pre_tokenizer"] or {}, told["normalizer"] is not None
        parts = [x["type"] for x in pre.get("pretokenizers", [])]
        spaced = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not self.folds
        ended = parts == ["Split", "ByteLevel"] and told["model"].get("end_of_word_suffix") and [x["type"] for x in told["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.kind = "spaced" if spaced else "ended" if ended else "whole"
        added = [x["content"] for x in told["added_tokens"]]
        #: A string that every added token begins with; texts without it hold none.
        self.mark = None if special_as_text or not added else os.path.commonprefix([x.lower() for x in added])
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        letters = byte_letters()
        self.letter = {chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces, self.units = Cache(self._piece, limit), Cache(self._whole, limit // 4)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes() if len(ids) > 64 else array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.full.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of plain characters, as the pattern cuts them."""
        bare = piece[1:] if piece[0] == " " else piece
        lead = self.letter[" "] if piece[0] == " " else ""
        piece = lead + (bare if bare.isascii() and bare.isalpha() else "".join(map(self.letter.__getitem__, bare)))
        return self._pack([t.id for t in self.model.tokenize(piece)])

    def _bytes(self, text: str) -> bytes:
        if self.kind == "whole" or not text or (self.mark is not None and self.mark in text.lower()):
            return self._whole(text)
        if _PLAIN(text):
            cut = _SPACED(text) if self.kind == "spaced" else _ENDED(text.lower())
            return b"".join(map(self.pieces.__getitem__, cut))
        if _ODD.search(text):
            return self._whole(text)
        return b"".join(map(self.units.__getitem__, _UNITS(text) if self.kind == "spaced" else text.split()))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._bytes(text), self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str, special_as_text: bool = False) -> Encoder:
    """One encoder a worker process and file; workers outlive tasks, and so does the cache."""
    key = f"{tokenizer}|{special_as_text}"
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer, special_as_text=special_as_text)
    return _encoders[key]
