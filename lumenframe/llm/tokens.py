"""Token ids of whole texts, equal to those of the tokenizers library, with a bounded word cache per Python worker.

Both public BPE files treat a run of white space as a border: no token of one piece depends on the next. So a text is
cut into pieces, each distinct piece is encoded once by the library's own BPE model, and a text's ids are the joined
bytes of its pieces. Texts of other tokenizer files are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

# The Unicode White_Space characters, as the inside of a character class.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# The word pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces and words a worker keeps; words cost most to encode, pieces are put together from them.
CACHE_PIECES, CACHE_WORDS = 200_000, 800_000


def public_path(name: str) -> str:
    """Place of a public vocabulary file; resolved on the worker that opens it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes a byte as itself if printable in Latin-1, else as the next character from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return table


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        out = self[key] = self.make(key)
        return out


class PieceEncoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``; texts that hold an added token go to the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        plain = all(not t.get("normalized") for t in spec.get("added_tokens", []))  # else they are sought in the normalised text
        before, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [])
        self.words = self.pieces = None
        if not plain:
            pass
        elif before is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.pieces = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
            self.words, self.lower = regex.compile(BYTE_LEVEL_PATTERN), False
        elif before and [x["type"] for x in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["invert"]:
            self.pieces = re.compile(f"[^{WHITE_SPACE}]+")
            self.words, self.lower = regex.compile(parts[0]["pattern"]["Regex"]), True
        self.of_word = _Cache(self._word)
        self.of_piece = _Cache(self._piece)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalnum() and word[0] == " ":
            word = self.alphabet[32] + word[1:]
        elif not (word.isascii() and word.isalnum()):
            word = word.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() and max(piece) >= "\u0250":  # beyond Latin, leave normalising to the library
            return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if self.lower:
            piece = unicodedata.normalize("NFC", piece).lower()
        bare = piece[1:] if piece[0] == " " else piece
        if bare.isalpha():
            return self.of_word[piece]
        if bare[:-1].isalpha() and piece[-1] in ".,;:!?":
            return self.of_word[piece[:-1]] + self.of_word[piece[-1]]
        return b"".join(map(self.of_word.__getitem__, self.words.findall(piece)))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self.pieces is None or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        for cache, most in ((self.of_piece, CACHE_PIECES), (self.of_word, CACHE_WORDS)):
            if len(cache) > most:
                cache.clear()
        return np.frombuffer(b"".join(map(self.of_piece.__getitem__, self.pieces.findall(text))), self.dtype)


@lru_cache(maxsize=2)
def shared_encoder(name: str) -> PieceEncoder:
    """The encoder of a vocabulary file (a public name or a path), kept between the tasks of a Python worker."""
    return PieceEncoder(name if "/" in name else public_path(name))
