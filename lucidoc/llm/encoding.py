"""Exact ids of a `tokenizers` file, with a memory of chunks.

The pre-tokenizer of the file this is made for never lets a token cross an ASCII blank, nor the
border between a word of Latin letters and one final dot or comma, and its normalizers (NFC,
blanks, lower case) act on each side of such a border alone. So a text's ids are those of its
chunks in turn, and the library needs to see each distinct chunk once. `splits` holds what a probe
of the file found; a file without the property is encoded text by text.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import Memory

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
BLANK = "\x20\x09-\x0d"
END = f"(?=[{BLANK}]|\\Z)"
CHUNKS = re.compile(f"[{LATIN}]+(?=[.,]?(?:[{BLANK}]|\\Z))|(?<=[{LATIN}])[.,]{END}|[^{BLANK}]+")
LETTERS = re.compile(f"[{LATIN}]+\\Z")
PROBES = ("the cat, a dog.", "Ab'c  d\n\te..", "x́ ́y", "a<|endoftext|>b <|endoftext|> c.", "1 2.\r\n3", "é, 京. \x1c q", "Straße ÀÉ naïve DON'T.")


def shown_bytes() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else 256 and up."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """`encode(texts)` gives each text's ids as little-endian unsigned 32-bit bytes.

    Up to `remember` chunks and those of one call are kept; the longest kept has `longest` characters.
    """

    def __init__(self, path: str, remember: int = 1_000_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.remember = remember
        self.known = Memory(self._chunk, longest)
        self.shown = shown_bytes()
        self.splits = all(self._whole(t) == b"".join(map(self._chunk, CHUNKS.findall(t))) for t in PROBES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """A word of Latin letters is one pre-token, so the model alone can take it."""
        if not LETTERS.match(chunk):
            return self._whole(chunk)
        low = chunk.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.shown)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(low)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.splits:
            return [self._whole(t) if t else b"" for t in texts]
        self.known.begin(self.remember)
        get, find = self.known.__getitem__, CHUNKS.findall
        # Lower-casing ASCII first, as the file does later, makes fewer distinct chunks; "|" begins special tokens.
        return [b"".join(map(get, find(t.lower() if t.isascii() and "|" not in t else t))) if t else b"" for t in texts]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, remember: int = 1_000_000) -> ChunkEncoder:
    """One encoder for a Python worker and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    _encoders[path].remember = remember
    return _encoders[path]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
