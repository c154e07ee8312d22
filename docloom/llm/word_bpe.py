"""Ids of a word-end BPE vocabulary, with words that were seen before taken from memory."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib

from docloom.llm.common import remembered

#: Fixed values of the tokenizer file: its split pattern and its special tokens.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable letter; bytes without one of their own follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memory(dict):
    """Remembers what make(key) gave."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        found = self[key] = self.make(key)
        return found


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordBpe:
    """encode(text) gives what the tokenizer gives without special tokens added, as little-endian 32-bit ids.

    White space always ends a word in this vocabulary, so the ids of a text are the ids of its words.
    Words are kept up to a bound and forgotten together beyond it. Texts with special tokens or with
    control characters on which Python and the tokenizer differ, and words beyond Latin letters, go
    to the tokenizer itself.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(SPLIT)
        self.whole = re.compile("[\x1c-\x1f\x85]|" + "|".join(map(re.escape, SPECIAL)))
        self.letters = _byte_letters()
        self.most_words = most_words
        self.words = _Memory(self._word)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
        return _packed([t.id for t in self.tokenizer.model.tokenize(spelled)])

    def _word(self, word: str) -> bytes:
        if not word.isascii() and max(word) >= "ɐ":
            return self._whole(word)
        plain = word.lower() if word.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", word))
        parts = self.pattern.findall(plain)
        # a part is a word of its own, and its own only part
        return self._part(word) if parts == [word] else b"".join(map(self.words.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        if self.whole.search(text):
            return self._whole(text)
        if len(self.words) > self.most_words:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, text.split()))


@remembered
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker, so that its words last from task to task of packing."""
    return WordBpe(path)


def piece_sums(ids: bytes, window: int):
    """(start, length, crc32) of each cut of at most window ids."""
    for start in range(0, len(ids), 4 * window):
        cut = ids[start : start + 4 * window]
        yield start // 4, len(cut) // 4, zlib.crc32(cut)
