"""The words of many texts at once: numpy over the bytes of an Arrow column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: What a byte is: part of a word, between words, or the end of a piece.
WORD, BLANK, STOP = 0, 1, 2

#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_kinds(blank: bytes, stop: bytes = b"") -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[list(blank)] = BLANK
    kinds[list(stop)] = STOP
    return kinds


@dataclass
class Words:
    """words: one after another, lower-cased; doc: the text of each, by its place; apart: whether a text or piece begins before it."""

    words: pa.Array
    doc: np.ndarray
    apart: np.ndarray


def words_of(texts: pa.Array, kinds: np.ndarray) -> Words:
    """All words of texts. Null and empty texts have none. Separators must be ASCII, so words stay whole in UTF-8."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    if offsets[0] == offsets[-1]:
        return Words(pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
    data = LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    kind = kinds[data]
    inside = kind == WORD
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # where texts that are not empty begin
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = np.append(first[1:], len(data)) - 1
    ends[last] = inside[last]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(to - at, out=bounds[1:])
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
    doc = np.searchsorted(offsets, at, "right") - 1
    apart = np.ones(len(at), dtype=bool)
    stops = np.cumsum(kind == STOP, dtype=np.int64)[at]
    apart[1:] = (doc[1:] != doc[:-1]) | (stops[1:] != stops[:-1])
    return Words(words, doc, apart)


def codes_of(words: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Each word's number (int32) in the list of distinct words, and that list, in order of first use."""
    coded = pa.concat_arrays(words or [pa.array([], pa.large_string())]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def stable_order(codes: np.ndarray) -> np.ndarray:
    """argsort of int32 codes that are not negative, ties in order: two radix sorts of 16 bits."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if len(codes) and codes.max() > 0xFFFF:
        order = order[np.argsort((codes >> 16).astype(np.uint16)[order], kind="stable")]
    return order
