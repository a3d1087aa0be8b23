"""Byte-level pre-tokens of a batch of texts, cut with array operations.

The cut is that of the public byte-level BPE pattern: contractions; an optional space with a run of
letters, of digits or of other signs; white space, of which the last sign is left to what follows.
Texts of a batch are laid end to end, code points are looked up in a class table, and token starts
come from class changes; no pattern is run over the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, SPACE, LETTER, DIGIT = 0, 1, 2, 3
# The code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK_BYTES = 4_000_000


@cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": DIGIT}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], "uint8")
    table[WHITE_SPACE] = SPACE
    return table


@dataclass
class Pretokens:
    """Tokens of consecutive texts: ``words[index[t]]`` is token t, ``counts`` are tokens per text."""

    words: pa.BinaryArray
    index: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray | None = None
    chars: np.ndarray | None = None


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of consecutive texts that hold about ``most`` bytes together; a longer text stays whole."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, z in enumerate(sizes):
        if held and held + z > most:
            yield start, i
            start, held = i, 0
        held += int(z)
    if start < len(sizes):
        yield start, len(sizes)


def cut(texts: pa.Array, detail: bool = False) -> Pretokens:
    """Pre-tokens of the texts (null counts as empty). ``detail`` adds characters per token."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = "".join(texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), "uint32")
    n = len(points)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype("int64")
    starts = np.concatenate([[0], np.cumsum(lengths)])
    if n == 0:
        none = np.zeros(0, "int64")
        return Pretokens(pa.array([], pa.binary()), none.astype("int32"), np.zeros(len(lengths), "int64"), none, none)
    kind = classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[starts] = True
    at = np.empty(n + 1, bool)
    at[1:n] = kind[1:] != kind[:-1]
    at[[0, n]] = True
    at |= fresh

    # The last sign of a run of white space goes with what follows if it is a blank, else stands alone.
    runs = np.flatnonzero(at)
    first, end = runs[:-1], runs[1:]
    inner = (kind[first] == SPACE) & ~fresh[end]
    last = end[inner] - 1
    at[last] = True
    blank = points[last] == 32
    at[end[inner][blank]] = False

    # Contractions start a token of their own where the apostrophe does.
    quote = np.flatnonzero((points == 39) & at[:n])
    quote = quote[(quote + 1 < n)]
    quote = quote[~fresh[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for chosen, size in ((short, 2), (long & ~short, 3)):
            q = quote[chosen]
            at[q + 1] = False
            at[np.minimum(q + size, n)] = True

    bounds = np.flatnonzero(at)
    width = 1 + (points >= 0x80).astype("int8") + (points >= 0x800) + (points >= 0x10000)
    offset = np.zeros(n + 1, "int64")
    np.cumsum(width, out=offset[1:])
    tokens = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offset[bounds].copy()), pa.py_buffer(joined.encode())]
    )
    coded = tokens.dictionary_encode()
    per_text = np.searchsorted(bounds, starts)
    return Pretokens(
        coded.dictionary.cast(pa.binary()),
        coded.indices.to_numpy(),
        np.diff(per_text),
        kind[bounds[1:] - 1] if detail else None,
        np.diff(bounds) if detail else None,
    )
