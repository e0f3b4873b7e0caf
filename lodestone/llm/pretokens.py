"""Cut texts into the pre-tokens of a byte-level BPE, a whole batch at once.

The pattern is the public one: contractions, then letters, digits or other
characters each with at most one space before, then white space of which the
last character is left to what follows. Its matches depend on nothing but the
classes of neighbouring characters, so the places where they begin follow from
a few comparisons over all bytes of a batch, and the pre-tokens are slices of
the batch's own buffer. ``tests/llm/test_encode_pack.py`` holds this against
the pattern itself.

Defined cases: null text has no pre-tokens, like empty text; texts never run
into each other; classes are those of Python's ``unicodedata``.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, DIGIT, SPACE = range(4)
#: White space beyond ASCII as Unicode has it (fixed values).
_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Bytes of text that are cut at once; a longer text stands alone.
BLOCK_BYTES = 8 << 20


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": DIGIT}
    own = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    own[[*range(9, 14), 32, *_SPACES]] = SPACE
    return own


def byte_classes(b: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    own = np.zeros(256, np.uint8)
    own[:128] = classes()[:128]
    c = own[b]
    lead = np.flatnonzero(b >= 0xC0)
    if lead.size:
        first = b[lead]
        for low, high, size, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
            at = lead[(first >= low) & (first < high)]
            if at.size:
                point = b[at].astype(np.int32) & mask
                for k in range(1, size):
                    point = point << 6 | (b[at + k] & 0x3F)
                kind = classes()[point]
                for k in range(size):
                    c[at + k] = kind
    return c


def begins(b: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the bytes of texts; ``texts`` are the places where texts that aren't empty begin."""
    n = len(b)
    if not n:
        return np.empty(0, np.int64)
    c = byte_classes(b)
    new = np.zeros(n + 1, bool)  # a text begins here, or the bytes end
    new[texts] = True
    new[n] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(c[1:], c[:-1], out=start[1:])
    start |= new[:-1]
    runs = np.flatnonzero(start)
    fresh = new[runs]
    black = c[runs] != SPACE
    # contractions: a lone apostrophe that no space belongs to, and letters
    quote = runs[b[runs] == 0x27]
    quote = quote[~new[quote + 1]]
    quote = quote[(c[quote + 1] == LETTER) & (new[quote] | (b[quote - 1] != 0x20))]
    # white space before anything else leaves its last character to what follows
    after = runs[black & ~fresh]
    after = after[c[after - 1] == SPACE]
    start[after[b[after - 1] == 0x20]] = False
    last = after - 1
    while (inside := (b[last] & 0xC0) == 0x80).any():
        last = last - inside
    start[last] = True
    if quote.size:
        one = b[quote + 1]
        two = np.where(new[quote + 2], 0, b[np.minimum(quote + 2, n - 1)])
        size = np.isin(one, list(b"stmd")).astype(np.int64)
        size[((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)] = 2
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        rest = rest[~new[rest]]
        start[rest[c[rest] == LETTER]] = True
    return np.flatnonzero(start)


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of bounded size: first and end row, their bytes, and where in these each text begins and the last ends."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind).astype(np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, side="right")) - 1)
        yield a, b, whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """Runs of texts of bounded size: first and end row, pre-tokens a text, and all pre-tokens in order."""
    for a, b, own, edges in text_blocks(texts):
        at = begins(own, edges[:-1][np.diff(edges) > 0])
        counts = np.diff(np.searchsorted(at, edges))
        places = pa.py_buffer(np.append(at, len(own)).astype(np.int32))
        yield a, b, counts, pa.StringArray.from_buffers(len(at), places, pa.py_buffer(own))
