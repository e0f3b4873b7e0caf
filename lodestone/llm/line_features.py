"""Plain features of the lines of many texts at once: lengths, ends, links, separators, function words, repetition.

Everything is counted over the bytes of a block of texts with array
operations; no line is handled by itself. A feature is a small number, the
bucket that a count or a share falls into.

Defined cases: lines end at a line feed, a carriage return or a Unicode line
or paragraph separator; blank lines have no row; null text has no lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.pretokens import DIGIT, LETTER, SPACE, byte_classes, text_blocks

#: Words that hold sentences together, in the languages of the corpus (fixed values).
FUNCTION_WORDS = (
    "the a an of to in on at is are was be been it its this that and or but not no for with from by as if when than so you your we our they their has have will can does did more once how after before"
    " и в на не с по из что это как для при к о от за но или если то его её их мы вы они был была будет уже ещё только после перед каждого без до нет"
    " der die das ein eine und oder nicht ist sind war zu von mit auf für im in den dem des es wir sie er wenn als auch nur noch nach vor bei aus wird werden kann"
    " le la les un une des du de et ou ne pas est sont à au aux en dans pour par sur avec ce cette il elle nous vous si plus après avant qui que chaque"
    " o os as um uma e não é são do da dos das no na em para por com se mais já após que ao à"
).split()
FUNCTION_WORDS += "的了是在和不会被有就都而与或于把到时后请这那个"  # text without spaces has characters for these
#: Upper ends of the buckets of each feature; what is above the last has a bucket of its own.
BUCKETS: dict[str, tuple[float, ...]] = {
    "words": (0.5, 1.5, 2.5, 4.5, 8.5, 16.5),
    "last": (0.5, 1.5, 2.5, 3.5, 4.5),  # sentence end, colon, comma, code sign, letter or digit, other
    "first": (0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5),  # indent, upper case, lower case, digit, heading mark, list mark, other, tag
    "links": (0.0, 0.25, 0.5, 0.75),
    "separators": (0.0, 0.15, 0.4),
    "function": (-0.5, 0.0, 0.15, 0.3),
    "repeated": (-0.5, 0.0, 0.15, 0.3, 0.5),  # content words that their sentence had already
    "insists": (-0.5, 0.5, 1.0, 1.25),  # how often a sentence says the line's most frequent pair of content words
    "again": (-0.5, 0.0, 0.04, 0.12),  # pairs of content words that their sentence had already
    "stops": (0.5, 1.5, 3.5),  # ends of sentences
    "seen": (0.0, 0.5, 0.99),  # content words that the text had already
    "signs": (0.0, 0.03, 0.1),
    "digits": (0.0, 0.1, 0.3),
}
FEATURES = tuple(BUCKETS)
WIDTH = 1 + max(map(len, BUCKETS.values()))

_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"(){}[]=<>_\"`$\\;:'@|&")] = True
_CODE = np.zeros(256, bool)
_CODE[list(b"(){};\"'=`")] = True
_ENDS = np.full(256, 5, np.uint8)
_ENDS[list(b".!?")], _ENDS[list(b":")], _ENDS[list(b",")], _ENDS[list(b"{}();[]=<>\"'`\\|")] = 0, 1, 2, 3
_FIRST = np.full(256, 6, np.uint8)
_FIRST[list(b"-*+>")], _FIRST[list(b"#")] = 5, 4


@dataclass(frozen=True)
class Lines:
    """The lines of a run of texts that aren't blank."""

    first: int  #: number of the run's first text
    texts: int  #: how many texts
    text: np.ndarray  #: the text of each line, counted from ``first``
    words: np.ndarray
    features: np.ndarray  #: a row a line, a column a feature
    data: np.ndarray
    begin: np.ndarray  #: where a line begins in ``data``
    end: np.ndarray


def lines_of(texts: pa.Array) -> Iterator[Lines]:
    for a, b, own, edges in text_blocks(texts):
        yield _lines(a, b - a, own, edges)


def _places(b: np.ndarray, *sequence: int) -> np.ndarray:
    """Where a sequence of bytes begins."""
    at = np.flatnonzero(b[: len(b) - len(sequence) + 1] == sequence[0]) if len(b) >= len(sequence) else np.empty(0, np.int64)
    for k, x in enumerate(sequence[1:], 1):
        at = at[b[at + k] == x]
    return at


def _runs(where: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and end; none goes on where something ``new`` begins."""
    begin, end = where.copy(), where.copy()
    begin[1:] &= ~where[:-1] | new[1:-1]
    end[:-1] &= ~where[1:] | new[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _codes(characters: str) -> np.ndarray:
    """Characters beyond ASCII as ``code`` has them."""
    return np.array([int.from_bytes(x.encode("utf-8")[:3].ljust(3, b"\0"), "big") for x in characters], np.int32)


def _per(of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, weights, n)


def _lines(first: int, texts: int, b: np.ndarray, edges: np.ndarray) -> Lines:
    n = len(b)
    none = np.empty(0, np.int64)
    if not n:
        return Lines(first, texts, none, none, np.empty((0, len(FEATURES)), np.uint8), b, none, none)
    c = byte_classes(b)
    new = np.zeros(n + 1, bool)
    new[edges[:-1]] = True  # of an empty text: where the next begins
    new[n] = True
    text_starts = new.copy()
    new[1:] |= (b == 10) | (b == 13)
    lead = np.flatnonzero(b >= 0xC2)  # characters beyond ASCII, as their first two or three bytes
    code = b[lead].astype(np.int32) << 16 | b[np.minimum(lead + 1, n - 1)].astype(np.int32) << 8
    code |= np.where(b[lead] >= 0xE0, b[np.minimum(lead + 2, n - 1)], 0)
    among = lambda characters: lead[np.isin(code, _codes(characters))]
    new[among("\u2028\u2029") + 3] = True
    black = c != SPACE
    starts = np.flatnonzero(new[:-1])
    of = np.cumsum(new[:-1], dtype=np.int32) - 1  # the line of each byte
    m = len(starts)
    count = lambda where: np.add.reduceat(where, starts, dtype=np.int32)
    solid = count(black)
    # runs without spaces, and by these the ends of the lines that aren't blank
    ts, te = _runs(black, new)
    line_of_run = of[ts]
    edge = np.flatnonzero(np.diff(line_of_run, prepend=-1))
    full, head = line_of_run[edge], ts[edge]
    tail = te[np.append(edge[1:], len(ts)) - 1] - 1 if len(edge) else none
    # words: runs of letters, digits and underscores
    word = (c == LETTER) | (c == DIGIT) | (b == 95)
    split = new.copy()  # text without spaces: each character is half a word
    own = np.flatnonzero((b >= 0xE3) & (b <= 0xE9) & (c == LETTER))
    split[own] = split[own + 3] = True
    ws, we = _runs(word, split)
    wide = (b[ws] >= 0xE3) & (b[ws] <= 0xE9)
    weight = np.where(wide, 0.5, 1.0)
    home = of[ws]
    words = _per(home, m, weight)
    ids, function = _identities(b, ws, we)
    content = ~function
    marks = np.zeros(n + 1, bool)
    stops = np.flatnonzero((b == 46) | (b == 33) | (b == 63))
    stops = stops[new[stops + 1] | (c[np.minimum(stops + 1, n - 1)] == SPACE)]
    for at in (stops + 1, among("。！？") + 3, starts):
        marks[at] = 1
    sentence = np.cumsum(marks, dtype=np.int32)[ws].astype(np.int64)
    repeated = _per(home[content], m, ~_firsts(sentence[content], ids[content]))
    (insists, again), stopped = _insists(home[content], ids[content], sentence[content], m), _per(of[stops], m) + _per(of[among("。！？")], m)
    page = np.cumsum(text_starts[:-1], dtype=np.int32)[ws]
    seen = _per(home[content], m, ~_firsts(page[content], ids[content]))
    contents = _per(home[content], m)
    particles = _per(home[function], m)
    # links: runs without spaces that hold an address
    run = lambda at: _per(np.searchsorted(ts, at, side="right") - 1, len(ts)) > 0
    dots = np.flatnonzero(b[1:-1] == 46) + 1 if n > 2 else none
    dots = dots[(c[dots - 1] != SPACE) & (c[dots - 1] != 0) & (c[dots + 1] == LETTER)]
    address = run(_places(b, 58, 47, 47)) | run(_places(b, 119, 119, 119, 46)) | run(_places(b, 93, 40))
    address |= run(dots) & run(np.flatnonzero(b == 47)) & ~run(np.flatnonzero(_CODE[b]))
    linked = _per(line_of_run, m, (te - ts) * address)
    # separators
    seps = [np.flatnonzero((b == 44) | (b == 124) | (b == 59)), among("•·、，")]
    lone = np.flatnonzero((b == 45) | (b == 47) | (b == 35))
    lone = lone[(lone > 0) & (lone < n - 1)]
    seps.append(lone[(b[lone - 1] == 32) & ((b[lone + 1] == 32) | (b[lone] == 35))])
    separators = sum(_per(of[at], m) for at in seps)
    signs, digits = count(_SIGNS[b]), count(c == DIGIT)
    # first and last characters
    last = _ENDS[b[tail]]
    last[np.isin(c[tail], (LETTER, DIGIT))] = 4
    last[np.isin(tail - 2, among("。！？…"))] = 0
    opening = _FIRST[b[head]]
    opening[c[head] == LETTER] = 1
    opening[(b[head] >= 97) & (b[head] <= 122)] = 2
    opening[c[head] == DIGIT] = 3
    opening[(b[head] == 35) & (c[np.minimum(head + 1, n - 1)] == LETTER)] = 7
    opening[head > starts[full]] = 0
    w = words[full]
    share = lambda x, y: x[full] / np.maximum(y[full], 1)
    columns = {
        "words": w, "last": last, "first": opening, "links": share(linked, solid), "separators": share(separators, words),
        "function": np.where(w < 4, -1.0, share(particles, words)), "repeated": np.where(contents[full] < 6, -1.0, share(repeated, contents)),
        "insists": np.where(contents[full] < 6, -1.0, insists[full]), "again": np.where(contents[full] < 6, -1.0, again[full]), "stops": stopped[full], "seen": share(seen, contents), "signs": share(signs, solid), "digits": share(digits, solid),
    }
    features = np.stack([np.searchsorted(BUCKETS[f], columns[f], side="left").astype(np.uint8) for f in FEATURES], axis=1)
    begin, stop = starts[full], np.append(starts[1:], n)[full]
    text = np.searchsorted(edges, begin, side="right") - 1
    return Lines(first, texts, text, np.maximum(w, 1), features, b, begin, stop)


def _firsts(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each word is the first of its kind in its group."""
    out = np.zeros(len(ids), bool)
    if len(ids):
        out[np.unique(group.astype(np.int64) * (int(ids.max()) + 1) + ids, return_index=True)[1]] = True
    return out


def _insists(line: np.ndarray, ids: np.ndarray, sentence: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line, occurrences of its most frequent pair of neighbouring words over its sentences (0 below three), and the share of pairs that are repeated within their sentence."""
    most, again = np.zeros(lines), np.zeros(lines)
    if len(ids) < 2:
        return most, again
    same = np.flatnonzero(line[1:] == line[:-1])
    _, pair = np.unique(ids[same] * (int(ids.max()) + 1) + ids[same + 1], return_inverse=True)
    kinds = int(pair.max(initial=0)) + 1
    keys, times = np.unique(line[same] * kinds + pair, return_counts=True)
    np.maximum.at(most, keys // kinds, times)
    sentences = _per(line[np.flatnonzero(np.diff(sentence, prepend=-1))], lines)
    within = same[sentence[same] == sentence[same + 1]]
    repeats = ~_firsts(sentence[within], pair[np.searchsorted(same, within)])
    again = _per(line[within], lines, repeats) / np.maximum(_per(line[within], lines), 1)
    return np.where(most >= 3, most / np.maximum(sentences, 1), 0.0), again


def _identities(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the same for the same word in any case, and whether it is a function word."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, bool)
    offsets = np.empty(2 * len(start), np.int32)
    offsets[0::2], offsets[1::2] = start, end
    parts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(b))
    coded = parts.take(pa.array(np.arange(0, len(offsets), 2))).dictionary_encode()
    low = pc.utf8_lower(coded.dictionary).dictionary_encode()
    known = np.asarray(pc.is_in(low.dictionary, value_set=pa.array(FUNCTION_WORDS)))
    ids = np.asarray(low.indices).astype(np.int64)[np.asarray(coded.indices)]
    return ids, known[ids]
