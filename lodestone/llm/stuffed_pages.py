"""Flag pages of repeated keywords, bare links or tags.

A hidden Markov model labels the lines of a page as prose, links, tags, menu,
pitch or technical text from plain features (``line_features``): length, first and
last character, share of links, separators, function words, repetition. Its
probabilities are counts over a bounded sample of pages whose lines are
labelled by rules (``observe``); over all pages only the model decides. A page
is flagged if more than half of its words stand in links, tags, menus and pitches.

Defined cases: null, empty and blank text is not flagged; repeated rows give a
result each (queries drop them); columns besides key and text are ignored; a
line of any length has one label; without any page to fit on, nothing is
flagged.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.line_features import FEATURES, WIDTH, Lines, lines_of

SHARE = 0.5
#: Pages that the model is fitted on at most (documented bound; the least by hash of their key).
SAMPLE_ROWS = 4000
#: Weight of the features: they overlap, so each counts less than it would alone. Added to every count.
TEMPER, SMOOTH = 0.5, 0.5
PROSE, LINKS, TAGS, MENU, TECH, PITCH = range(6)
STATES = ("prose", "links", "tags", "menu", "technical", "pitch")  # a pitch insists on keywords in sentences
#: Such pages are few: a reading of the whole text in these states alone must be less likely by this (log probability).
ORDINARY, MARGIN = (PROSE, TECH), 2.5
#: What the rules see in a line of the sample.
SYMBOLS = ("sentence", "heading", "short", "link", "anchor", "described", "phrases", "tags", "offer", "stuffed", "technical")
_CODE = {s: i for i, s in enumerate(SYMBOLS)}
#: Probability of each of these in each state, for labelling the sample (rows: what is seen; columns: the first five STATES).
EMISSION = (
    (0.560, 0.010, 0.010, 0.010, 0.060),  # sentence
    (0.150, 0.050, 0.050, 0.060, 0.050),  # heading
    (0.100, 0.160, 0.060, 0.380, 0.050),  # short
    (0.015, 0.400, 0.010, 0.020, 0.010),  # link
    (0.005, 0.330, 0.010, 0.020, 0.010),  # anchor
    (0.100, 0.005, 0.005, 0.005, 0.070),  # described
    (0.010, 0.010, 0.250, 0.300, 0.010),  # phrases
    (0.010, 0.010, 0.350, 0.050, 0.010),  # tags
    (0.010, 0.010, 0.150, 0.070, 0.010),  # offer
    (0.010, 0.010, 0.100, 0.080, 0.010),  # stuffed
    (0.030, 0.005, 0.005, 0.005, 0.710),  # technical
)
START = (0.50, 0.10, 0.10, 0.10, 0.20)
STAY = 0.86

_URL = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>\"')\]]+|\b[a-z0-9][a-z0-9\-]*(?:\.[a-z0-9\-]+)*\.(?:com|net|org|io|ru|de|fr|br|cn|info|biz|test|example|invalid|shop|blog)(?:/[^\s<>\"')\]]*)?(?![\w.])", re.I)
_LINKISH = re.compile(r"\w\.\w|\]\(|<a\s", re.I)
_LINK_MARKUP = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)|<a\s[^>]*>.*?</a>", re.I)
_TECH = re.compile(
    r"^\s*(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|\||[-=+|:\s]{4,}$|```|\$ |>>> |#!|//|/\*|\*/|--?[\w\-]+\s{2,}|-{1,2}[\w\-]+(?:[ =]<?[\w\-]+>?)?\s{2,}|usage:"
    r"|import\s+[\w.\"'({]|from\s+[\w.]+\s+import|package\s+\w|func\s|def\s|class\s|return\b|if\s*\(|for\s*\(|for\s+\w+\s+in\s|const\s|let\s|var\s|public\s|private\s|static\s|export\s|async\s|select\s.+\sfrom\s|create\s+table|insert\s+into|#include|#define|set -e|@\w+|\}|\{|\)|\]|<!|</?\w+>)",
    re.I,
)
_TECH_IN = re.compile(r"[;{}]\s*$|^\s*[\"'][^\"']*[\"']\s*[:,]|[\"'],\s*[\"']|:=|=>|->|\w\(\w*[\w, \"']*\)\s*[;{:]?\s*$|^\s*[\w.\[\]]+\s*[+\-*/]?=\s*\S|^\s{2,}[\w\-]+:\s|[\"']\s*,?\s*$")
_CHANGE = re.compile(r"^\s*(?:[-*+]\s+)?(?:v?\d+\.\d+[\w.\-]*\b|\[?unreleased|(?:add(?:ed)?|fix(?:ed|es)?|remov(?:ed?|es)|chang(?:ed?|es)|deprecat\w+|updat\w+|bump\w*|refactor\w*|security|breaking)\b[:(\s])", re.I)
_TOC = re.compile(r"\]\(#|^\s*\d+\.\s+\[")
_SEPS = re.compile(r"\s*[•|·;»►★✓]\s*|\s*,\s*|\s+[/\-–—~]\s+|、|;|,")
_END = re.compile(r"[.!?。!?…:][\"'”’)\]*_`]*\s*$")
_OFFER = re.compile(r"\b\d{1,4}[.,]\d\d\b.{0,40}(?:in stock|new|tags?|sale|free|shipping|offer|%|:)|[€$£]\s?\d|\d\s?[€$£]", re.I)
_TAG_HEAD = re.compile(r"^\s*(?:\W{0,3})(?:tags?|keywords?|labels?|related|categories|topics|метки|теги|ключевые слова|schlagw\w+|mots[ -]cl\w+|palavras[ -]chave|etiquetas|标签|关键词)\W{0,4}\s*[::]", re.I)
_WORD = re.compile(r"[぀-ヿ㐀-鿿]{1,2}|[^\W_]+(?:['’\-_][^\W_]+)*")
_HASHTAG = re.compile(r"(?<!\S)#\w[\w\-]*")
_SENTENCES = re.compile(r"(?<=[.!?。])\s*")
_BREAK = re.compile(r"\r\n|[\n\r\u2028\u2029]")
_SPACE = re.compile(r"[\s\u00a0\u200b\ufeff]+")


def words(line: str) -> list[str]:
    return _WORD.findall(line)


def observe(line: str) -> tuple[int, int] | None:
    """A line's observation and its number of words; None for a blank line."""
    flat = " ".join(line.split()) if line.isascii() else _SPACE.sub(" ", line).strip()
    if not flat:
        return None
    own = words(flat)
    n = max(1, len(own))
    if flat[0] == "\ufeff":
        flat = flat[1:].strip() or "-"
    if flat[0] == "#" and flat[1:2] in ("#", " "):
        return _CODE["heading"], n
    ended = flat[-1] in ".!?。!?…:" or bool(_END.search(flat))
    linked = _LINKISH.search(flat) and (_LINK_MARKUP.search(flat) or _URL.search(flat))
    if not linked and ended and flat[0].isalpha() and flat.count(",") + flat.count(";") < 3 and line[0] == flat[0] and n >= 4 and not _TECH.match(flat):
        if n >= 16 and _repeats(own) >= 0.3 and _insists(flat):
            return _CODE["stuffed"], n
        return _CODE["sentence"], n
    if _TECH.match(line) or _TECH.match(flat) or _TOC.search(flat):
        if not (flat.startswith("|") and flat.count("|") > 3 and not flat.endswith("|")) and not flat.lower().startswith("<a "):
            return _CODE["technical"], n
    if n >= 5 and (_TAG_HEAD.match(flat) or flat.count("#") >= 4 and len(_HASHTAG.findall(flat)) >= 0.7 * len(flat.split(" "))):
        return _CODE["tags"], n
    if linked:
        rest = words(_URL.sub(" ", _LINK_MARKUP.sub(" ", flat)))
        if len(rest) >= 6 and (_END.search(_URL.sub("", flat).strip()) or len(rest) >= 10):
            return _CODE["described" if flat[0] in "-*+[<" or flat[0].isdigit() else "sentence"], n
        if _TECH_IN.search(line) and not _LINK_MARKUP.search(flat) and rest:
            return _CODE["technical"], n
        return _CODE["link" if not rest and not _LINK_MARKUP.search(flat) else "anchor"], max(n, 3)
    if not ended and _OFFER.search(flat):
        return _CODE["offer"], n
    if n >= 4:
        parts = [p for p in _SEPS.split(flat) if p]
        if len(parts) >= 4 and n / len(parts) <= 4.5 and not (ended and flat.count(",") + flat.count("、") < len(parts) - 1 and re.search(r"[.!?。]\s", flat)):
            short = sum(len(words(p)) <= 4 for p in parts)
            if short >= 0.8 * len(parts) and not _TECH_IN.search(flat):
                return _CODE["phrases"], n
    if n >= 2 and _CHANGE.match(flat):
        return _CODE["technical"], n
    if n >= 16 and _repeats(own) >= 0.25 and (not ended or _insists(flat)):
        return _CODE["stuffed"], n
    if not ended and _TECH_IN.search(line):
        return _CODE["technical"], n
    if ended or n >= 9:
        return _CODE["sentence"], n
    return _CODE["short"], n


def _repeats(own: list[str]) -> float:
    """Share of word pairs that a line has said before."""
    low = [w.lower() for w in own]
    pairs = list(zip(low, low[1:]))
    return 1 - len(set(pairs)) / len(pairs)


def _insists(flat: str) -> bool:
    """Whether a line repeats word pairs beyond saying one sentence again with other nouns."""
    kept: list[list[str]] = []
    for part in _SENTENCES.split(flat):
        own = [w.lower() for w in words(part)]
        if own and not any(_same_form(k, own) for k in kept):
            kept.append(own)
    low = [w for k in kept for w in k]
    pairs = Counter(zip(low, low[1:]))
    total = pairs.total()
    if total < 8:
        return False
    again = 1 - len(pairs) / total
    if again >= 0.15 and max(pairs.values()) >= 3:
        return True
    top = max(Counter(w for w in low if len(w) >= 5).values(), default=0)
    return (again >= 0.1 or top >= 3 and len(low) <= 60) and _repeats(words(flat)) >= 0.5


def _same_form(a: list[str], b: list[str]) -> bool:
    if abs(len(a) - len(b)) > 1 or len(b) < 2:
        return False
    same = sum(x == y for x, y in zip(a, b))
    if len(a) != len(b):
        same += sum(x == y for x, y in zip(reversed(a), reversed(b)))
    return same >= 0.5 * len(b)


_LOG_E = [[math.log(p) for p in row] for row in EMISSION]
_LOG_STAY, _LOG_MOVE = math.log(STAY), math.log((1 - STAY) / (len(START) - 1))


def weight(n: int) -> int:
    """How many observations a line of ``n`` words counts as."""
    return 1 + min(5, n // 12)


@functools.lru_cache(maxsize=50_000)
def viterbi(seen: tuple[tuple[int, int], ...]) -> tuple[int, ...]:
    """The likeliest states of a sequence of ``(observation, weight)``."""
    o, w = seen[0]
    score = [math.log(p) + w * e for p, e in zip(START, _LOG_E[o])]
    back = []
    for o, w in seen[1:]:
        best = max(range(5), key=score.__getitem__)
        move = score[best] + _LOG_MOVE
        came, nxt = [], []
        for s, e in enumerate(_LOG_E[o]):
            stay = score[s] + _LOG_STAY
            came.append(s if stay >= move else best)
            nxt.append(max(stay, move) + w * e)
        back.append(came)
        score = nxt
    state = max(range(5), key=score.__getitem__)
    path = [state]
    for came in reversed(back):
        path.append(state := came[path[-1]])
    return tuple(reversed(path))


def labelled(lines: list[str]) -> list[int]:
    """States of the lines of one page of the sample, by the rules."""
    seen = [observe(x) or (_CODE["short"], 1) for x in lines]
    if not seen:
        return []
    states = viterbi(tuple((o, weight(n)) for o, n in seen))
    return [PITCH if o == _CODE["stuffed"] and s in (TAGS, MENU) else s for (o, _), s in zip(seen, states)]


@dataclass(frozen=True)
class Model:
    """Log probabilities: of the first line's state, of the next state, and of each feature's value in each state."""

    start: np.ndarray  #: STATES
    move: np.ndarray  #: STATES x STATES, from and to
    emit: np.ndarray  #: FEATURES x WIDTH x STATES

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        log = lambda x, axis: np.log((x + SMOOTH) / (x + SMOOTH).sum(axis, keepdims=True))
        return cls(log(start, 0), log(move, 1), log(emit, 1))

    def states(self, lines: Lines) -> np.ndarray:
        """The likeliest state of each line."""
        return self._best(lines, range(len(STATES)))[0]

    def _best(self, lines: Lines, among: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest states and each text's log probability: all texts step through their lines together."""
        among = list(among)
        counts = np.bincount(lines.text, minlength=lines.texts)
        order = np.argsort(-counts, kind="stable")
        order = order[: np.count_nonzero(counts)]
        total, out = np.zeros(lines.texts), np.empty(len(lines.text), np.uint8)
        if not len(order):
            return out, total
        first, sizes = (np.cumsum(counts) - counts)[order], counts[order]
        own = sum(self.emit[f][:, among][lines.features[:, f]] for f in range(len(FEATURES)))
        own = own * (TEMPER * (1 + np.minimum(5, lines.words // 12)))[:, None]  # long lines weigh more
        move = self.move[np.ix_(among, among)]
        back = np.zeros((len(own), len(among)), np.uint8)
        score = self.start[among] + own[first]
        last = score.copy()
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # texts of at least so many lines
        for t in range(1, sizes[0]):
            k = active[t]
            ways = score[:k, :, None] + move
            back[first[:k] + t] = best = ways.argmax(1)
            score = np.take_along_axis(ways, best[:, None, :], 1)[:, 0] + own[first[:k] + t]
            last[:k] = score
        total[order] = last.max(1)
        state = last.argmax(1)
        names = np.array(among, np.uint8)
        for t in range(sizes[0] - 1, -1, -1):
            k = active[t]
            out[first[:k] + t] = names[state[:k]]
            if t:
                state[:k] = back[first[:k] + t, state[:k]]
        return out, total

    def shares(self, lines: Lines) -> np.ndarray:
        """Per text, the share of its words in lines labelled links, tags, menu or pitch; 0 where an ordinary reading is nearly as likely."""
        state, score = self._best(lines, range(len(STATES)))
        ordinary = self._best(lines, ORDINARY)[1]
        aside = ~np.isin(state, ORDINARY)
        total = np.bincount(lines.text, lines.words, lines.texts)
        share = np.bincount(lines.text, lines.words * aside, lines.texts) / np.maximum(total, 1)
        return np.where(score - ordinary > MARGIN, share, 0.0)


_SHAPES = ((len(STATES),), (len(STATES), len(STATES)), (len(FEATURES), WIDTH, len(STATES)))


def count_lines(texts: pa.Array) -> list[np.ndarray]:
    """First states, moves and values by state, counted over texts whose lines the rules label."""
    start, move, emit = (np.zeros(s) for s in _SHAPES)
    for lines in lines_of(texts):
        own = [bytes(lines.data[a:b]).decode("utf-8", "replace").rstrip("\r\n\u2028\u2029") for a, b in zip(lines.begin, lines.end)]
        cuts = np.flatnonzero(np.diff(lines.text, prepend=-1, append=-2)) if len(lines.text) else []
        state = np.array([s for a, b in zip(cuts, cuts[1:]) for s in labelled(own[a:b])], np.int64)
        if not len(state):
            continue
        np.add.at(start, state[cuts[:-1]], 1)
        same = np.flatnonzero(np.diff(lines.text) == 0)
        np.add.at(move, (state[same], state[same + 1]), 1)
        for f in range(len(FEATURES)):
            np.add.at(emit[f], (lines.features[:, f], state), 1)
    return [start, move, emit]


def fit_on(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on the SAMPLE_ROWS pages with the least key hashes; what reaches the driver is a number for each probability."""
    h = F.xxhash64(key)
    least = docs.select(h.alias("h")).orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(map(math.prod, _SHAPES))
        counts = np.zeros(total)
        for batch in batches:
            counts += np.concatenate([x.reshape(-1) for x in count_lines(batch.column(0))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total)), pa.array(counts)], names=["at", "n"])

    flat = np.zeros(sum(map(math.prod, _SHAPES)))
    if least is not None:
        rows = docs.where((h <= least) & (F.length(F.trim(text)) > 0)).select(text)
        table = rows.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        flat[np.asarray(table["at"])] = np.asarray(table["n"])
    parts = np.split(flat, np.cumsum([math.prod(s) for s in _SHAPES])[:-1])
    return Model.of_counts(*(p.reshape(s) for p, s in zip(parts, _SHAPES)))


def find_stuffed(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``key, share`` of the pages with more than ``share`` of their words outside prose."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in lines_of(batch.column(1)):
                got = shared.value.shares(lines)
                at = np.flatnonzero(got > share)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lines.first, lines.texts).take(pa.array(at)), pa.array(got[at])], names=["key", "share"])

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.where(F.length(F.trim(text)) > 0)
        .select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(run, f"key {kind}, share double")
        .withColumnRenamed("key", key)
    )
