"""Cut items above a size limit into pieces at natural boundaries.

Lexical cohesion decides where: the words of the lines before and after each
gap are held against each other (cosine of hashed counts over a sliding
block), and a valley of similarity marks a change of topic. Each piece grows
to a window that the limit sets and ends at the deepest valley in it, blank
lines and outdents counting in its favour. The next piece begins with the
last lines of the piece before.

Defined cases: null or empty content, and content within the limit, gives no
rows; a line that alone is above the limit is cut inside, at white space or a
sign if there is one, else between characters, and its pieces carry its number
in ``over_line`` and repeat nothing; a limit without a row uses the row
``default``; without that the item is left out; repeated items give repeated
rows; a piece's content ends before its last line's ``\\n``; the empty line
after a final ``\\n`` is no line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines on either side of a gap whose words are compared, and hash buckets of their counts.
BLOCK, BUCKETS = 6, 64
#: A piece takes at least this share of its limit before it may end.
LEAST_FILL = 0.5
#: Rows of the table of limits up to which it's broadcast.
MOST_LIMITS = 10_000

_WORD = re.compile(r"[^\W\d_]{2,}")
_BREAKS = re.compile(r"[\s,;:.)\]}>|&]")
_codes: dict[str, int] = {}


def _code(word: str) -> int:
    got = _codes.get(word)
    if got is None:
        if len(_codes) > 500_000:
            _codes.clear()
        got = _codes[word] = crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    return got


def depths(lines: list[str]) -> np.ndarray:
    """How good a boundary the gap before each line is; the first is 0."""
    n = len(lines)
    rows, cols = [], []
    for i, line in enumerate(lines):
        for w in _WORD.findall(line):
            rows.append(i + 1)
            cols.append(_code(w))
    counts = np.bincount(np.array(rows, dtype=np.int64) * BUCKETS + np.array(cols, dtype=np.int64), minlength=(n + 1) * BUCKETS).reshape(n + 1, BUCKETS) if rows else np.zeros((n + 1, BUCKETS))
    total = np.cumsum(counts, axis=0, dtype=np.float32)
    at = np.arange(n)
    before = total[at] - total[np.maximum(at - BLOCK, 0)]
    after = total[np.minimum(at + BLOCK, n)] - total[at]
    norm = np.sqrt((before * before).sum(1) * (after * after).sum(1))
    likeness = np.where(norm > 0, (before * after).sum(1) / np.maximum(norm, 1e-9), 0.0)
    # depth: how far the likeness falls from the peaks within a block on both sides
    pad = np.concatenate([np.full(BLOCK, -1.0), likeness, np.full(BLOCK, -1.0)])
    around = np.lib.stride_tricks.sliding_window_view(pad, BLOCK + 1)
    depth = around[:n].max(1) + around[BLOCK : BLOCK + n].max(1) - 2 * likeness
    blank = np.array([not x.strip() for x in lines])
    indent = np.array([len(x) - len(x.lstrip()) for x in lines])
    natural = np.zeros(n)
    natural[1:] = 1.0 * (blank[:-1] & ~blank[1:]) + 0.5 * (indent[1:] == 0) - 0.75 * np.array([bool(x) and x[0] in "})]" for x in (y.lstrip() for y in lines[1:])])
    natural[blank] -= 0.5
    score = depth + natural
    score[0] = 0.0
    return score


def cut_line(line: str, limit: int) -> list[str]:
    """An over-long line in parts of at most ``limit`` bytes, at least a character each."""
    parts, at = [], 0
    while at < len(line):
        end = min(len(line), at + limit)
        while end > at + 1 and len(line[at:end].encode("utf-8", "surrogatepass")) > limit:
            over = len(line[at:end].encode("utf-8", "surrogatepass")) - limit
            end = max(at + 1, end - max(1, over // 4))
        if end < len(line):
            stop = [m.end() for m in _BREAKS.finditer(line, at + (end - at) // 2, end)]
            end = stop[-1] if stop else end
        parts.append(line[at:end])
        at = end
    return parts


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """``start_line, end_line, over_line, content`` of the pieces of a text."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    if not lines:
        return []
    sizes = [len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in lines]
    ends = np.cumsum(np.array(sizes, dtype=np.int64) + 1)  # bytes up to and with each line's break
    score = depths(lines)
    pieces: list[tuple[int, int, int, str]] = []
    at, n = 0, len(lines)
    while at < n:
        if sizes[at] > limit:
            pieces += [(at + 1, at + 1, at + 1, part) for part in cut_line(lines[at], limit)]
            at += 1
            continue
        first = at
        if pieces and not pieces[-1][2]:
            room = limit - sizes[at] - 1
            least = max(pieces[-1][0] - 1, at - overlap)
            while first > least and room >= sizes[first - 1]:
                first -= 1
                room -= sizes[first] + 1
        base = int(ends[first - 1]) if first else 0
        # the last line that still fits: its bytes without the final break
        stop = int(np.searchsorted(ends, base + limit + 1, side="right"))
        if stop < n:
            low = int(np.searchsorted(ends, base + int(limit * LEAST_FILL), side="right")) + 1
            low = min(max(low, at + 1), stop)
            window = score[low : stop + 1]
            stop = low + int(len(window) - 1 - np.argmax(window[::-1]))
        pieces.append((first + 1, stop, 0, "\n".join(lines[first:stop])))
        at = stop
    return pieces


def split_items(items: DataFrame, limits: DataFrame, key: str = "file_id", text: str = "content", language: str = "language", contents: bool = True) -> DataFrame:
    """``key, piece, start_line, end_line, over_line[, content]`` of items above their limit."""
    own = limits.select(F.col("language").alias("l"), F.col("max_bytes").alias("most"), F.col("overlap_lines").alias("overlap")).where(F.col("l").isNotNull())
    if own.limit(MOST_LIMITS + 1).count() <= MOST_LIMITS:
        own = F.broadcast(own)
    kind = items.schema[key].dataType.simpleString()
    base = items.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"), F.lower(F.col(language)).alias("l"))
    rest = F.broadcast(limits.where(F.col("language") == "default").select(F.col("max_bytes").alias("most0"), F.col("overlap_lines").alias("overlap0")).limit(1))
    sized = (
        base.join(own, "l", "left")
        .join(rest, F.lit(True), "left")
        .select("key", "text", F.coalesce("most", "most0").alias("most"), F.when(F.col("most").isNotNull(), F.col("overlap")).otherwise(F.col("overlap0")).alias("overlap"))
        .where(F.octet_length("text") > F.col("most"))
        .select("key", "text", F.greatest("most", F.lit(4)).alias("most"), F.coalesce("overlap", F.lit(0)).alias("overlap"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            most, overlap = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, value in enumerate(batch.column(1).to_pylist()):
                own = split_text(value, most[i], overlap[i])
                at += [i] * len(own)
                rows += [(k, *p) for k, p in enumerate(own)]
            cols = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], pa.int32()) for k in range(4))]
            names = ["key", "piece", "start_line", "end_line", "over_line"]
            if contents:
                cols, names = [*cols, pa.array([r[4] for r in rows], pa.string())], [*names, "content"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"key {kind}, piece int, start_line int, end_line int, over_line int" + ", content string" * contents
    return sized.mapInArrow(run, schema).withColumnRenamed("key", key)


def oversized_lines(pieces: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, line_no``: each item's lines that alone are above the limit, or 0 if it has none."""
    return (
        pieces.groupBy(key)
        .agg(F.collect_set(F.when(F.col("over_line") > 0, F.col("over_line"))).alias("own"))
        .select(key, F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.array(F.lit(0)))).alias("line_no"))
    )
