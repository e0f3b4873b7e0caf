"""Pack lines into chunks of bounded size, natively: a fold over the lines of each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 1000
_PIECE = "struct<content:string,type:string,start_line:int,end_line:int>"


def _piece(content: Column, kind: Column | str, start: Column, end: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(content.alias("content"), kind.alias("type"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def chunk_lines(text: Column, size: int = DEFAULT_SIZE) -> Column:
    """``array<struct<content, type, start_line, end_line>>`` of a text.

    Sizes are bytes; no line is cut, so a longer one stands alone; blank lines
    before a chunk's first text are dropped, their numbers are not. Null and
    empty text has no chunks.
    """
    size = size if size > 0 else DEFAULT_SIZE
    lines = F.split(text, "\n", -1)
    none = F.array().cast(f"array<{_PIECE}>")

    def step(s: Column, line: Column) -> Column:
        n = s["n"] + 1
        joined = F.when(s["buf"] == "", line).otherwise(F.concat(s["buf"], F.lit("\n"), line))
        full = (F.octet_length(joined) > size) & (s["buf"] != "")
        alone = full & (F.octet_length(line) > size)
        done = F.array(_piece(s["buf"], "text", s["start"], n - 1))
        out = F.when(alone, F.concat(s["out"], done, F.array(_piece(line, "text", n, n)))).when(full, F.concat(s["out"], done)).otherwise(s["out"])
        return F.struct(
            F.when(alone, F.lit("")).when(full, line).otherwise(joined).alias("buf"),
            F.when(alone, n + 1).when(full, n).otherwise(s["start"]).alias("start"),
            n.alias("n"),
            out.alias("out"),
        )

    first = F.struct(F.lit("").alias("buf"), F.lit(1).alias("start"), F.lit(0).alias("n"), none.alias("out"))
    last = lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(_piece(s["buf"], "text", s["start"], s["n"]))))
    return F.when(F.length(text) > 0, F.aggregate(lines, first, step, last)).otherwise(none)


def merge_small(chunks: Column, size: int = DEFAULT_SIZE) -> Column:
    """Join neighbours that touch and together fit; the first one's type stays."""
    none = F.slice(chunks, 1, 0)

    def step(out: Column, nxt: Column) -> Column:
        cur = F.element_at(out, -1)
        fits = (F.octet_length(cur["content"]) + 1 + F.octet_length(nxt["content"]) <= size) & (cur["end_line"] + 1 >= nxt["start_line"])
        joined = _piece(F.concat(cur["content"], F.lit("\n"), nxt["content"]), cur["type"], cur["start_line"], nxt["end_line"])
        return F.when((F.size(out) > 0) & F.coalesce(fits, F.lit(False)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(nxt)))

    return F.aggregate(chunks, none, step)


def explode_chunks(docs: DataFrame, key: str, chunks: Column) -> DataFrame:
    """``key, ordinal, content, type, start_line, end_line``, a row a chunk."""
    return docs.select(key, F.posexplode(chunks).alias("ordinal", "c")).select(key, "ordinal", "c.content", "c.type", "c.start_line", "c.end_line")
