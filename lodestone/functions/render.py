"""Search results as Markdown and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_path(uri: Column, root: str = "") -> Column:
    """A result's path: the address without its scheme, below ``root`` where it is relative."""
    path = F.regexp_replace(uri, "^file://", "")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)) if root else path


def markdown(rank: Column, uri: Column, start: Column, end: Column, content: Column | None, root: str = "") -> Column:
    """A numbered heading with path and lines, and the trimmed content in a fence; no lines where both are 0, no fence without content."""
    lines = F.when((start > 0) | (end > 0), F.concat(F.lit(" (L"), start.cast("string"), F.lit("-L"), end.cast("string"), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("### "), rank.cast("string"), F.lit(". "), display_path(uri, root), lines, F.lit("\n\n"))
    if content is None:
        return head
    trimmed = F.regexp_replace(content, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.concat(head, F.when(F.length(content) > 0, F.concat(F.lit("```\n"), trimmed, F.lit("\n```\n\n"))).otherwise(""))


def result_json(uri: Column, score: Column, start: Column, end: Column, terms: Column, content: Column | None = None, root: str = "") -> Column:
    """One result as a JSON object; characters of HTML are not escaped."""
    fields = [uri.alias("uri"), display_path(uri, root).alias("path"), score.alias("score"), start.alias("start_line"), end.alias("end_line")]
    if content is not None:
        fields.append(content.alias("content"))
    return F.to_json(F.struct(*fields, terms.alias("matched_terms")))
