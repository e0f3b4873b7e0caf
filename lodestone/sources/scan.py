"""Scan a directory of source files as a DataFrame, with ignore rules as predicates."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never looked into, at any depth (fixed values).
SKIPPED = (".git", "node_modules", "vendor", "dist", "build")
#: Extensions that a scan takes by default (fixed values; the one without a dot never matches a file's extension).
SUPPORTED = (
    ".go", ".js", ".mjs", ".cjs", ".javascript", ".ts", ".tsx", ".typescript", ".css", ".md", ".markdown", ".txt",
    ".yaml", ".yml", ".toml", ".proto", ".json", ".py", ".python", ".rb", ".ruby",
    ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".cs", ".csharp", ".sh", ".bash",
    ".html", ".htm", ".java", ".rs", ".rust", ".swift", ".php", ".lua", ".kt", ".kotlin", ".scala", ".sc",
    ".groovy", ".grvy", ".gy", ".gvy", ".ex", ".exs", ".elixir", ".elm", ".ml", ".mli", ".ocaml", ".hcl", ".cue",
    "dockerfile", ".svelte", ".sql",
)
#: The extensions of each grammar (fixed values); text has none.
GRAMMARS: dict[str, str] = {
    "go": "go", "javascript": "js javascript mjs cjs", "typescript": "ts typescript", "tsx": "tsx", "css": "css", "markdown": "md markdown",
    "yaml": "yaml yml", "toml": "toml", "protobuf": "proto protobuf", "json": "json", "python": "py python", "ruby": "rb ruby", "c": "c h",
    "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs csharp", "bash": "sh bash", "html": "html htm", "java": "java", "rust": "rs rust", "swift": "swift",
    "php": "php", "lua": "lua", "kotlin": "kt kotlin", "scala": "scala sc", "groovy": "groovy grvy gy gvy", "elixir": "ex exs elixir", "elm": "elm",
    "ocaml": "ml mli ocaml", "hcl": "hcl", "cue": "cue", "dockerfile": "dockerfile", "svelte": "svelte", "sql": "sql",
}
LANGUAGES: dict[str, str] = {ext: grammar for grammar, own in GRAMMARS.items() for ext in own.split()}


def extension(path: Column) -> Column:
    """The last dot and what follows it in a path's last segment, lower case; empty without."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(LANGUAGES.items()), "ext string, language string")


def language_for(ext: Column) -> Column:
    """The grammar of an extension, with or without dot, in any case; null where there is none."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.ltrim(ext, F.lit("."))))


def not_skipped(relative: Column) -> Column:
    return ~relative.rlike(r"(^|/)(" + "|".join(re.escape(x) for x in SKIPPED) + ")/")


def compile_ignore(lines: list[str]) -> list[tuple[bool, str]]:
    """Ignore-file lines as (keeps, regular expression on a relative path), in order."""
    rules = []
    for raw in lines:
        line = raw.rstrip("\r\n")
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[1:] if keeps else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        out, k = [], 0
        while k < len(line):
            if line.startswith("**/", k):
                out.append("(?:.*/)?")
                k += 3
            elif line.startswith("/**", k) and k + 3 == len(line):
                out.append("/.*")
                k += 3
            elif line[k] == "*":
                out.append("[^/]*")
                k += 2 if line.startswith("**", k) else 1
            elif line[k] == "?":
                out.append("[^/]")
                k += 1
            elif line[k] == "[" and "]" in line[k + 2 :]:
                end = line.index("]", k + 2)
                body = line[k + 1 : end]
                out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
                k = end + 1
            else:
                k += line[k] == "\\" and k + 1 < len(line)
                out.append(re.escape(line[k]))
                k += 1
        rules.append((keeps, ("^" if anchored else "(?:^|.*/)") + "".join(out) + ("/.*$" if folder else "(?:/.*)?$")))
    return rules


def ignored(relative: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that matches ignores a path."""
    c = F.lit(False)
    for keeps, pattern in rules:
        c = F.when(relative.rlike(pattern), F.lit(not keeps)).otherwise(c)
    return c


def _listing(spark: SparkSession, root: str, max_size: int, extensions: list[str] | None, use_ignore: bool) -> DataFrame:
    """A root's files that a scan takes; what isn't selected of a file, its content above all, isn't read."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    )
    if max_size > 0:
        found = found.where(F.col("length") <= max_size)  # reaches the scan, which leaves such files unread
    plain = F.regexp_replace("path", "^file:/*", "/")
    out = found.withColumn("absolute", plain).withColumn("relative", F.substring(plain, len(root) + 2, 1 << 20)).where(not_skipped(F.col("relative")))
    ignore = os.path.join(root, ".gitignore")
    if use_ignore and os.path.exists(ignore):
        with open(ignore, encoding="utf-8", errors="replace") as f:
            out = out.where(~ignored(F.col("relative"), compile_ignore(f.readlines())))
    return out if extensions is None else out.where(extension(F.col("relative")).isin([e.lower() for e in extensions]))


def scan(spark: SparkSession, root: str, max_size: int = 0, extensions: list[str] | None = None, use_ignore: bool = True) -> DataFrame:
    """``path, relative, size, mtime`` of a root's files. Only metadata is read."""
    out = _listing(spark, os.path.abspath(root), max_size, extensions, use_ignore)
    return out.select(F.col("absolute").alias("path"), "relative", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def read_files(spark: SparkSession, root: str, max_size: int = 0, extensions: list[str] | None = None, use_ignore: bool = True) -> DataFrame:
    """Scanned files with content and hash, in one scan; unreadable files are left out.

    Folders, extensions and ignore rules are judged on the path before the
    content is decoded, and files above ``max_size`` are not opened.
    """
    return _contents(_listing(spark, os.path.abspath(root), max_size, extensions, use_ignore))


def read_named(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """As ``read_files`` for files given by their whole paths."""
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(paths)
    relative = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(os.path.abspath(root)) + 2, 1 << 20)
    return _contents(found.withColumn("relative", relative))


def _contents(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("relative").alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime"), language_for(extension(F.col("relative"))).alias("language"), F.unix_millis(F.current_timestamp()).alias("indexed_at"),
    )
