"""Chunks that follow a file's structure: functions, classes, headings, top-level entries.

No tree parser is at hand, so each language family has an outline function that
gives the line spans of its units; a file whose outline fails or is empty falls
back on line packing. Long units are packed by lines and small neighbours are
joined, with the native folds.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.chunking import DEFAULT_SIZE, chunk_lines, merge_small
from lodestone.sources.scan import LANGUAGES

Unit = tuple[str, int, int]  # kind of node, first and last line


def _python(text: str) -> list[Unit]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    kinds = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}
    return [(kinds[type(n)], n.lineno, n.end_lineno) for n in tree.body if type(n) in kinds]


def _mask(text: str, line_comment: str = "//") -> str:
    """Strings and comments blanked, line breaks kept."""
    pattern = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|/\*[\s\S]*?\*/|" + re.escape(line_comment) + r"[^\n]*"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _braced(heads: list[tuple[re.Pattern[str], str]]) -> Callable[[str], list[Unit]]:
    """Units of brace languages: a head at depth zero up to its closing brace."""

    def outline(text: str) -> list[Unit]:
        masked = _mask(text)
        if masked.count("{") != masked.count("}"):
            raise ValueError("braces do not match")
        out, depth, open_at = [], 0, None
        for no, line in enumerate(masked.split("\n"), 1):
            if depth == 0 and open_at is None:
                open_at = next(((kind, no) for head, kind in heads if head.match(line)), None)
            before = depth
            depth += line.count("{") - line.count("}")
            if depth < 0:
                raise ValueError("a brace closes nothing")
            if open_at and depth == 0 and (before or "{" in line or line.rstrip().endswith((";", ")")) or re.match(r"type\s", line)):
                out.append((*open_at, no))
                open_at = None
        return [(k, a, b) for k, a, b in out]

    return outline


def _headed(text: str) -> list[Unit]:
    """Markdown: a heading with what follows it, fenced code kept whole."""
    out, start, fence, kind = [], 1, False, "paragraph"
    lines = text.split("\n")
    for no, line in enumerate(lines, 1):
        if re.match(r"\s*(?:```|~~~)", line):
            fence = not fence
        if not fence and re.match(r"#{1,6}\s", line):
            if no > start:
                out.append((kind, start, no - 1))
            start, kind = no, "atx_heading"
    out.append((kind, start, len(lines)))
    return [(k, a, b) for k, a, b in out if any(x.strip() for x in lines[a - 1 : b])]


def _top_level(entry: str) -> Callable[[str], list[Unit]]:
    """Data files: unindented entries with the indented lines under them."""
    head = re.compile(entry)

    def outline(text: str) -> list[Unit]:
        lines = text.split("\n")
        starts = [no for no, x in enumerate(lines, 1) if head.match(x)]
        ends = [s - 1 for s in starts[1:]] + [len(lines)]
        kinds = ["table" if lines[a - 1][0] == "[" else "key_value" if "=" in entry else "block_sequence_item" if lines[a - 1][0] == "-" else "block_mapping_pair" for a in starts]
        return list(zip(kinds, starts, ends))

    return outline


def _blocks(opener: str, closer: str, kinds: dict[str | None, str], other: str = "block") -> Callable[[str], list[Unit]]:
    """Languages of begin and end words: the outermost unindented pairs; the opener's first group gives the kind."""
    a, b = re.compile(opener), re.compile(closer)

    def outline(text: str) -> list[Unit]:
        out, start = [], None
        for no, line in enumerate(text.split("\n"), 1):
            if start is None and (m := a.match(line)):
                start, kind = no, kinds.get(m[1], other)
            elif start is not None and b.match(line):
                out.append((kind, start, no))
                start = None
        return out

    return outline


def _statements(text: str) -> list[Unit]:
    """SQL: definitions from their CREATE to the semicolon (of a trigger: to its END)."""
    head = re.compile(r"(?i)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(table|index|trigger|view)\b")
    out, open_at = [], None
    for no, line in enumerate(_mask(text, "--").split("\n"), 1):
        if open_at is None and (m := head.match(line.lstrip())):
            open_at, until = no, r"(?i)\bend\s*;\s*$" if m[1].lower() == "trigger" else r";\s*$"
        if open_at is not None and re.search(until, line):
            out.append((f"create_{head.match(text.split(chr(10))[open_at - 1].lstrip())[1].lower()}_statement", open_at, no))
            open_at = None
    return out


def _json(text: str) -> list[Unit]:
    """JSON: the outermost value, an object or an array."""
    json.loads(text)
    body = text.strip()
    first = text[: len(text) - len(text.lstrip())].count("\n") + 1
    kind = {"{": "object", "[": "array"}.get(body[:1])
    return [(kind, first, first + body.count("\n"))] if kind else []


def _elements(text: str) -> list[Unit]:
    """Markup: the outermost elements, by depth of their tags."""
    out, open_at = [], []
    void = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "!doctype")
    masked = re.sub(r"<!--[\s\S]*?-->|(?<=<script>)[\s\S]*?(?=</script>)|(?<=<style>)[\s\S]*?(?=</style>)", lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    at = line = 0
    for m in re.finditer(r"<(/?)([A-Za-z!][\w:.\-]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*?(/?)>", masked):
        line += masked.count("\n", at, m.start())
        at, name = m.start(), m[2].lower()
        end = line + 1 + m.group().count("\n")
        kind = {"script": "script_element", "style": "style_element"}.get(name, "element")
        if m[1]:
            while open_at and open_at[-1][0] != name:
                open_at.pop()
            if open_at:
                own = open_at.pop()
                if not open_at:
                    out.append((own[1], own[2], end))
        elif name in void or m[3]:
            if not open_at and name != "!doctype":
                out.append((kind, line + 1, end))
        else:
            open_at.append((name, kind, line + 1))
    if open_at:
        raise ValueError("an element stays open")
    return out


def _indented(heads: list[tuple[re.Pattern[str], str]]) -> Callable[[str], list[Unit]]:
    """Layout languages: an unindented head with the lines below it, up to the next unindented line that isn't its own."""

    def outline(text: str) -> list[Unit]:
        lines = text.split("\n")
        starts = [no for no, x in enumerate(lines, 1) if x[:1].strip() and not x.startswith(("--", "//", "(*", "}", ")", "]"))]
        out = []
        for no, nxt in zip(starts, [*starts[1:], len(lines) + 1]):
            if kind := next((k for head, k in heads if head.match(lines[no - 1])), None):
                end = nxt - 1
                while end > no and not lines[end - 1].strip():
                    end -= 1
                out.append((kind, no, end))
        return out

    return outline


def _instructions(text: str) -> list[Unit]:
    """Container build files: an instruction with its continued lines."""
    out, start = [], None
    for no, line in enumerate(text.split("\n"), 1):
        if start is None and re.match(r"(?i)\s*[a-z]+\s+\S", line) and not line.lstrip().startswith("#"):
            start = no
        if start is not None and not line.rstrip().endswith("\\"):
            out.append(("instruction", start, no))
            start = None
    return out


def _head(pattern: str, kind: str) -> tuple[re.Pattern[str], str]:
    return re.compile(pattern), kind


_MODIFIERS = r"\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|open|data|override|async|virtual|case|inner|suspend|indirect|fileprivate|pub(?:\([\w:]+\))?|unsafe|readonly|@\w+(?:\([^)]*\))?)\s+)*"
_EXPORT = r"(?:export\s+)?(?:default\s+)?"
_SCRIPT = [_head(_EXPORT + r"(?:async\s+)?function\b", "function_declaration"), _head(_EXPORT + r"(?:abstract\s+)?class\b", "class_declaration")]
_TYPED = [*_SCRIPT, _head(r"(?:export\s+)?(?:declare\s+)?interface\b", "interface_declaration"), _head(r"(?:export\s+)?(?:declare\s+)?type\s+\w+", "type_alias_declaration")]
_GO = [_head(r"func\s+\w", "function_declaration"), _head(r"type\s+[\w(]", "type_declaration")]
_JAVA = [_head(_MODIFIERS + r"class\b", "class_declaration"), _head(_MODIFIERS + r"@?interface\b", "interface_declaration")]
_CSHARP = [*_JAVA, _head(_MODIFIERS + r"(?:ref\s+)?struct\b", "struct_declaration")]
_C = [_head(r"(?:typedef\s+)?(?:struct|union|enum)\b[^;()]*$|(?:struct|union|enum)\s+\w+\s*\{", "struct_specifier"), _head(r"(?:[\w*]+\s+)+\**\w+\s*\([^;]*$", "function_definition")]
_CPP = [_head(r"(?:template\s*<[^{;]*>\s*)?class\s+\w+[^;]*$", "class_specifier"), _head(r"(?:[\w:<>,&*~]+\s+)*[&*]*[\w:~]+\s*\([^;]*$", "function_definition"), _C[0]]
_RUST = [_head(rf"{_MODIFIERS}(?:const\s+|extern\s+\S+\s+)?{word}\b", f"{kind}_item") for word, kind in (("fn", "function"), ("impl", "impl"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"))]
_SWIFT = [_head(_MODIFIERS + r"func\b", "function_declaration"), *(_head(rf"{_MODIFIERS}{w}\b", f"{w}_declaration") for w in ("class", "struct", "enum"))]
_PHP = [_head(r"function\b", "function_definition"), _head(r"(?:abstract\s+|final\s+)?class\b", "class_declaration")]
_KOTLIN = [_head(_MODIFIERS + r"fun\b", "function_declaration"), _head(_MODIFIERS + r"(?:class|interface)\b", "class_declaration"), _head(_MODIFIERS + r"object\b", "object_declaration")]
_SCALA = [_head(_MODIFIERS + r"def\b", "function_definition"), _head(_MODIFIERS + r"(?:class|trait)\b", "class_definition"), _head(_MODIFIERS + r"object\b", "object_definition")]
_GROOVY = [_head(_MODIFIERS + r"(?:class|interface|trait)\b", "class_declaration"), _head(_MODIFIERS + r"(?:def|void|\w+)\s+\w+\s*\(", "method_definition")]
_PROTO = [_head(rf"{w}\s+\w+", f"{w}_definition") for w in ("message", "service", "enum")]
_HCL = [_head(r"[\w\-]+(?:\s+\"[^\"]*\"|\s+[\w\-]+)*\s*\{", "block"), _head(r"[\w\-]+\s*=", "attribute")]
_CUE = [_head(r"#\w+\s*:", "definition"), _head(r"[\w\"\-]+[?!]?\s*:", "field")]
_ELM = [_head(r"type\s+alias\b", "type_alias_declaration"), _head(r"type\b", "type_declaration"), _head(r"(?!module\b|import\b|port\b)[a-z]\w*[^:]*=|[a-z]\w*\s*:", "value_declaration")]
_OCAML = [_head(r"(?:let|val)\b", "value_definition"), _head(r"type\b", "type_definition"), _head(r"module\b", "module_definition")]
#: An outline for the extensions of each grammar.
_OUTLINES: dict[str, Callable[[str], list[Unit]]] = {
    "python": _python, "go": _braced(_GO), "javascript": _braced(_SCRIPT), "typescript": _braced(_TYPED), "tsx": _braced(_TYPED), "java": _braced(_JAVA),
    "csharp": _braced(_CSHARP), "kotlin": _braced(_KOTLIN), "scala": _braced(_SCALA), "groovy": _braced(_GROOVY), "c": _braced(_C), "cpp": _braced(_CPP),
    "rust": _braced(_RUST), "swift": _braced(_SWIFT), "php": _braced(_PHP), "protobuf": _braced(_PROTO), "hcl": _braced(_HCL), "cue": _indented(_CUE),
    "css": _braced([_head(r"@\w+", "at_rule"), _head(r"[^\s/@}][^{]*\{?", "rule_set")]), "markdown": _headed, "json": _json, "html": _elements, "svelte": _elements,
    "yaml": _top_level(r"[^\s#\-][^#]*:(?:\s|$)|- "), "toml": _top_level(r"\[+[^\]]+\]+|[\w.\-]+\s*="), "sql": _statements, "dockerfile": _instructions,
    "ruby": _blocks(r"(def|class|module)\b", r"end\b", {"def": "method", "class": "class", "module": "module"}), "elm": _indented(_ELM), "ocaml": _indented(_OCAML),
    "elixir": _blocks(r"(defmodule|defp?)\b.*\bdo\s*$", r"end\b", {"defmodule": "module_definition", "def": "function_definition", "defp": "function_definition"}),
    "lua": _blocks(r"(local\s+)?function\b", r"end\b", {None: "function_definition"}, "local_function_statement"),
    "bash": _blocks(r"(?:function\s+)?[\w\-]+\s*\(\)\s*\{()", r"\}", {"": "function_definition"}),
}
OUTLINES: dict[str, Callable[[str], list[Unit]]] = {ext: _OUTLINES[grammar] for ext, grammar in LANGUAGES.items() if grammar in _OUTLINES}
#: Kinds of syntax nodes that a chunk is cut at, for the extensions of each grammar (fixed values).
NODE_TYPES: dict[str, str] = {
    "go": "function_declaration type_declaration",
    "javascript": "function_declaration class_declaration",
    "typescript": "function_declaration class_declaration interface_declaration type_alias_declaration",
    "tsx": "function_declaration class_declaration interface_declaration type_alias_declaration",
    "css": "rule_set at_rule",
    "markdown": "atx_heading setext_heading paragraph block_quote fenced_code_block loose_list tight_list table",
    "yaml": "block_mapping_pair block_sequence_item",
    "toml": "table key_value",
    "protobuf": "message_definition service_definition enum_definition",
    "json": "object array pair",
    "python": "function_definition class_definition",
    "ruby": "method class module",
    "c": "function_definition struct_specifier declaration",
    "cpp": "function_definition class_specifier struct_specifier",
    "csharp": "method_declaration class_declaration struct_declaration interface_declaration",
    "bash": "function_definition command",
    "html": "element script_element style_element",
    "java": "method_declaration class_declaration interface_declaration",
    "rust": "function_item impl_item struct_item enum_item trait_item",
    "swift": "function_declaration class_declaration struct_declaration enum_declaration",
    "php": "function_definition class_declaration method_declaration",
    "lua": "function_definition local_function_statement",
    "kotlin": "function_declaration class_declaration object_declaration",
    "scala": "function_definition class_definition object_definition",
    "groovy": "method_definition class_declaration",
    "elixir": "function_definition module_definition",
    "elm": "value_declaration type_alias_declaration type_declaration",
    "ocaml": "value_definition type_definition module_definition",
    "hcl": "block attribute",
    "cue": "field definition",
    "dockerfile": "instruction",
    "svelte": "script_element style_element element",
    "sql": "create_table_statement create_index_statement create_trigger_statement create_view_statement",
}
#: What a chunk of each kind of node is called (fixed values); other kinds keep their name.
CHUNK_TYPES: dict[str, str] = {
    "function": "function_declaration function_definition function_item local_function_statement method method_declaration method_definition",
    "type": "type_declaration type_definition type_alias_declaration value_declaration value_definition",
    "class": "class_declaration class class_specifier class_definition",
    "struct": "struct_declaration struct_specifier struct_item",
    "interface": "interface_declaration interface_definition",
    "enum": "enum_item enum_declaration",
    "impl": "impl_item trait_item",
    "module": "module module_definition",
    "object": "object_declaration object_definition",
    "section": "key_value",
    "table": "table",
    "pair": "pair",
    "rule": "rule_set",
    "at_rule": "at_rule",
    "heading": "atx_heading setext_heading",
    "paragraph": "paragraph",
    "list": "loose_list tight_list",
    "definition": "message_definition service_definition enum_definition create_table_statement create_index_statement create_trigger_statement create_view_statement",
    "block": "block_mapping_pair block_sequence_item object array block_quote fenced_code_block declaration command element script_element style_element block attribute field definition instruction",
}
_TYPE_OF = {node: name for name, nodes in CHUNK_TYPES.items() for node in nodes.split()}


def node_types(ext: str) -> tuple[str, ...]:
    """Kinds of nodes that files of an extension are cut at; none where there is no grammar."""
    return tuple(NODE_TYPES.get(LANGUAGES.get(ext.lower().lstrip("."), ""), "").split())


def chunk_type(node: str) -> str:
    return _TYPE_OF.get(node, node)


def outline(text: str, ext: str) -> list[Unit] | None:
    own = OUTLINES.get(ext.lower().lstrip("."))
    if own is None or not text:
        return None
    try:
        known = node_types(ext)
        return [u for u in own(text) if u[0] in known] or None
    except (SyntaxError, ValueError, RecursionError):
        return None


def _imports(text: str) -> str:
    """A Go file's import declarations."""
    return "\n".join(m.group().rstrip() for m in re.finditer(r"^import\s*(?:\([^)]*\)|[^\n]*)", text, re.M))


def structural_chunks(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "content", size: int = DEFAULT_SIZE) -> DataFrame:
    """``key, ordinal, content, type, start_line, end_line``: units where there are any, else packed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("content", pa.string()), ("type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
        for batch in batches:
            out = []
            for p, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ext = (p or "").rsplit(".", 1)[-1].lower() if "." in (p or "") else ""
                units = outline(value or "", ext)
                if units is None:
                    out.append(None)
                    continue
                lines = value.split("\n")
                own = [{"content": "\n".join(lines[a - 1 : b]), "type": chunk_type(k), "start_line": a, "end_line": b} for k, a, b in units]
                if ext == "go" and (head := _imports(value)):
                    own[0]["content"] = head + "\n\n" + own[0]["content"]
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, kind)], names=["key", "text", "units"])

    kind = files.schema[key].dataType.simpleString()
    piece = "array<struct<content:string,type:string,start_line:int,end_line:int>>"
    cut = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, text string, units {piece}")

    def split_long(u):
        parts = chunk_lines(u["content"], size)
        moved = F.transform(parts, lambda c: F.struct(c["content"].alias("content"), u["type"].alias("type"), (c["start_line"] + u["start_line"] - 1).alias("start_line"), F.least(c["end_line"] + u["start_line"] - 1, u["end_line"]).alias("end_line")))
        return F.when(F.octet_length(u["content"]) > size, moved).otherwise(F.array(u))

    units = merge_small(F.flatten(F.transform("units", split_long)), size)
    chunks = F.when(F.col("units").isNotNull(), units).otherwise(chunk_lines(F.col("text"), size))
    return cut.select("key", F.posexplode(chunks).alias("ordinal", "c")).select(F.col("key").alias(key), "ordinal", "c.content", "c.type", "c.start_line", "c.end_line")
