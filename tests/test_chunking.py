import pytest
from pyspark.sql import functions as F

from lodestone.operators.chunking import chunk_lines, explode_chunks, merge_small
from lodestone.operators.structural import OUTLINES, chunk_type, node_types, outline, structural_chunks
from lodestone.sources.scan import LANGUAGES, SUPPORTED


def plain(content, size=1000):
    """Line packing as stated, line by line."""
    size = size if size > 0 else 1000
    out, buf, start = [], "", 1
    lines = content.split("\n")
    if not content:
        return []
    for no, line in enumerate(lines, 1):
        joined = f"{buf}\n{line}" if buf else line
        if buf and len(joined.encode()) > size:
            out.append((buf, start, no - 1))
            if len(line.encode()) > size:
                out.append((line, no, no))
                buf, start = "", no + 1
            else:
                buf, start = line, no
        else:
            buf = joined
    return out + ([(buf, start, len(lines))] if buf else [])


CASES = ["", "one line", "line1\nline2", "a\n" * 50, "x" * 2000, "\n\nx\n", "\n\n\n", ("y" * 100 + "\n") * 3, "é" * 30 + "\nb\n" + "z" * 90 + "\nc", "a\r\nb\r\n", "long" * 50 + "\n\n\nshort\n" + "w" * 70]


def test_lines_against_plain_python(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)] + [(99, None)], "k int, c string")
    for size in (0, 20, 60, 150):
        rows = explode_chunks(df, "k", chunk_lines(F.col("c"), size)).orderBy("k", "ordinal").collect()
        for i, c in enumerate(CASES):
            assert [(r["content"], r["start_line"], r["end_line"]) for r in rows if r["k"] == i] == plain(c, size), (i, size)
        assert not [r for r in rows if r["k"] == 99]


def test_merge_small(spark):
    df = spark.createDataFrame([(1, "a\n" * 60)], "k int, c string")
    rows = explode_chunks(df, "k", merge_small(chunk_lines(F.col("c"), 10), 45)).orderBy("ordinal").collect()
    assert max(len(r["content"]) for r in rows) <= 45 and "\n".join(r["content"] for r in rows).count("a") == 60
    assert rows[0]["start_line"] == 1 and all(a["end_line"] + 1 == b["start_line"] for a, b in zip(rows, rows[1:]))


GO = 'package a\n\nimport "fmt"\n\nfunc Foo() {\n\tfmt.Println("}")\n}\n\ntype Bar struct {\n\tX int\n}\n'


UNITS = {
    ".go": (GO, [("function_declaration", 5, 7), ("type_declaration", 9, 11)]),
    "py": ("def foo():\n    return 1\n\nclass Bar:\n    pass\n", [("function_definition", 1, 2), ("class_definition", 4, 5)]),
    "js": ("export function foo() {\n  return 1;\n}\nclass Bar {\n}\n", [("function_declaration", 1, 3), ("class_declaration", 4, 5)]),
    "ts": ("interface A {\n}\ntype B = string;\n", [("interface_declaration", 1, 2), ("type_alias_declaration", 3, 3)]),
    "md": ("# A\ntext\n```\n# no\n```\n## B\nmore", [("atx_heading", 1, 5), ("atx_heading", 6, 7)]),
    "yml": ("a: 1\nb:\n  - c\n", [("block_mapping_pair", 1, 1), ("block_mapping_pair", 2, 4)]),
    "toml": ("[t]\na = 1\n", [("table", 1, 1), ("key_value", 2, 3)]),
    "json": ('{\n "a": [1]\n}\n', [("object", 1, 3)]),
    "rb": ("class A\n  def b\n  end\nend\n", [("class", 1, 4)]),
    "cs": ("public struct A\n{\n}\n", [("struct_declaration", 1, 3)]),
    "cpp": ("class A {\n};\nint f(int x) {\n  return x;\n}\n", [("class_specifier", 1, 2), ("function_definition", 3, 5)]),
    "rs": ("pub fn a() {\n}\nimpl A {\n}\n", [("function_item", 1, 2), ("impl_item", 3, 4)]),
    "html": ("<!doctype html>\n<html>\n<body><p>a</p>\n</body></html>\n", [("element", 2, 4)]),
    "svelte": ("<script>\nlet a = '<p>';\n</script>\n<p>x</p>\n", [("script_element", 1, 3), ("element", 4, 4)]),
    "sql": ("create table x (\n a int\n);\nselect 1;\nCREATE VIEW v AS select 1;\n", [("create_table_statement", 1, 3), ("create_view_statement", 5, 5)]),
    "dockerfile": ("FROM x\nRUN a \\\n b\n", [("instruction", 1, 1), ("instruction", 2, 3)]),
    "ml": ("let x = 1\n\nlet y =\n  2\ntype t = A\n", [("value_definition", 1, 1), ("value_definition", 3, 4), ("type_definition", 5, 5)]),
    "exs": ("defmodule A do\n  def b do\n  end\nend\n", [("module_definition", 1, 4)]),
    "cue": ("x: 1\n#D: {\n a: 1\n}\n", [("field", 1, 1), ("definition", 2, 4)]),
    "lua": ("local function a()\n return 1\nend\n", [("local_function_statement", 1, 3)]),
    "sh": ("f() {\n a\n}\n", [("function_definition", 1, 3)]),
    "proto": ("message A {\n}\nservice B {\n}\n", [("message_definition", 1, 2), ("service_definition", 3, 4)]),
    "kt": ("object A {\n}\nfun b() {\n}\n", [("object_declaration", 1, 2), ("function_declaration", 3, 4)]),
}


@pytest.mark.parametrize("ext", UNITS)
def test_outlines(ext):
    text, units = UNITS[ext]
    assert outline(text, ext) == units and all(k in node_types(ext) for k, _, _ in units)


def test_files_without_an_outline():
    assert outline("anything", "txt") is None and outline("func broken( {", "go") is None and outline("def x(:", "py") is None and outline("", "go") is None


def test_tables_of_nodes():
    assert len(LANGUAGES) == len(SUPPORTED) == 61 and set(OUTLINES) == set(LANGUAGES)
    assert {e.lstrip(".") for e in SUPPORTED} - set(LANGUAGES) == {"txt"} and set(LANGUAGES) - {e.lstrip(".") for e in SUPPORTED} == {"protobuf"}
    assert all(node_types(e) for e in LANGUAGES) and node_types(".txt") == () and node_types("GO") == ("function_declaration", "type_declaration")
    assert [chunk_type(x) for x in ("function_item", "table", "pair", "trait_item", "enum_definition", "field", "unknown_node")] == ["function", "table", "pair", "impl", "definition", "block", "unknown_node"]


def test_structural_chunks(spark):
    big = "def big():\n" + "".join(f"    x{i} = {i}\n" for i in range(200))
    rows = [(1, "r/a.go", GO), (2, "r/b.txt", "plain\ntext"), (3, "r/c.py", big), (4, "r/d.go", ""), (5, None, None)]
    got = structural_chunks(spark.createDataFrame(rows, "file_id int, path string, content string"), size=300).orderBy("file_id", "ordinal").collect()
    by = {k: [r for r in got if r["file_id"] == k] for k in range(1, 6)}
    assert by[1][0]["content"].startswith('import "fmt"\n\nfunc Foo') and by[1][0]["type"] == "function"
    assert [r["type"] for r in by[2]] == ["text"]
    assert len(by[3]) > 5 and all(len(r["content"]) <= 300 and r["type"] == "function" for r in by[3])
    assert by[3][0]["start_line"] == 1 and by[3][-1]["end_line"] == 201
    assert not by[4] and not by[5]
