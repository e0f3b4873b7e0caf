import ast
import itertools
import json

import pytest

from lodestone.llm.chart import MOST, Grammar
from lodestone.llm.syntax_repair import CONFLICT, MISMATCH, TRUNCATED, Bracketed, diagnose, rates, repairs

GOOD = {
    "go": 'package a\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\tA []byte\n\tB map[string]int\n}\n\nfunc (t *T) F(a int, b ...string) (int, error) {\n\tx := map[string]int{"a": 1}\n\tif v, ok := x["a"]; ok && v > 2 {\n\t\treturn v, nil\n\t} else {\n\t\tx["b"]++\n\t}\n\tfor i, s := range b {\n\t\tfmt.Println(i, s)\n\t}\n\tgo func() { t.F(1) }()\n\treturn len(x) + 1, nil\n}\n',
    "python": 'import os\n\n@dec(1)\nclass A(B, metaclass=M):\n    """doc <<<<<<< HEAD"""\n    x: int = 3\n\n    async def f(self, a, *b, c=None, **d) -> int:\n        for k, v in sorted(d.items()):\n            y = [i for i in b if i > 2] or {"a": 1, **d}\n        try:\n            return lambda q: q + 1\n        except (ValueError, E) as e:\n            raise X from e\n        finally:\n            pass\n',
    "javascript": 'import { a, b as c } from "./x";\nexport default class Q extends R {\n  static async m(x, { y, z = 2 }) {\n    const t = `a ${x} b`;\n    for (const v of y) if (v) break; else continue;\n    return x ? t : z?.w ?? [1, 2,];\n  }\n}\n!function(e,t){var a=e||{};if(a>3)t(a)}(this,{});\nconst f = async (a, b) => { await a(b) };\n',
    "typescript": 'interface A { a: number; b?: string[] }\nexport type M = { [k: string]: A | null };\nexport function f(a: number, b?: string): Promise<void> {\n  const c: Array<string> = b as any;\n  let d: string[] = c.filter((x: string) => x.length > 1);\n  return g(a, d) as Promise<void>;\n}\n',
    "java": 'package a.b;\nimport java.util.List;\npublic class A extends B {\n  private static final String X = "a";\n  @Override\n  public int f(List<Integer> a, String... b) throws E {\n    for (int i = 0; i < 3; i++) { a.add(i); }\n    for (var x : a) { this.g(x -> x + 1); }\n    if (a == null) return 1; else return (int) 2;\n  }\n}\n',
    "c": '#include <stdio.h>\nstruct s { int a; char *b; };\n#define A(x) \\\n  (x)\nstatic const char *n[] = { "a", "b" };\nstatic int f(int a, const char *b) {\n  size_t c = sizeof(a) * 3;\n  for (int i = 0; i < 3; i++) { p->q[i] = (int) c; }\n  return a ? 1 : f(2, b);\n}\n',
    "json": '{"a": [1, -2.5e3, true, null, {"b": "c\\n"}]}\n',
    "yaml": 'a: 1\nb:\n  - x\n  - y: "q"\n    z: [1, {c: d}]\nc: |\n  <<<<<<< text\n  more\nd: plain text\n  goes on\n',
    "shell": '#!/bin/sh\nset -e\nf() {\n  local a="${1:-x}"\n  for i in $(ls "$a"); do\n    echo "it\'s $((1 + 2))" >&2\n  done\n  if [ "$a" -gt 1 ]; then return 3; else b=$(g "$a"); fi\n}\ncat <<EOF\nfree (text\nEOF\ncase "$1" in a) f ;; *) exit 1 ;; esac\n',
    "sql": "CREATE TABLE a (\n  b integer,\n  primary key (b)\n);\n-- note\nSELECT b, count(*) FROM a WHERE b > 3 AND c = 'x''y' GROUP BY b;\nINSERT INTO a VALUES (1, 'x');\n",
}
CUT = {"go": "\tfor i, s := range b {", "python": "for k, v in sorted(d.it", "javascript": "for (const v of", "typescript": "let d: string[] = c.fil", "java": "for (int i = 0; i", "c": "for (int i = 0; i", "json": "{\"b\": \"c", "yaml": 'y: "q', "shell": 'echo "it', "sql": "'x''y"}


@pytest.mark.parametrize("lang", GOOD)
def test_sound_files_cost_nothing(lang):
    assert diagnose(lang, GOOD[lang]) == (0, None, 0)
    assert diagnose(lang, "") == (0, None, 0) and diagnose(lang, " \r\n") == (0, None, 0)
    assert diagnose(lang, GOOD[lang].replace("\n", "\r\n"))[0] == 0


@pytest.mark.parametrize("lang", GOOD)
def test_truncated_files_cost(lang):
    text = GOOD[lang]
    cost, cause, _ = diagnose(lang, text[: text.index(CUT[lang]) + len(CUT[lang])])
    assert cost > 0 and cause == TRUNCATED


@pytest.mark.parametrize("lang", GOOD)
def test_conflicts(lang):
    lines = GOOD[lang].split("\n")
    lines[2:2] = ["<<<<<<< HEAD", lines[1], "=======", lines[1], ">>>>>>> theirs"]
    cost, cause, _ = diagnose(lang, "\n".join(lines))
    assert cost > 0 and (cause == CONFLICT or lang == "json")


@pytest.mark.parametrize("lang", GOOD)
def test_text_of_another_language(lang):
    assert diagnose(lang, "<!DOCTYPE html>\n<html>\n<body>\n<p>It's a page.</p>\n</body>\n</html>\n")[0] > 0


def test_causes_come_from_where_the_edits_are():
    """A file cut off, one with a merge left in it, and one of another language, each broken after line 250."""
    head = "".join(f"func f{i}(a int) int {{\n\treturn a + {i}\n}}\n" for i in range(90))
    got = {name: diagnose("go", "package a\n" + text) for name, text in {
        TRUNCATED: head + "func g() {\n\tx := []int{1, 2",
        CONFLICT: head + "<<<<<<< HEAD\nvar a = 1\n=======\nvar a = 2\n>>>>>>> b\n" + head.replace("f", "h"),
        MISMATCH: "<html>\n<body>\n" + "".join(f"<p>text of line {i};</p>\n" for i in range(9)) + "</body>\n</html>\n",
    }.items()}
    assert {name: cause for name, (_, cause, _) in got.items()} == {name: name for name in got}
    assert got[TRUNCATED][2] >= 272 and abs(got[CONFLICT][2] - 272) <= 1


def test_a_files_cost_does_not_hang_on_the_files_before():
    bad = "package a\n" + "\n".join(f"x{i} := := {i} {i} ]" for i in range(12)) + "\n"
    parts = ["package a\n" + x + "\n" for x in bad.split("\n")[1:-1]]
    fresh = Bracketed("go").repair(bad)
    used = Bracketed("go")
    for p in parts:
        used.repair(p)
    assert used.repair(bad) == fresh and used.repair(bad) == fresh


def test_a_long_broken_statement_costs():
    text = "package a\n\nfunc f() {\n\tx := " + " + ".join(f"a{i}" for i in range(40)) + " + + ) b\n}\n"
    assert diagnose("go", text)[0] > 0 and diagnose("go", text.replace(" + + ) b", ""))[0] == 0


def test_languages_without_grammar():
    assert diagnose("markdown", "((((")[0] == 0 and diagnose("css", "a{{")[0] == 0


def test_python_and_json_agree_with_their_parsers():
    parts = ["a = 1", "if a:", "    b(2)", "else:", "    c = [", "1, 2]", "def f(x, y=1):", "    return x", ")", "for i in"]
    for n in (1, 2, 3):
        for lines in itertools.product(parts, repeat=n):
            text = "\n".join(lines) + "\n"
            try:
                ast.parse(text)
                good = True
            except SyntaxError:
                good = False
            assert (diagnose("python", text)[0] == 0) == good, text
    for tokens in itertools.product(["{", "}", "[", "]", '"a"', ":", ",", "1"], repeat=4):
        text = "".join(tokens)
        try:
            json.loads(text)
            good = True
        except ValueError:
            good = False
        assert (diagnose("json", text)[0] == 0) == good, text


def _edit_distance(words, s):
    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    return min(dist(w, s) for w in words)


def test_chart_cost_is_the_least():
    g = Grammar("E: T | E o T\nT: i | ( E )", {})
    words = {s for n in range(1, 8) for s in map("".join, itertools.product("io()", repeat=n)) if g.stops_at("E", s) is None}
    assert "io(i)" in words and "((i))" in words and "ii" not in words
    for n in range(1, 6):
        for s in map("".join, itertools.product("io()", repeat=n)):
            assert min(g.repair("E", s)[0], MOST + 1) == min(_edit_distance(words, s), MOST + 1), s


def test_tables(spark):
    rows = [
        (1, "r/a.go", "package a\nfunc f() {", "Go"), (1, "r/a.go", "package a\nfunc f() {", "Go"), (2, "r/b.go", "package b\n", None), (3, "q/c.py", "x = (", None),
        (4, None, None, None), (5, "q/d.md", "((", "md"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "file_id long, path string, content string, language string, cost int")
    got = repairs(df)
    assert {r["file_id"] for r in got.where("cost > 0").collect()} == {1, 3}
    assert {(r["repository"], r["language"], r["files"], r["broken"]) for r in rates(got).collect()} >= {("r", "go", 2, 1), ("q", "python", 1, 1)}
    assert repairs(df.where("false")).count() == 0


def test_unknown_language_falls_back_on_the_extension():
    from lodestone.llm.languages import language_of

    assert [language_of(n, "r/a.go") for n in (None, " ", "unknown", "Golang", "Python")] == ["go", "go", "go", "go", "python"]
    assert language_of("brainfuck", "r/a.bf") == "brainfuck" and language_of("x", None) == "x" and language_of(None, None) == ""


def test_least_cost_of_strings_of_any_length():
    """A few edits in a long string are counted, and found where they are."""
    g = Grammar("E: T | E o T\nT: i | ( E )", {})
    sound = "io" * 150 + "i"
    assert g.repair("E", sound) == (0, ())
    assert g.repair("E", sound[:200] + "o" + sound[200:])[0] == 1
    assert g.repair("E", "(" + sound)[0] == 1 and g.repair("E", sound + "))")[0] == 2
    cost, edits = g.repair("E", sound[:100] + "ooo" + sound[100:301])
    assert cost == 2 and all(98 <= e <= 104 for e in edits)
    assert g.repair("E", "o" * 40)[0] == MOST + 1


def test_least_cost_of_several_edits():
    g = Grammar("E: T | E o T\nT: i | ( E )", {})
    words = {s for n in range(1, 8) for s in map("".join, itertools.product("io()", repeat=n)) if g.stops_at("E", s) is None}
    for s in ("oo))", "((((", ")o)o", "o(o(", "))))", "i)i)i", "(o(o(", "ooooo", ")(i)("):
        assert min(g.repair("E", s)[0], 4) == min(_edit_distance(words, s), 4), s


def test_least_cost_above_any_bound():
    """Every edit counts, however many there are, and the ways to it agree."""
    from lodestone.llm.languages import GRAMMARS
    from lodestone.llm.least_edits import over_spans

    g = Grammar("E: T | E o T\nT: i | ( E )", {})
    words = {s for n in range(1, 12) for s in map("".join, itertools.product("io", repeat=n)) if g.stops_at("E", s) is None}
    for s in ("ooooooooo", "iiiiiiiiii", "iiooooooiii"):
        cost, edits = g.least("E", s)
        assert cost == len(edits) == _edit_distance(words, s) and cost >= 4, s
    assert g.least("E", "o" * 40)[0] == 21 and g.least("E", "(" * 400)[0] == 201
    assert g.least("E", "(" * 9)[0] == over_spans(g.rules, "E", "(" * 9)[0]
    go, c, java = (GRAMMARS[x][0] for x in ("go", "c", "java"))
    assert go.least("STMT", "C," * 120)[0] == 121
    for grammar, s in ((c, "ooioooiooiooioiii!i!i"), (java, "s:s,s:C,s:s,s:B,s:s"), (java, "ii.iiiai.iPiiP:iai.iPiPiPiiP"), (go, "idiPmnionC!!a")):
        cost, edits = grammar.least("STMT", s)
        assert cost == len(edits) == over_spans(grammar.rules, "STMT", s)[0]


def test_all_edits_of_a_statement_are_in_the_files_cost(spark):
    text = "package a\n\nfunc f() {\n\tx := []int{" + "1 " * 14 + "}\n}\n"
    rows = spark.createDataFrame([(1, "r/a.go", text, "Go")], "file_id long, path string, content string, language string")
    assert [(r["cost"], r["line"]) for r in repairs(rows).collect()] == [(7, 4)]


def test_whether_a_file_breaks_takes_no_costs(spark, monkeypatch):
    """The same files as by their costs, though no number of edits is worked out."""
    from lodestone.llm.least_edits import Automaton
    from lodestone.llm.syntax_repair import breaks, broken

    texts = [(lang, GOOD[lang][:end]) for lang in GOOD for end in range(0, len(GOOD[lang]) + 1, 9)]
    texts += [(a, GOOD[b]) for a in GOOD for b in GOOD] + [("go", "package a\nvar x = []int{" + "1 " * 40 + "}\n"), ("markdown", "(("), ("json", "")]
    costs = [diagnose(lang, x)[0] for lang, x in texts]
    assert 0 in costs and max(costs) > 9

    def read(self, s):
        raise AssertionError("no edits are asked for")

    monkeypatch.setattr(Automaton, "read", read)
    assert [breaks(lang, x) for lang, x in texts] == [c > 0 for c in costs]
    rows = spark.createDataFrame([(k, f"r/{k}", x, lang) for k, (lang, x) in enumerate(texts[:40])] + [(99, None, None, None)], "file_id long, path string, content string, language string")
    assert sorted(r["file_id"] for r in broken(rows.union(rows.where("file_id = 0"))).distinct().collect()) == [k for k, c in enumerate(costs[:40]) if c]
    assert broken(rows.where("false")).count() == 0


def test_a_way_that_costs_nothing_settles_a_group(monkeypatch):
    """An object's members are read as members; what they'd cost as statements isn't worked out."""
    from lodestone.llm.least_edits import Automaton

    def read(self, s):
        raise AssertionError("no edits are asked for")

    monkeypatch.setattr(Automaton, "read", read)
    assert Bracketed("javascript").check("{", "s:s,s:C,s:i,s:n,s:B") == (0, ())


def test_the_least_of_several_ways():
    from lodestone.llm.chart import last_of, least_of

    def way(bounds, cost, edits):
        for b in bounds:
            asked.append(b)
            yield b
        return cost, edits

    asked = []
    assert last_of(least_of([way([1, 7], 9, (0,)), way([1, 2], 3, (1,)), way([3, 4], 3, (2,))])) == (3, (1,))
    assert asked == [1, 1, 3, 7, 2] and last_of(least_of([way([], 2, (5,)), way([], 2, (6,))])) == (2, (5,))


def test_a_segments_cost_does_not_hang_on_other_readings_of_it():
    go = Bracketed("go")
    assert go.segment("ie", ("STMT",))[0] == 1 and go.segment("ie", ("STMT", "ARG")) == (0, ()) and go.segment("ie", ("STMT",))[0] == 1


def test_the_search_finds_the_least_at_its_own_number():
    """What is left out for taking too much to the end never was on the way to the least."""
    from lodestone.llm.languages import GRAMMARS
    from lodestone.llm.least_edits import Automaton, over_spans

    cases = [(Grammar("E: T | E o T | E Q E : E\nT: i | ( E )", {"Q": "?"}), "E", "io(?:"), (GRAMMARS["c"][0], "STMT", "iP:Ca")]
    for g, start, signs in cases:
        around = Automaton(g.rules, start)
        for s in map("".join, itertools.islice(itertools.product(signs, repeat=5), 0, None, 41)):
            if g.stops_at(start, s) is not None:
                least, floors = over_spans(g.rules, start, s)[0], g._floors(around, s)
                cost, edits = g._correct(start, s, least, floors)
                assert cost == len(edits) == least and g._correct(start, s, least - 1, floors) is None, s
