"""Lexers and segment grammars of the languages that syntax repair knows.

A file is cut into tokens of one character each; brackets are matched on a
stack and each group's content is cut at its separators, so what the chart
parser sees are short segments (a statement, an element of a list). A group
stands in its parent as one token: ``P`` for (), ``B`` for [], ``C`` for {}.

Common tokens: ``i`` name, ``n`` number, ``s`` string, ``o`` binary operator,
``m`` operator that may also be unary, ``u`` unary operator, ``q`` ++ or --,
``a`` assignment, ``r`` arrow, ``e`` ellipsis, ``G`` type arguments, ``?`` as
``Q``, ``:`` and ``,`` as themselves, ``!`` stands for what no rule takes.
"""

from __future__ import annotations

import re

from lodestone.llm.chart import Grammar

BAD = "!"
#: Spellings of languages, and extensions (fixed values).
SPELLINGS = {
    "golang": "go", "py": "python", "python3": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "sh": "shell", "bash": "shell", "zsh": "shell", "yml": "yaml", "h": "c", "md": "markdown", "txt": "text", "plaintext": "text", "plain text": "text",
}
EXTENSIONS = {
    "go": "go", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "c": "c", "h": "c", "json": "json", "yaml": "yaml", "yml": "yaml", "sh": "shell", "bash": "shell", "sql": "sql",
    "md": "markdown", "txt": "text", "css": "css",
}


def language_of(language: str | None, path: str | None) -> str:
    """A language's one name; the path's extension decides where it's null, blank or unknown."""
    name = (language or "").strip().lower()
    name = SPELLINGS.get(name, name)
    if name in EXTENSIONS.values():
        return name
    last = (path or "").rsplit("/", 1)[-1]
    return EXTENSIONS.get(last.rsplit(".", 1)[-1].lower(), name) if "." in last else name


_EXPRESSION = """
E: T | E o T | E m T
T: F | u T | m T | q T
F: A | F P | F B | F . i | F q
A: i | n | s | P | B
"""

GO = _EXPRESSION + """
E: func P C | func P RES C | func P RES
T: w T
F: F C | F . P
A: TYPE | A s
RES: P | TYPE
TYPE: i | i . i | i B | m TYPE | B TYPE | map B TYPE | chan TYPE | chan w TYPE | w chan TYPE | interface C | struct C | func P | func P RES | e TYPE
L: E | L , E
STMT: package i | import s | import i s | import P | import . s | s | i s
STMT: func i P C | func i P RES C | func P i P C | func P i P RES C | func i B P C | func i B P RES C | func i P | func i P RES
STMT: var V | const V | var P | const P | type i TYPE | type i a TYPE | type P | type i B TYPE
STMT: V | L a L | L d L | E q | E w E | return | return L | go E | defer E | goto i | break | break i | continue | continue i | fallthrough | L
STMT: i TYPE | i TYPE s | IL TYPE | C | i : STMT | i :
STMT: if HEAD C | if HEAD C else C | if HEAD C else IF | switch C | switch HEAD C | select C | for C | for HEAD C | for HEAD ; HEAD ; HEAD C | for HEAD ; HEAD ; C | for ; HEAD ; HEAD C | for ; HEAD ; C
STMT: for range E C | for L d range E C | for L a range E C
STMT: case L : | case L : STMT | default : | default : STMT | case L d E : | case L a E :
IF: if HEAD C | if HEAD C else C | if HEAD C else IF
HEAD: L | L d L | L a L | L d L ; L | E q | L a L ; L | ; L
V: i | IL a L | i TYPE a L | i TYPE | IL TYPE | IL TYPE a L
IL: i | i , IL
ARG: E | TYPE | i TYPE | i TYPE a E | E e | E : E | STMT | E : | : E | : | E : E : E | C | C : C | C : E | E : C
"""

_SCRIPT = _EXPRESSION + """
E: T Q E : E | T a E | E Q E : E | E in T | E instanceof T | E of T
E: i r E | i r C | P r E | P r C | async P r E | async P r C | async i r E | async i r C
T: new T | await T | typeof T | void T | delete T | yield T | yield | yield m T
F: F ?. i | F ?. P | F ?. B | F s | import P | F r2 i
A: C | class C | class i C | class extends F C | class i extends F C | this
A: function P C | function i P C | async function P C | async function i P C | function m P C | function m i P C
STMT: import s | import i from s | import C from s | import m as i from s | import i , C from s | import i , m as i from s
STMT: export STMT | export default E | export default STMT | export C | export C from s | export m from s | export m as i from s
STMT: const D | let D | var D | function i P C | async function i P C | function m i P C
STMT: class i C | class i extends F C | if P STMT | if P STMT ; else STMT | if P STMT else STMT | if P ; | for P STMT | for await P STMT | for P ; | while P STMT | while P ; | do STMT while P | do STMT ; while P
STMT: return | return LE | throw E | try C catch P C | try C catch C | try C finally C | try C catch P C finally C | switch P C
STMT: break | break i | continue | continue i | LE | C | i : STMT | debugger
STMT: case E : | case E : STMT | default : | default : STMT
STMT: MEMBER
MEMBER: NAME P C | m NAME P C | async NAME P C | get NAME P C | set NAME P C | static NAME P C | static async NAME P C | static NAME a E | static NAME | static C | NAME a E
NAME: i | s | n | B
LE: E | LE , E
D: D1 | D1 , D
D1: i | TARGET a E | TARGET of E | TARGET in E
TARGET: i | C | B
ARG: E | e E | D1 | const D | let D | var D | i as i | LE | STMT
ITEM: i | NAME : E | e E | MEMBER | i a E | s : E | i as i | default as i | m
"""
JAVASCRIPT = _SCRIPT
TYPESCRIPT = _SCRIPT + """
E: E as TYPE | E as const | P : TYPE r E | P : TYPE r C | async P : TYPE r C | async P : TYPE r E | G P r E | E satisfies TYPE | i u
T: G T
F: F G P | F u
STMT: import type C from s | import type i from s | interface i C | interface i G C | interface i extends TL C | interface i G extends TL C | type i a TYPE | type i G a TYPE | enum i C | const enum i C | declare STMT | namespace F C | abstract STMT | a TYPE
STMT: function i P : TYPE C | async function i P : TYPE C | function i G P C | function i G P : TYPE C | function i P : TYPE | async function i G P : TYPE C
STMT: class i G C | class i extends F G C | class i implements TL C | class i extends F implements TL C | class i G implements TL C | @ F STMT | @ F
D1: i : TYPE | i : TYPE a E | C : TYPE a E | i u : TYPE
TL: TYPE | TL , TYPE
TYPE: T1 | T1 o TYPE | o TYPE | P r TYPE | keyof TYPE | readonly TYPE | T1 extends TYPE Q TYPE : TYPE | i is TYPE | G P r TYPE | infer i
T1: i | s | n | i G | i . i | i . i G | C | P | T1 B | B | typeof F | void | this | m n | import P | s
MEMBER: MODS M2 | M2
MODS: MOD | MODS MOD
MOD: public | private | protected | readonly | static | abstract | async | override | declare | get | set | @ F
M2: NAME P C | NAME P : TYPE C | NAME G P : TYPE C | NAME : TYPE | NAME Q : TYPE | NAME a E | NAME : TYPE a E | NAME P : TYPE | NAME Q P : TYPE | NAME u : TYPE | NAME G P C | P : TYPE | B : TYPE
ARG: i Q : TYPE | MODS D1 | e i : TYPE | MODS i Q : TYPE | TYPE | i : TYPE r TYPE | this : TYPE | @ F D1 | i Q
ITEM: NAME Q : TYPE | e i : TYPE | NAME P : TYPE | NAME P : TYPE C | i a s | NAME : TYPE | B : TYPE | readonly NAME : TYPE
"""

JAVA = _EXPRESSION + """
E: E Q E : E | T a E | E instanceof TYPE | E instanceof TYPE i | i r E | i r C | P r E | P r C | switch P C
T: P T | new TYPE P | new TYPE P C | new TYPE B | new TYPE B B | new TYPE B C | new TYPE C | T . i
F: F r2 i | F r2 new | F . G i | F . class | F . this | F . new F | i G r2 new | i G r2 i | TYPE . class | new TYPE P . i | new TYPE P C . i
A: this | super | C | TYPE r2 new
TYPE: i | i G | TYPE . i | TYPE . i G | TYPE B | @ F TYPE
STMT: package NAME | import NAME | import static NAME | import NAME . m | import static NAME . m
NAME: i | NAME . i
STMT: DEF | MODS DEF | E | return | return E | throw E | break | break i | continue | continue i | C | static C | assert E | assert E : E | yield E
DEF: class i EXT C | class i C | class i G C | class i G EXT C | interface i C | interface i EXT C | interface i G C | interface i G EXT C | enum i C | enum i EXT C | record i P C | record i P EXT C | @ interface i C
EXT: extends TL | implements TL | extends TL implements TL
TL: TYPE | TL , TYPE
DEF: TYPE i P C | TYPE i P THROWS C | TYPE i P | TYPE i P THROWS | i P C | i P THROWS C | G TYPE i P C | G TYPE i P THROWS C | TYPE D | TYPE i P default E | G TYPE i P
THROWS: throws TL
D: D1 | D1 , D
D1: i | i a E | i B | i B a E
MODS: MOD | MODS MOD
MOD: public | private | protected | static | final | abstract | synchronized | native | transient | volatile | default | sealed | strictfp | @ F
STMT: if P STMT | if P STMT else STMT | if P STMT ; else STMT | for P STMT | for P ; | while P STMT | while P ; | do STMT while P | do STMT ; while P | switch P C | synchronized P C | i : STMT
STMT: try C CATCH | try P C | try P C CATCH | try C finally C | try C CATCH finally C | try P C CATCH finally C
CATCH: catch P C | catch P C CATCH
STMT: case ARGS : | case ARGS : STMT | default : | default : STMT | case ARGS r STMT | default r STMT
ARGS: E | E , ARGS
ARG: E | TYPE i | MODS TYPE i | TYPE e i | MODS TYPE e i | TYPE i : E | MODS TYPE i : E | TYPE D | MODS TYPE D | TYPE | TYPE o TYPE i | i a E | TYPE B i | TYPE i B | ARGS
ITEM: E | i P | i P C | i C | @ F ITEM
"""

C = _EXPRESSION + """
E: E Q E : E | T a E
T: P T | P C
F: F r i
A: C | A s | sizeof i | sizeof P | SPEC
SPEC: i | SPEC i | struct i | struct i i | union i | enum i | SPEC struct i
STARS: m | STARS m | STARS i
TYPE: SPEC | SPEC STARS
STMT: E | LE | return | return E | break | continue | goto i | i : | i : STMT | C | DEF | s C
STMT: if P STMT | if P STMT else STMT | if P STMT ; else STMT | for P STMT | for P ; | while P STMT | while P ; | do STMT while P | do STMT ; while P | switch P C | case E : | case E : STMT | default : | default : STMT
DEF: TYPE P C | TYPE i P C | SPEC P C | SPEC P | TYPE D | SPEC D | SPEC | struct i C | struct C | struct i C D | struct C D | union i C | union i C D | union C D | enum i C | enum C | enum i C D | enum C D | typedef DEF | TYPE i P | SPEC struct i C | SPEC struct i C D | SPEC enum i C | SPEC struct C D | SPEC enum C D | SPEC P P
D: D1 | D1 , D
D1: i | i DIM | i a E | i DIM a E | STARS i | STARS i a E | STARS i DIM | STARS i DIM a E | DIM | DIM a E | a E | i : n | P P | P P a E
DIM: B | DIM B
LE: E | LE , E
ARG: E | TYPE | TYPE i | TYPE i DIM | TYPE D | SPEC D | e | LE | TYPE DIM | TYPE P P
ITEM: E | . i a E | B a E | i a E | i
"""

JSON = """
V: s | n | i | P0 | B | C
P0: %
PAIR: s : V
"""

PYTHON = _EXPRESSION + """
E: E in T | E not in T | E o not T | lambda : E | lambda LP : E | E if E else E | i d E | await E | yield | yield XL | yield from E
T: not T | await T
F: F . i
A: C | A s | e
XL: X | XL , | XL , X
X: E | m E
ANN: : E
LP: LP1 | LP1 , LP
LP1: i | i a E | m i | m
STMT: XL | XL a XL | XL a STMT2 | i ANN | F ANN | F ANN a XL | return | return XL | raise | raise E | raise E from E | pass | break | continue | del XL | assert E | assert E , E | global NL | nonlocal NL
STMT2: XL | XL a STMT2
STMT: import ML | from DOTS import IL | from DOTS import m | from DOTS import P | @ E
NL: i | i , NL
ML: MOD | MOD as i | MOD , ML | MOD as i , ML
MOD: i | MOD . i
DOTS: MOD | DOT MOD | DOT
DOT: . | e | DOT . | DOT e
IL: i | i as i | i , IL | i as i , IL
HEAD: def i P : | def i P r E : | async def i P : | async def i P r E : | class i : | class i P : | if E : | elif E : | else : | while E : | for XL in XL : | async for XL in XL : | try : | except : | except XL : | except E as i : | finally : | with WL : | async with WL : | match XL : | case XL : | def i B P : | case XL if E : | except m E :
WL: E | E as X | E , WL | E as X , WL
BOTH: HEAD STMT | HEAD STMTS
STMTS: STMT | STMT ; | STMT ; STMTS
LINE: HEAD | STMT | HEAD STMTS | STMTS
ARG: X | X FOR | E : E | E : E FOR | m E | i a E | i ANN | i ANN a E | m i ANN | m | o | : | E : | : E | : E : E | : : E | E : : E | E : E : E | E : : | : E : | E as i | XL FOR
FOR: for XL in E | for XL in E IFS | for XL in E FOR | async for XL in E | for XL in E IFS FOR
IFS: if E | if E IFS
"""

SQL = """
STMT: V0 REST | V0
V0: w0
REST: X | REST X | REST SEP X
SEP: , | o | m | a | .
X: i | n | s | P | w1 X | m | B
"""


#: Characters of tokens that a plain letter doesn't stand for.
_SIGNS = {"?.": "\ue0f0", "r2": "\ue0f1", "w0": "\ue0f2", "w1": "\ue0f3", "Q": "?"}


def _compile(text: str, words: str) -> tuple[Grammar, dict[str, str]]:
    """A grammar whose named words stand for characters of the private area."""
    table = {w: chr(0xE000 + k) for k, w in enumerate(words.split())}
    return Grammar(text, table | _SIGNS), table


GRAMMARS: dict[str, tuple[Grammar, dict[str, str]]] = {
    "go": _compile(GO, "func map chan interface struct package import var const type return go defer goto break continue fallthrough if else switch select for range case default w"),
    "javascript": _compile(
        JAVASCRIPT,
        "in instanceof of async function new await typeof void delete yield import class extends this from as export default const let var if else for while do return throw try catch finally switch break continue case debugger get set static",
    ),
    "typescript": _compile(
        TYPESCRIPT,
        "in instanceof of async function new await typeof void delete yield import class extends this from as export default const let var if else for while do return throw try catch finally switch break continue case debugger get set static"
        " satisfies interface type enum declare namespace abstract implements keyof readonly is infer public private protected override",
    ),
    "java": _compile(
        JAVA,
        "instanceof new class this super package import static return throw break continue assert yield interface enum record extends implements throws public private protected final abstract synchronized native transient volatile default sealed strictfp"
        " if else for while do switch try catch finally case",
    ),
    "c": _compile(C, "sizeof struct union enum return break continue goto if else for while do switch case default typedef"),
    "json": _compile(JSON, ""),
    "python": _compile(
        PYTHON,
        "in not lambda if else await yield from return raise pass break continue del assert global nonlocal import as def async class elif while for try except finally with match case",
    ),
    "sql": _compile(SQL, ""),
}

_STRINGS = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+n?|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[fFdDlLuUjn]*(?![A-Za-z_])"
_NAME = r"[^\W\d][\w$]*|[$#]?[A-Za-z_$][\w$]*"


def _lexer(skip: str, strings: str, operators: str, name: str = _NAME) -> re.Pattern[str]:
    """One match takes the space before a token and the token.

    Groups: 1 line breaks, 2 comments, 3 string, 4 number, 5 name, 6 operator, 7 anything, none at the end.
    """
    return re.compile(rf"[ \t\r]*(?:(\n(?:[ \t\r]*\n)*)|({skip})|({strings})|({_NUMBER})|({name})|({operators})|([\s\S])|)")


_OPS = r"=>|->|\.\.\.|\?\.(?!\d)|\?\?=?|::|:=|<-|\+\+|--|&&=?|\|\|=?|<<=|>>>?=|<<|>>>?(?!>)|[=!]==|[=!<>]=|\*\*=?|//=?|[-+*/%&|^@]=|[-+*/%&|^!~<>=?:;,.@(){}\[\]]"
_C_SKIP = r"[ \t\r\f\v﻿ ]+|//[^\n]*|/\*[\s\S]*?\*/"
_REGEX = r"(?:(?<=[(,=:\[!&|?;{}])|(?<=[(,=:\[!&|?;{}] )|(?<=return ))/(?![*/\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
LEXERS = {
    "go": _lexer(_C_SKIP, _STRINGS + r"|`[^`]*`", _OPS),
    "javascript": _lexer(_C_SKIP + r"|(?<![\s\S])#![^\n]*", _STRINGS + r"|`(?:[^`\\]|\\[\s\S])*`|" + _REGEX, _OPS),
    "typescript": _lexer(_C_SKIP + r"|(?<![\s\S])#![^\n]*", _STRINGS + r"|`(?:[^`\\]|\\[\s\S])*`|" + _REGEX, _OPS),
    "java": _lexer(_C_SKIP, r"\"\"\"[\s\S]*?\"\"\"|" + _STRINGS, _OPS),
    "c": _lexer(_C_SKIP + r"|(?<![^\n \t\r﻿])#(?:[^\n\\]|\\\r?\n|\\[^\n])*", r"[LuU]?(?:" + _STRINGS + ")", _OPS),
    "json": _lexer(r"[ \t\r]+|(?<![\s\S])﻿", r"\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[\da-fA-F]{4})*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", r"[:,{}\[\]]", name=r"true|false|null"),
    "python": _lexer(r"[ \t\r\f﻿ ]+|\#[^\n]*|\\\r?\n", r"(?i:[rbfut]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|" + _STRINGS + ")", _OPS),
    "sql": _lexer(r"[ \t\r\f﻿]+|--[^\n]*|/\*[\s\S]*?\*/", r"'(?:[^']|'')*'|\"[^\"\n]*\"|`[^`\n]*`|\$\$[\s\S]*?\$\$", r"<>|[<>!]=|\|\||::|[-+*/%&|^!~<>=?:;,.@(){}\[\]]"),
}

_OPERATORS = {
    **dict.fromkeys("&& || == != === !== <= >= < > << >> >>> % / | ^ ?? ** //".split(), "o"),
    **dict.fromkeys("+ - * &".split(), "m"),
    **dict.fromkeys("! ~".split(), "u"),
    **dict.fromkeys("++ --".split(), "q"),
    **dict.fromkeys("= += -= *= /= %= &= |= ^= <<= >>= >>>= &&= ||= ??= **= //= @=".split(), "a"),
    "=>": "r", "->": "r", "...": "e", ":=": "d", "?": "?", "?.": _SIGNS["?."], "::": _SIGNS["r2"], ":": ":", ";": ";", ",": ",", ".": ".", "@": "@",
}


def operators(lang: str) -> dict[str, str]:
    """What an operator's spelling stands for in a language."""
    own = dict(_OPERATORS)
    table = GRAMMARS[lang][1]
    if lang == "go":
        own |= {"<-": table["w"], "^": "m", "===": BAD, "!==": BAD, ">>>": BAD, "=>": BAD, "->": BAD, "?": BAD, "??": BAD, "@": BAD, "~": "m"}
    elif lang == "python":
        own |= {"++": "+", "--": "-", "&&": BAD, "||": BAD, "===": BAD, "!": BAD, "?": BAD, "!==": BAD, "=>": BAD, "::": BAD, "~": "u", "@": "@", "**": "m", "/": "o", "?.": BAD, "??": BAD, "<-": BAD, ">>>": BAD}
    elif lang == "c":
        own |= {"===": BAD, "!==": BAD, "=>": BAD, ":=": BAD, "@": BAD, "??": BAD, "?.": BAD, "::": BAD, "<-": BAD, "**": BAD, ">>>": BAD, "->": "."}
    elif lang == "java":
        own |= {"===": BAD, "!==": BAD, "=>": BAD, ":=": BAD, "??": BAD, "?.": BAD, "<-": BAD, "**": BAD, "->": "r"}
    elif lang in ("javascript", "typescript"):
        own |= {":=": BAD, "->": BAD, "::": BAD, "<-": BAD, "@": "@" if lang == "typescript" else BAD, "//": BAD}
    elif lang == "json":
        own = {":": ":", ",": ","}
    own |= {x: x for x in "(){}[]"}
    if lang == "sql":
        own |= {"||": "o", "<>": "o", "::": "o", "?": "i", "@": "m", "!": BAD, "~": "o", ":": "m"}
    return own
