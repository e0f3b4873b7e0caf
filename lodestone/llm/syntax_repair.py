"""Flag source files that do not parse in their language, by minimum-cost repair.

A file is lexed, brackets are matched, and every segment between separators is
handed to the error-correcting chart parser (``chart``), which knows each
distinct segment once. The file's cost is the sum of its segments' edits, of
brackets to insert or delete, and of lines that fit no line form in the
languages of lines. Where the edits stand tells truncation (all at the end),
merge conflicts (at marker lines) and text of another language (all over).

Defined cases: null and empty content costs nothing, and so does content in
Markdown, plain text, CSS or a language without a grammar; an unknown or null
language falls back on the path's extension; repeated rows give a result each
(queries drop them); columns besides id, path, content and language are
ignored.
"""

from __future__ import annotations

import ast
import bisect
import functools
import json
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chart import Rising, last_of, least_of
from lodestone.llm.languages import _SIGNS, BAD, GRAMMARS, LEXERS, language_of, operators

TRUNCATED, CONFLICT, MISMATCH, OTHER = "truncated", "conflict", "mismatch", "other"
_MARKER = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?:\s|$)", re.M)
_CLOSES = {")": "(", "]": "[", "}": "{"}
_GROUP = {"(": "P", "[": "B", "{": "C"}
_TYPE_ARGS = re.compile(r"<[\w\s,.\[\]?|]*(?:<[\w\s,.\[\]?|]*(?:<[\w\s,.\[\]?|]*>[\w\s,.\[\]?|]*)*>[\w\s,.\[\]?|]*)*>")
#: Words that go on with what was before them, though they begin a line or follow a block.
_ON = {
    "go": "else", "javascript": "else catch finally instanceof in of extends as from while", "typescript": "else catch finally instanceof in of extends as from while implements satisfies is",
    "java": "else catch finally instanceof extends implements throws while", "c": "else while",
}
_SQL_VERBS = frozenset(
    "select insert update delete create alter drop grant revoke with begin commit rollback set use explain truncate merge call declare comment copy analyze vacuum"
    " pragma replace lock show describe attach detach start savepoint release do values end if prepare execute refresh reindex go".split()
)
_SQL_HANGING = frozenset(
    "select insert into update delete create alter drop table from where set values and or on join by order group having union inner left right outer as in is not null"
    " between like limit offset add column primary key references foreign constraint default index unique view with case when then else distinct all exists".split()
)


class _Frame:
    __slots__ = ("kind", "chars", "at", "line")

    def __init__(self, kind: str, line: int):
        self.kind, self.chars, self.at, self.line = kind, [], [], line


class Bracketed:
    """Repair of a language of brackets and separators."""

    def __init__(self, lang: str, whole: bool = True):
        """``whole``: costs are worked out; else only so far that they are known to be 0 or above."""
        self.lang, self.whole = lang, whole
        self.grammar, self.words = GRAMMARS[lang]
        self.ops = operators(lang)
        self.lexer = LEXERS[lang]
        self.on = {self.words[w] for w in _ON.get(lang, "").split() if w in self.words}
        self.script = lang in ("javascript", "typescript")
        w = self.words
        self.ends = set("insPBCq") | {w[x] for x in ("return", "break", "continue", "fallthrough", "this", "super", "debugger") if x in w}
        self.cold = {w[x] for x in ("return", "throw", "new", "await", "typeof", "case", "else", "do", "export", "default", "import", "static", "async", "const", "let", "var", "class", "function", "of", "in", "get", "set", "extends", "type", "enum", "interface", "delete", "void", "yield", "try", "finally") if x in w}
        self.other = w.get("else", "")
        self.known: dict[tuple[tuple[str, ...], str], tuple[int, tuple[int, ...]]] = {}

    # ---- segments -------------------------------------------------------

    def segment(self, s: str, starts: tuple[str, ...]) -> tuple[int, tuple[int, ...]]:
        return self._worked(self._rising(s, starts))

    def _worked(self, rising: Rising) -> tuple[int, tuple[int, ...]]:
        if self.whole:
            return last_of(rising)
        try:
            while not (least := next(rising)):
                pass
        except StopIteration as end:
            return end.value
        return least, ()

    def _rising(self, s: str, starts: tuple[str, ...]) -> Rising:
        key = (starts, s)
        got = self.known.get(key)
        if got is None:
            got = yield from least_of([self.grammar.rising(start, s) for start in starts])
            self._keep(key, got)
        return got

    def _keep(self, key: tuple[tuple[str, ...], str], got: tuple[int, tuple[int, ...]]) -> None:
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[key] = got

    def _statements(self, s: str) -> list[tuple[int, str]]:
        """Segments of a block, with where they start."""
        out: list[tuple[int, str]] = []
        if self.lang == "go":  # a header may hold signs that end statements elsewhere
            for at, x in self._list(s, "\n"):
                if ";" in x and self.grammar.stops_at("STMT", x) is not None:
                    out += [(at + k, y) for k, y in self._list(x, ";")]
                else:
                    out.append((at, x))
            return [x for x in out if x[1]]
        for at, x in self._list(s, ";\n"):
            if not x:
                continue
            if x[0] == self.other and out and s[at - 1] == ";":
                first, before = out.pop()
                at, x = first, f"{before};{x}"
            out.append((at, x))
        return out

    def _list(self, s: str, sep: str = ",") -> list[tuple[int, str]]:
        out, start = [], 0
        for k, c in enumerate(s):
            if c in sep:
                out.append((start, s[start:k]))
                start = k + 1
        out.append((start, s[start:]))
        return out

    def check(self, kind: str, s: str) -> tuple[int, tuple[int, ...]]:
        """Cost of a group's content and the positions of its edits."""
        if not s or s == "\n":
            return 0, ()
        key = ((kind,), s)
        got = self.known.get(key)
        if got is None:
            got = self._worked(least_of(self._check(kind, s)))
            if self.whole or not got[0]:
                self._keep(key, got)
        return got

    def _sum(self, parts: list[tuple[int, str]], starts: tuple[str, ...], empty: str) -> Rising:
        """What the parts cost together: first how many fail, then what they cost at least, then what they cost."""
        ends: dict[int, tuple[int, tuple[int, ...]]] = {}
        waits: list[tuple[int, int, Rising]] = []
        cost = 0
        for k, (at, x) in enumerate(parts):
            x2 = x.replace("\n", "")
            if not x2:
                if empty == "last" and k == len(parts) - 1 or empty == "any":
                    continue
                ends[k] = 1, (0,)
                cost += 1
                yield cost
            elif not any(self.grammar.sound(start, x2) for start in starts):
                waits.append((k, 1, self._rising(x2, starts)))
                cost += 1
                yield cost
        while waits:
            still = []
            for k, before, rising in waits:
                try:
                    now = max(before, next(rising))
                    still.append((k, now, rising))
                except StopIteration as end:
                    ends[k] = end.value
                    now = end.value[0]
                if now > before:
                    cost += now - before
                    yield cost
            waits = still
        edits = []
        for k in sorted(ends):
            at, x = parts[k]
            real = [j for j, ch in enumerate(x) if ch != "\n"]
            edits += [at + (real[p] if p < len(real) else max(len(x) - 1, 0)) for p in ends[k][1]]
        return cost, tuple(edits)

    def _block(self, s: str) -> Rising:
        return self._sum(self._statements(s), ("STMT",), "any")

    def _members(self, s: str, at: int) -> Rising:
        """An enum's constants, to ``at``, before its members."""
        first = yield from self._sum(self._list(s[:at]), ("ITEM",), "last")
        rest = self._block(s[at + 1 :])
        while True:
            try:
                yield first[0] + next(rest)
            except StopIteration as end:
                return first[0] + end.value[0], first[1] + tuple(at + 1 + p for p in end.value[1])

    def _check(self, kind: str, s: str) -> list[Rising]:
        """The ways to read a group's content; of equals the first counts."""
        lang = self.lang
        if lang == "json":
            return [self._sum(self._list(s), ("PAIR",) if kind == "{" else ("V",), "never")]
        if lang == "sql":
            return [self._sum(self._list(s), ("REST",), "never")]
        if kind == "{":
            if ";" not in s:
                return [self._block(s), self._sum(self._list(s), ("ITEM", "ARG") if lang != "go" else ("ARG",), "last")]
            if lang == "java":
                return [self._block(s), self._members(s, s.index(";"))]
            if lang == "typescript":
                return [self._block(s), self._sum(self._list(s, ",;\n"), ("ITEM", "ARG"), "any")]
            return [self._block(s)]
        if kind == "(" and lang == "go" and ("\n" in s or ";" in s):
            return [self._sum(self._statements(s), ("STMT", "ARG"), "any")]
        if kind == "(" and ";" in s:
            return [self._sum(self._list(s, ";"), ("ARG", "STMT"), "any")]
        return [self._sum(self._list(s), ("ARG",), "any" if self.script and kind == "[" else "last")]

    # ---- a file ---------------------------------------------------------

    def lex(self, text: str, places: list[int] | None = None) -> list[str]:
        """Token characters; ``places`` takes where the tokens begin."""
        ops, words = self.ops, self.words
        chars: list[str] = []
        put = chars.append
        lang_java, script = self.lang == "java", self.script
        generic, breaks = self.lang in ("java", "typescript"), script or self.lang == "go"
        dots = (".", _SIGNS["?."]) if self.lang != "python" else ()
        last, skip = "", 0
        for m in self.lexer.finditer(text):
            k = m.lastindex
            if k == 5:
                w = m[5]
                c = words.get(w)
                if c is None or last in dots:
                    c = "i"
                elif lang_java:
                    if w in ("record", "sealed", "yield"):
                        c = c if re.match(r"\s+[A-Za-z]\w*\s*[(<;.]" if w != "sealed" else r"\s+[a-z]", text[m.end() : m.end() + 80]) and last not in ("a", ".") else "i"
                elif script:
                    c = self._contextual(w, c, text, m.end(), last)
            elif k == 6:
                w = m[6]
                c = ops.get(w, BAD)
                if generic and w == "<" and m.start(6) >= skip:
                    start = m.start(6)
                    g = _TYPE_ARGS.match(text, start)
                    if g:
                        before = re.search(r"(\w+)\s*$", text[max(0, start - 40) : start])
                        if before and before.group(1)[0].isupper() or not before and last in (".", ";", "{", "\n") or before and self.lang == "typescript" and text[g.end() : g.end() + 1] == "(":
                            c, skip = "G", g.end()
                            put(c)
                            if places is not None:
                                places.append(start)
                            last = c
                            continue
            elif k == 1:
                put("\n")
                if places is not None:
                    places.append(m.start(1))
                continue
            elif k == 2:
                if breaks and "\n" in m[2]:
                    put("\n")
                    if places is not None:
                        places.append(m.start(2))
                continue
            elif k is None:
                break
            else:
                c = "s" if k == 3 else "n" if k == 4 else BAD
            if skip and m.start(k) < skip:
                continue
            put(c)
            if places is not None:
                places.append(m.start(k))
            last = c
        return chars

    def _contextual(self, word: str, c: str, text: str, end: int, last: str) -> str:
        rest = text[end : end + 24].lstrip()
        nxt = rest[:1]
        if word == "from":
            return c if nxt in "\"'" and nxt else "i"
        if word in ("of", "as", "is", "satisfies"):
            return c if last in ("i", ")", "]", "}", "m", "s", "n", "this") or last >= "\ue000" else "i"
        if word in ("get", "set", "static", "async", "type", "interface", "declare", "abstract", "readonly", "public", "private", "protected", "override", "namespace", "enum", "infer", "keyof"):
            return c if rest[:1].isalpha() or nxt in "_$#*[\"'{" or word == "async" and nxt == "(" else "i"
        if word in ("default", "case"):
            return c
        if nxt == ":" and word not in ("else", "this"):
            return "i"
        if nxt == "(" and last in ("{", ",", ";", "\n", "C") and word in ("delete", "import", "catch", "finally", "return", "new") and word != "return":
            return c if word in ("import", "catch", "new") else "i"
        return c

    def repair(self, text: str) -> tuple[int, list[int]]:
        """The least cost found, and the offsets of the edits."""
        root = _Frame("", 0)
        stack = [root]
        cost, where = 0, []
        lang, ends = self.lang, self.ends
        cuts = lang in ("javascript", "typescript", "java", "c")
        broke = False  # a line break since the last token

        def close(frame: _Frame, at: int) -> None:
            nonlocal cost
            c, e = self.check(frame.kind, "".join(frame.chars))
            if c:
                cost += c
                last = len(frame.at) - 1
                where.extend(frame.at[min(p, last)] if last >= 0 else at for p in e)

        tokens = self.lex(text)
        n = len(tokens)
        for at, c in enumerate(tokens):
            top = stack[-1]
            if c == "\n":
                broke = True
                if lang == "go" and top.chars and top.chars[-1] in ends and top.kind != "[" and (top.kind != "(" or top.chars[-1] != "\n"):
                    top.chars.append("\n")
                    top.at.append(at)
                continue
            if c in "([{":
                if cuts and top.chars and (broke or top.chars[-1] == "C"):
                    self._cut(top, c, broke, at)
                stack.append(_Frame(c, at))
            elif c in ")]}":
                kind = _CLOSES[c]
                if top.kind != kind:
                    deeper = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].kind == kind), 0)
                    if not deeper:
                        cost += 1
                        where.append(at)
                        broke = False
                        continue
                    while stack[-1].kind != kind:
                        lost = stack.pop()
                        cost += 1
                        where.append(at)
                        close(lost, at)
                        stack[-1].chars.append(_GROUP[lost.kind])
                        stack[-1].at.append(lost.line)
                frame = stack.pop()
                if lang == "go" and frame.chars and frame.chars[-1] == "\n":
                    frame.chars.pop()
                    frame.at.pop()
                close(frame, at)
                top = stack[-1]
                top.chars.append(_GROUP[kind])
                top.at.append(frame.line)
            else:
                if cuts and top.chars and (broke or top.chars[-1] == "C"):
                    self._cut(top, c, broke, at)
                top.chars.append(c)
                top.at.append(at)
            broke = False
        while len(stack) > 1:
            lost = stack.pop()
            cost += 1
            where.append(n)
            close(lost, n)
            stack[-1].chars.append(_GROUP[lost.kind])
            stack[-1].at.append(lost.line)
        s = "".join(root.chars)
        if lang == "json":
            c, e = self.segment(s, ("V",)) if s else (0, ())
        elif lang == "sql":
            c, e = self._sql(text, s, root.at)
        else:
            c, e = self._worked(self._block(s))
        cost += c
        where += [root.at[min(p, len(root.at) - 1)] if root.at else n for p in e]
        if not cost:
            return 0, []
        places: list[int] = []
        self.lex(text, places)
        places.append(len(text))
        return cost, [places[p] for p in where]

    def _cut(self, top: _Frame, c: str, broke: bool, at: int) -> None:
        """End a statement before this token where the language lets it end without a sign."""
        chars = top.chars
        if top.kind in ("(", "["):
            return
        prev = chars[-1]
        word = c in "insCu@" or "\ue000" <= c <= "\ue0ef" or c == "{"
        if not word or c in self.on:
            return
        if prev == "C":
            before = chars[-2] if len(chars) > 1 else ";"
            if before in "arom,?:" and not (broke and self.script):
                return
            if self.lang == "c" and before not in "P" and before not in self.cold:
                return
            if c == "{" and not broke:
                return
            if not broke and (before in self.cold and before not in {self.words.get(x) for x in ("else", "try", "finally", "do", "static")}):
                return
        elif self.script and broke and prev in self.ends:
            pass
        else:
            return
        chars.append("\n")
        top.at.append(at)

    def _sql(self, text: str, s: str, own: list[int]) -> tuple[int, tuple[int, ...]]:
        cost, edits, start = 0, [], 0
        places: list[int] = []
        self.lex(text, places)
        at = [places[p] for p in own]
        for part in s.split(";"):
            if part:
                head = text[at[start] : at[start] + 20].lower()
                verb = re.match(r"\w+", head)
                if not verb or verb.group() not in _SQL_VERBS:
                    cost += 1
                    edits.append(start)
                end = start + len(part) - 1
                last = re.match(r"\w*", text[at[end] : at[end] + 30].lower()).group()
                if part[-1] in "o,ma." or part[-1] == "i" and last in _SQL_HANGING and last not in ("null", "key", "all", "default"):
                    cost += 1
                    edits.append(end)
                bad = part.count(BAD) + part.count("e") + part.count("d") + part.count("r") + part.count("q") + part.count("u") + part.count("C")
                if bad:
                    cost += bad
                    edits.append(start + next((j for j, ch in enumerate(part) if ch in BAD + "edrquC"), 0))
                c, e = self.segment(_SIGNS["w0"] + re.sub(r"[^insPBo,ma.]", "o", part[1:]), ("STMT",))
                cost += c
                edits += [start + p for p in e]
            start += len(part) + 1
        return cost, tuple(min(p, len(at) - 1) for p in edits)


class Python(Bracketed):
    """Logical lines, their indentation, and the chart of each."""

    def __init__(self, whole: bool = True):
        super().__init__("python", whole)
        w = self.words
        self.heads = {w[x] for x in "def async class if elif else for while try except finally with match case".split()}
        self.attempt = w["try"]
        led = {"else": "if elif for while except", "elif": "if elif", "except": "try except", "finally": "try except else"}
        self.led = {w[k]: {w[x] for x in v.split()} for k, v in led.items()}

    def _check(self, kind: str, s: str) -> list[Rising]:
        parts = self._list(s)
        if any(self.words[x] in s for x in ("for", "lambda")) and self.grammar.sound("ARG", s):
            parts = [(0, s)]
        return [self._sum(parts, ("ARG",), "last")]

    def repair(self, text: str) -> tuple[int, list[int]]:
        stack: list[_Frame] = [_Frame("", 0)]
        cost, where = 0, []
        indents, opens = [0], False
        heads: dict[int, str] = {}  # by depth, how the last statement began
        n = len(text)

        def end_line() -> None:
            nonlocal cost, opens
            line = stack[0]
            s = "".join(line.chars)
            line.chars, at = [], line.at
            line.at = []
            if not s:
                return
            start = text.rfind("\n", 0, at[0]) + 1
            lead = text[start : at[0]].lstrip("﻿")
            depth = len(lead.expandtabs(8)) if not lead.strip() else 0
            bad = False
            if opens:
                if depth <= indents[-1]:
                    bad = True
                else:
                    indents.append(depth)
            elif depth > indents[-1]:
                bad = True
            else:
                while depth < indents[-1]:
                    indents.pop()
                bad = depth != indents[-1]
            if bad:
                cost += 1
                where.append(at[0])
            for deeper in [x for x in heads if x > depth]:
                del heads[deeper]
            if s[0] in self.led and heads.get(depth) not in self.led[s[0]] and not bad:
                cost += 1
                where.append(at[0])
            elif heads.get(depth) == self.attempt and s[0] not in self.led:
                cost += 1
                where.append(at[0])
            heads[depth] = s[0]
            opens = s[-1] == ":" and s[0] in self.heads
            c, e = self.segment(s, ("LINE",))
            if c and s[0] == self.words.get("match"):
                c, e = self.segment("i" + s[1:], ("LINE",))
            if c and s[0] == self.words.get("case"):
                c, e = self.segment("i" + s[1:], ("LINE",))
            cost += c
            where.extend(at[min(p, len(at) - 1)] for p in e)

        places: list[int] = []
        for c, at in zip(self.lex(text, places), places):
            if c == "\n":
                if len(stack) == 1:
                    end_line()
                continue
            if c in "([{":
                stack.append(_Frame(c, at))
            elif c in ")]}":
                if stack[-1].kind != _CLOSES[c]:
                    cost += 1
                    where.append(at)
                    if not any(f.kind == _CLOSES[c] for f in stack):
                        continue
                    while stack[-1].kind != _CLOSES[c]:
                        lost = stack.pop()
                        stack[-1].chars.append(_GROUP[lost.kind])
                        stack[-1].at.append(lost.line)
                frame = stack.pop()
                k, e = self.check(frame.kind, "".join(frame.chars))
                cost += k
                where.extend(frame.at[min(p, len(frame.at) - 1)] if frame.at else at for p in e)
                stack[-1].chars.append(_GROUP[frame.kind])
                stack[-1].at.append(frame.line)
            else:
                stack[-1].chars.append(c)
                stack[-1].at.append(at)
        while len(stack) > 1:
            lost = stack.pop()
            cost += 1
            where.append(n)
            stack[-1].chars.append(_GROUP[lost.kind])
            stack[-1].at.append(lost.line)
        end_line()
        if opens or self.attempt in heads.values():
            cost += 1
            where.append(n)
        return cost, where


# ---- languages of lines ----------------------------------------------------

_SHELL_TOKEN = re.compile(
    r"(\\[\s\S])|('[^']*')|(\"(?:[^\"\\$`]|\\[\s\S]|\$\((?:[^()]|\([^()]*\))*\)|\$\{[^}]*\}|\$|`[^`]*`)*\")|(\$\(\()|(\$\()|(\$\{(?:[^{}]|\$\{[^}]*\})*\})|((?:\$[\w@*#?!$\-]|[\w@%+\-.,/:=*?!~^\[\]])+|\$)|(\#)|(<<<|<<-?|>>|[<>]&|&>|<\(|>\(|;;&?|&&|\|\||\(\(|[;&|()<>{}\n])|([ \t\r]+)|([\s\S])"
)
_HEREDOC = re.compile(r"[ \t]*([\"']?)\\?(\w+)\1")
_SHELL_OPEN = {"if": "fi", "for": "done", "while": "done", "until": "done", "select": "done", "case": "esac", "{": "}"}
_SHELL_MID = {"then": "if", "elif": "if", "else": "if", "do": "done"}


def repair_shell(text: str) -> tuple[int, list[int]]:
    """Quotes, substitutions, compound commands and operators of a script."""
    cost, where = 0, []
    stack: list[tuple[str, int]] = []
    at, n = 0, len(text)
    command = True  # the next word is a command's
    pending: list[str] = []
    last = "\n"

    def fault(p: int) -> None:
        nonlocal cost
        cost += 1
        where.append(p)

    while at < n:
        m = _SHELL_TOKEN.match(text, at)
        t, k = m.group(), m.lastindex
        start = at
        at = m.end()
        if k == 10:
            continue
        if k == 8:
            if start == 0 or text[start - 1] in " \t\n;(":
                end = text.find("\n", start)
                at = n if end < 0 else end
            continue
        if k == 11:
            fault(start)
            if t in "\"'`":
                return cost, where  # the rest stands in an open quote
            continue
        if k == 4:
            end = text.find("))", at)
            if end < 0:
                fault(n)
                return cost, where
            at, command, last = end + 2, False, "w"
            continue
        if k == 5:
            stack.append(("$(", start))
            command, last = True, "$("
            continue
        if k == 9:
            if t == "\n":
                for word in pending:
                    end = re.compile(rf"^\t*{re.escape(word)}[ \t\r]*$", re.M).search(text, at)
                    if not end:
                        fault(n)
                        return cost, where
                    at = end.end()
                pending = []
                if last in ("<", ">", "<<"):
                    fault(start)
                command = True
                if last not in ("&&", "||", "|"):
                    last = "\n"
                continue
            if t in ("<<", "<<-"):
                h = _HEREDOC.match(text, at)
                if h:
                    pending.append(h.group(2))
                    at, last = h.end(), "w"
                else:
                    fault(start)
                continue
            if t in ("(", "<(", ">("):
                if t == "(" and last == "w" and text[start : start + 2] == "()":
                    at, command, last = start + 2, True, "()"
                    continue
                if t == "(" and last == "w" and not (start and text[start - 1] == "="):
                    if not any(f == "case" for f, _ in stack):
                        fault(start)
                stack.append(("(", start))
                command, last = True, "("
                continue
            if t == "((":
                end = text.find("))", at)
                if end < 0:
                    fault(n)
                    return cost, where
                at, command, last = end + 2, False, "w"
                continue
            if t == ")":
                if stack and stack[-1][0] in ("(", "$("):
                    stack.pop()
                    command, last = False, "w"
                elif any(f == "case" for f, _ in stack):
                    command, last = True, "\n"
                else:
                    fault(start)
                continue
            if t in (";", "&", "&&", "||", "|", ";;", ";;&"):
                if last in ("\n", ";", "&&", "||", "|", "<", ">", "(", "$(") and not (t.startswith(";;") and last in ("\n", ";")) and not any(f == "case" for f, _ in stack):
                    fault(start)
                command, last = True, t
                continue
            if t in ("<", ">", ">>", "<&", ">&", "&>", "<<<"):
                if last in ("<", ">", "<<"):
                    fault(start)
                last = "<<" if t == "<<<" else t[0] if t[0] in "<>" else ">"
                continue
            if t == "{":
                if command:
                    stack.append(("{", start))
                    last = "{"
                else:
                    last = "w"
                continue
            if t == "}":
                if command and last in ("\n", ";", "{", "w", "&"):
                    if stack and stack[-1][0] == "{":
                        stack.pop()
                    else:
                        fault(start)
                    command = False
                last = "w"
                continue
        if command and t in _SHELL_OPEN and t != "{":
            stack.append((t, start))
            command, last = t in ("if", "while", "until"), "\n" if t in ("if", "while", "until") else "w"
            continue
        if command and t in ("then", "else", "elif", "do"):
            own = stack[-1][0] if stack else ""
            if own not in (("if",) if t != "do" else ("for", "while", "until", "select")):
                fault(start)
            command, last = True, "\n"
            continue
        if command and t in ("fi", "done", "esac"):
            own = stack[-1][0] if stack else ""
            if _SHELL_OPEN.get(own) == t:
                stack.pop()
            else:
                fault(start)
            command, last = False, "w"
            continue
        if t in ("function", "!", "time") and command:
            last = "\n"
            continue
        if not (re.match(r"\w+\+?=", t) and command):
            command = False
        last = "w"
    for _ in stack:
        fault(n)
    if last in ("&&", "||", "|", "<", ">", "<<"):
        fault(n)
    return cost, where


_YAML_KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\"'\[\]{},&*!|>%@`\-?:][^#\n]*?|[-?:](?=\S)[^#\n]*?)\s*:(?=\s|$)")
_YAML_PLAIN_BAD = re.compile(r"^[`@%&*!]|^[\"']|: |:$| #$")
_SCALAR_OK = re.compile(r"^(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')\s*(?:#.*)?$")


def _flow_open(s: str) -> int | None:
    """Depth of open flow brackets at the end; None where one closes too many or a quote stays open."""
    depth, k, n = 0, 0, len(s)
    while k < n:
        c = s[k]
        if c in "\"'":
            end = k + 1
            while end < n and s[end] != c:
                end += 2 if s[end] == "\\" and c == '"' else 1
            if end >= n:
                return None
            k = end
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth < 0:
                return None
        elif c == "#" and k and s[k - 1] == " ":
            break
        k += 1
    return depth


def repair_yaml(text: str) -> tuple[int, list[int]]:
    """Lines as entries of nested mappings and sequences."""
    cost, where = 0, []
    stack: list[tuple[int, str]] = []  # indent, kind: map, seq, scalar
    at = 0
    block = -1  # indent of the owner of a block scalar
    flow = 0
    quote = ""
    can_nest = True  # the last entry has no value yet
    plain_from = -1  # the indent above which a plain scalar may go on
    lines = text.split("\n")

    def fault() -> None:
        nonlocal cost
        cost += 1
        where.append(at)

    def value(v: str, owner: int) -> None:
        nonlocal block, flow, quote, can_nest, plain_from
        v = v.strip()
        can_nest, plain_from = False, -1
        v = re.sub(r"^(?:[&!][^\s,\[\]{}]*\s+)+", "", v)
        if re.fullmatch(r"[&!][^\s]*", v):
            v = ""
        if not v or v[0] == "#":
            can_nest = True
        elif re.fullmatch(r"[|>][-+\d]*\s*(?:#.*)?", v):
            block = owner
        elif v[0] in "[{":
            depth = _flow_open(v)
            if depth is None:
                fault()
            else:
                flow = depth
        elif v[0] in "\"'":
            if not _SCALAR_OK.match(v):
                if _closed(v):
                    fault()
                else:
                    quote = v[0]
        elif v[0] == "*":
            pass
        elif _YAML_PLAIN_BAD.search(re.sub(r"\s#.*$", "", v)) or v[0] in "|>]},":
            fault()
        else:
            plain_from = owner

    for raw in lines:
        line = raw.rstrip("\r").lstrip("﻿") if at == 0 else raw.rstrip("\r")
        begin = at
        body = line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if quote:
            if _ends_quote(body, quote):
                quote = ""
        elif flow:
            d = _flow_open(body)
            flow = flow + d if d is not None else _flow_more(body, flow)
            if flow < 0:
                fault()
                flow = 0
        elif not body or body[0] == "#" or body in ("---", "...") and indent == 0 or body.startswith("--- ") and indent == 0:
            if body[:3] in ("---", "..."):
                stack, can_nest, block, plain_from = [], True, -1, -1
        elif block >= 0 and indent > block or block == -2 and indent > 0:
            pass
        elif body[0] == "%" and indent == 0 and not stack:
            pass
        else:
            block = -1
            if line[indent : indent + 1] == "\t":
                fault()
            rest, col = body, indent
            while rest:
                seq = rest == "-" or rest.startswith("- ")
                key = None if seq else _YAML_KEY.match(rest)
                kind = "seq" if seq else "map" if key else "scalar"
                if kind == "scalar" and plain_from >= -1 and (plain_from != -1 and col > plain_from):
                    if _YAML_PLAIN_BAD.search(re.sub(r"\s#.*$", "", rest)) and not rest[0] in "`@%&*!\"'":
                        fault()
                    break
                if kind == "map" and plain_from != -1 and col > plain_from and not can_nest:
                    fault()  # a mapping within a plain scalar
                    break
                while stack and stack[-1][0] > col:
                    stack.pop()
                if stack and stack[-1][0] == col:
                    same = stack[-1][1] == kind
                    if not same and kind == "map" and stack[-1][1] == "seq" and len(stack) > 1 and stack[-2] == (col, "map"):
                        stack.pop()
                        same = True
                    if not same and kind == "seq" and stack[-1][1] == "map" and can_nest:
                        stack.append((col, "seq"))
                        same = True
                    if not same:
                        fault()
                        break
                else:
                    if stack and not can_nest:
                        fault()
                        break
                    if stack and stack[-1][0] < col or not stack:
                        stack.append((col, kind))
                    if not stack or kind == "scalar" and len(stack) == 1 and len(body.split()) > 1 and body[0] not in "\"'[{|>":
                        fault()  # a document of bare text where entries should stand
                        stack = [(col, "scalar")] if stack else stack
                        break
                if seq:
                    inner = rest[1:].lstrip(" ")
                    col += len(rest) - len(inner)
                    rest = inner
                    can_nest, plain_from = True, -1
                    if not rest or rest[0] == "#":
                        break
                    if not (rest == "-" or rest.startswith("- ") or _YAML_KEY.match(rest)):
                        value(rest, col - 2 if col >= 2 else 0)
                        break
                    continue
                if key:
                    value(rest[key.end() :], col)
                    if rest.startswith("? "):
                        can_nest = True
                    break
                value(rest, col - 1)
                break
        at = begin + len(raw) + 1
    if quote or flow:
        at = len(text)
        fault()
    elif stack and stack[-1][1] == "scalar" and len(stack) > 1:
        at = len(text)
        fault()
    return cost, where


def _closed(v: str) -> bool:
    q, k = v[0], 1
    while k < len(v):
        if v[k] == "\\" and q == '"':
            k += 2
            continue
        if v[k] == q:
            if q == "'" and v[k + 1 : k + 2] == "'":
                k += 2
                continue
            return True
        k += 1
    return False


def _ends_quote(body: str, q: str) -> bool:
    return bool(re.search(r"(?<!\\)\"\s*(?:#.*)?$" if q == '"' else r"'\s*(?:#.*)?$", body))


def _flow_more(body: str, flow: int) -> int:
    depth = flow
    for c in re.sub(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'", "", body):
        depth += (c in "[{") - (c in "]}")
        if depth < 0:
            return -1
    return depth


# ---- files -------------------------------------------------------------------


@functools.lru_cache(maxsize=None)
def _parser(lang: str, whole: bool = True):
    if lang == "python":
        return Python(whole).repair
    if lang == "shell":
        return repair_shell
    if lang == "yaml":
        return repair_yaml
    return Bracketed(lang, whole).repair if lang in GRAMMARS else None


def sound(lang: str, text: str) -> bool | None:
    """What this machine's own parser says of a text whose repair costs something; None if it has none."""
    if lang == "json":
        try:
            json.loads(text.lstrip("﻿"))
        except (ValueError, RecursionError):
            return False
        return True
    if lang == "python":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
        return True
    return None


def breaks(lang: str, text: str) -> bool:
    """Whether ``diagnose`` gives a cost, without working out how much."""
    parse = _parser(lang, whole=False)
    return parse is not None and bool(text.strip("﻿ \t\r\n")) and parse(text)[0] > 0 and not sound(lang, text)


def diagnose(lang: str, text: str) -> tuple[int, str | None, int]:
    """Repair cost of a text, what broke it, and the line of the first edit (0 without one)."""
    parse = _parser(lang)
    if parse is None or not text or not text.strip("﻿ \t\r\n"):
        return 0, None, 0
    cost, where = parse(text)
    if not cost or sound(lang, text):
        return 0, None, 0
    where.sort()
    lines = text.count("\n") + 1
    breaks = [m.start() for m in re.finditer("\n", text)]
    at = [bisect.bisect_left(breaks, p) + 1 for p in where or [0]]
    marks = {bisect.bisect_left(breaks, m.start()) + 1 for m in _MARKER.finditer(text)}
    if marks and any({a - 1, a, a + 1} & marks for a in at):
        kind = CONFLICT
    elif all(a >= lines - 1 for a in at):
        kind = TRUNCATED
    elif len(set(at)) >= 3 or len(set(at)) * 4 >= lines:
        kind = MISMATCH
    else:
        kind = OTHER
    return cost, kind, at[0]


def repairs(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "content", language: str = "language") -> DataFrame:
    """``key, repository, language, cost, cause, line`` of every file; cost 0 means it parses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = [language_of(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            got = [diagnose(lang, x or "") for lang, x in zip(langs, batch.column(3).to_pylist())]
            repo = [(p or "").split("/", 1)[0] for p in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array(repo), pa.array(langs), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "repository", "language", "cost", "cause", "line"])

    kind = files.schema[key].dataType.simpleString()
    return (
        files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(language).alias("language"), F.col(text).alias("text"))
        .mapInArrow(run, f"key {kind}, repository string, language string, cost int, cause string, line int")
        .withColumnRenamed("key", key)
    )


def broken(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "content", language: str = "language") -> DataFrame:
    """``key`` of every file whose repair costs something, as often as ``files`` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([breaks(language_of(b, a), x or "") for a, b, x in rows], pa.bool_()))], names=["key"])

    kind = files.schema[key].dataType.simpleString()
    return (
        files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(language).alias("language"), F.col(text).alias("text"))
        .mapInArrow(run, f"key {kind}")
        .withColumnRenamed("key", key)
    )


def rates(found: DataFrame, key: str = "file_id") -> DataFrame:
    """Files and broken files per repository and language."""
    return (
        found.dropDuplicates([key])
        .groupBy("repository", "language")
        .agg(F.count("*").alias("files"), F.sum((F.col("cost") > 0).cast("long")).alias("broken"))
        .withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
    )
