"""Find credentials in source text and take them out.

Quoted strings and long tokens are candidates. Each is held against a Shannon
entropy threshold: a share of what a random string of its alphabet and length
has on average. In a telling context (a name such as ``api_key``, a URL's user
part, an Authorization header, a note about a password) a smaller share is
enough; a long token that stands alone needs nearly all of it. Known formats
and private keys need none. Hashes, ids, identifiers, references, addresses,
embedded data and placeholders are left out.

Defined cases: null or empty text holds nothing; a key of several lines counts
at its first line; a line counts once whatever it holds; repeated rows give a
result each (queries drop them); columns besides key and text are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Formats that issuers publish for their tokens (fixed values).
KNOWN = re.compile(
    r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b"
    r"|\bAIza[\w\-]{30,}"
    r"|\bgh[opsur]_[A-Za-z0-9]{30,}"
    r"|\bglpat-[\w\-]{18,}"
    r"|\bxox[abprs]-[\w\-]{20,}"
    r"|\b[sr]k_live_[A-Za-z0-9]{16,}"
    r"|\bnpm_[A-Za-z0-9]{30,}"
    r"|\bSG\.[\w\-]{16,}\.[\w\-]{16,}"
    r"|\beyJ[\w\-]{8,}\.eyJ[\w\-]{4,}\.[\w\-]{8,}"
)
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_BODY = re.compile(r"(?:\\r|\\n|[\s\"'+,\\#*/;`|>])*(?:(?:Proc-Type|DEK-Info|Version)[^\n]*\s+)*([A-Za-z0-9+/=]{16,})")
_BODY_NEXT = re.compile(r"[ \t\"'+,;)]*(?:\\r|\\n|\r?\n)(?:\\r|\\n|[\s\"'#*;`|>])*([A-Za-z0-9+/=]+)(?![^\s\"'\\+,;)`])")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

#: Words that tell of a credential, in the languages of the corpus (fixed values).
TELLING = (
    r"pass(?:wor[dt]|wd|phrase|code)?|pwd|secret|token|api[_\-.]?key|access[_\-.]?key|encryption[_\-.]?key|signing[_\-.]?key"
    r"|private[_\-.]?key|auth[_\-.]?key|master[_\-.]?key|credential|auth[_\-.]?token|bearer|kennwort|passwort|пароль|токен|ключ доступа"
    r"|mot de passe|senha|contraseña|密码|口令|パスワード"
)
#: How the formats of KNOWN begin; as much of it as a rule asks of one string of a joined token.
_BEGINS = ("AKIA", "ASIA", "AIza", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "glpa", "xox", "sk_l", "rk_l", "npm_", "SG.", "eyJ")
#: A cheap look that every line with a credential passes: what the rules below can't match without.
LOOK = re.compile(
    rf"(?i){TELLING}|key|login|log in|identified|\bbasic\s|[?&;](?:sig|signature|auth)=|\s-u|--user|://[^\s/@:\"'`<>]*:[^\s/@\"'`]+@"
    rf"|(?-i:{'|'.join(map(re.escape, _BEGINS))})"
)
#: What every match of LOOK has part of, in lower case but for _BEGINS.
_STEMS = (
    "pass", "pwd", "secret", "token", "key", "credential", "bearer", "kennwort", "пароль", "токен", "ключ доступа", "senha", "contraseña", "密码", "口令", "パスワード",
    "login", "log in", "identified", "basic", "sig=", "signature=", "auth=", "-u", "://",
)
#: Letters that case-blind rules take for an ASCII one; after this, lower case has the text's length.
_FOLD = {0x17F: "s", 0x130: "i", 0x131: "i", 0x212A: "k"}
_NAMED = re.compile(
    rf"(?i)(?P<key>[A-Za-z_$][\w.\-]{{0,60}})[\"'\]]{{0,2}}\s{{0,4}}(?::\s{{0,2}}[A-Za-z][\w.<>\[\]*|]{{0,24}}\s{{0,2}}(?==)|\[\d{{0,5}}\]\s{{0,2}}(?==))?"
    rf"(?::=|=>|=|:|,|\s)\s{{0,4}}(?:[rbuf@$]{{0,2}}(?P<q>[\"'`])|(?P<bare>[^\s\"'`,;(){{}}\[\]<>]{{6}}))"
)
#: Characters of a bare value that decide whether it is a credential.
JUDGED = 200
#: The value of _NAMED from its place on; read to its end only after a telling name.
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_QUOTED = {q: re.compile(rf"(?:\\.|[^\\{q}])*(?={q})") for q in "\"'`"}
_TO_QUOTE = {q: re.compile(rf"[^{q}]*(?={q})") for q in _QUOTED}
_KEY = re.compile(rf"(?i)(?:{TELLING})")
#: Names that speak about a credential without holding one.
_ABOUT = re.compile(r"(?i)(?:hint|column|name|kind|type|policy|template|ref|label|url|uri|file|path|field|prompt|format|regex|pattern|length|count|limit|expiry|ttl|public)s?\d{0,3}$")
_URL = re.compile(r"[a-z][a-z0-9+.\-]{1,20}://(?P<user>[^\s/@:\"'`<>]*):(?P<pass>[^\s/@\"'`]{2,})@[\w\[]")
_QUERY = re.compile(r"(?i)[?&;](?:access_?token|api_?key|auth_?token|token|key|sig|signature|secret|password|pass|pwd|auth|client_secret)=(?P<v>[^\s&\"'`;<>#]{6,})")
_HEADER = re.compile(r"(?i)\b(?:(?P<b>basic)|bearer|token|apikey)\s{1,3}(?P<v>[A-Za-z0-9+/=_.\-~]{8,})")
_PAIR = re.compile(r"(?i)\b(?:password|passwd|pwd|pass|accountkey|sharedaccesskey|secret)\s?=\s?(?P<v>[^\s;\"'`&]{4,})")
_CURL = re.compile(r"(?:\s-u|--user)[\s=]{1,3}[\"']?[\w.\-]{1,40}:(?P<v>[^\s\"'`@]{4,})")
_SQL = re.compile(r"(?i)\b(?:identified\s+by|password|as)\s+'(?P<v>[^']{4,})'")
#: What else a line says in which the value of _SQL is a credential; ``as`` alone names a column.
_SQL_WITH = re.compile(rf"(?i){TELLING}|key|login|identified")
_NOTE = re.compile(rf"(?i)(?:{TELLING}|\blogin\b|\blog in\b)[^\n]{{0,40}}?(?:[\s:=/\"'`(]|：)(?P<v>[A-Za-z0-9!@#$%^&*_+/=.\-~]{{8,}})")
_SQL_ROW = re.compile(r"(?i)'[\w.\-]*(?:token|secret|password|passwd|api_?key|credential)[\w.\-]*'\s*,\s*'(?P<v>[^']{6,})'")
_JOINS = re.compile(r"(?<=[A-Za-z0-9+/=_\-])([\"'])\s{0,4}[+.]?\s{0,4}\1(?=[A-Za-z0-9+/=_\-])")

_PLACE = re.compile(
    r"(?i)^(?:x{3,}|\*{2,}|\.{2,}|-+|_+|0+|1234\w*|abc123\w*)$|change.?me|your.?|example|placeholder|dummy|redacted|todo\b|fixme|not.?set|^(?:none|null|nil|undefined|true|false|empty|unset|password|passwd|secret|token|apikey|test|admin|root|user|foo|bar)$"
    r"|insert.?here|<[^>]*>|^\$|\$\{|\{\{|%\(|%s|\{[\w.\-:]*\}|^%\w+%$|^@|vault:|^arn:|^ssm:|^env[:.(]|^process\.env|^os\.(?:environ|getenv|Getenv)|getenv|^System\."
)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_HEX = re.compile(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
_IDENT = re.compile(r"^[A-Za-z]+(?:[_.\-/:][A-Za-z]+)*$|^[a-z]+(?:[A-Z][a-z]+)+$|^[A-Za-z][\w.]*\($")
_WORDS_NUM = re.compile(r"^(?:[A-Za-z]{3,}[._\-!@#$%^&*+~]?)+\d{2,}\w{0,2}[!?.]?$")
#: What a random string of an alphabet reaches on average is ``expected``; a credential must reach this share of it:
#: in a telling context, and where nothing around it tells.
TOLD, ALONE = 0.70, 0.93
#: Characters of each alphabet.
_SIZES = {"hex": 16, "base64": 64}
#: Long tokens, which are candidates wherever they stand, quoted or bare.
_TOKEN = re.compile(r"(?<![\w+/=.\-~$@%&#:\\])[A-Za-z0-9+/_\-=.~]{20,}(?![\w+/=\-~(\[{:$@%&#\\])")
#: Names and prefixes of values that are random and no secret: hashes, ids, public parts, data (fixed values).
_OPEN = re.compile(
    r"(?i)(?:integrity|checksum|hash|digest|sha\d*|md5|crc|etag|commit|revision|rev|uuid|guid|request|trace|span|correlation|build|nonce|fingerprint|public|cert\w*|ssh-\w+|signature|icon|image|data|base64|font|sprite|seed|version|\bid|_id)"
    r"[\w\-]*[\"'\])]{0,2}\s{0,4}(?::=|=>|=|:|,|\s)\s{0,4}[rbuf@$]{0,2}[\"'`]?$|sha\d+[-:=]$|;base64,$|://\S*$"
)
_WORD = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
_BASE64_LINE = re.compile(r"[\s\"'`,+;)(\\n]*[A-Za-z0-9+/=_\-]{16,}[\s\"'`,+;)(\\n]*")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


@functools.lru_cache(maxsize=4096)
def expected(n: int, size: int) -> float:
    """Mean entropy of ``n`` random characters of an alphabet of ``size``: a short string can't reach its alphabet's."""
    if n < 2:
        return 0.0
    total, p = 0.0, 1 / size
    chance = n * p * (1 - p) ** (n - 1)  # of a character that is there once, then twice, ...
    for k in range(1, min(n, 16 + 4 * n // size) + 1):
        total += chance * k * math.log2(k)
        chance *= (n - k) / (k + 1) * p / (1 - p)
    return math.log2(n) - size * total / n


def threshold(s: str, share: float = TOLD) -> float:
    """Least entropy of a secret in ``s``'s alphabet and of its length."""
    return share * expected(len(s), _SIZES["hex" if _HEX.match(s) else "base64"])


def alone(v: str, before: str) -> bool:
    """Whether a long token is a credential though nothing around it tells: its entropy is what random ones have, and it is no hash, id, identifier, address, data or placeholder."""
    if _HEX.match(v) or _UUID.match(v) or placeholder(v) or not (any(map(str.isdigit, v)) and any(map(str.isupper, v)) and any(map(str.islower, v))):
        return False
    if sum(map(len, _WORD.findall(v))) > 0.4 * len(v) or _OPEN.search(before):
        return False
    return entropy(v) >= threshold(v, ALONE)


def placeholder(v: str) -> bool:
    return not v or len(set(v)) <= 2 or bool(_PLACE.search(v))


def secretish(v: str, named: bool) -> bool:
    """Whether a candidate in a telling context looks like a usable credential."""
    if len(v) < 6 or placeholder(v) or _UUID.match(v) and not named:
        return False
    if " " in v.strip() or "://" in v or "(" in v:
        return False
    if _IDENT.match(v):
        # words joined by signs: only a long mix of cases without a word's shape is random
        return len(v) >= 14 and v.isalpha() and _random_case(v)
    if not any(c.isdigit() for c in v):
        return _random_case(v) and len(v) >= 12 or bool(re.search(r"[A-Za-z][!@#$%^&*+]|[!@#$%^&*+][A-Za-z]", v)) and len(v) >= 8 and entropy(v) >= threshold(v)
    if v.isdigit():
        return False
    return entropy(v) >= threshold(v)


def _random_case(v: str) -> bool:
    """Case changes too often for camel case or words."""
    letters = [c for c in v if c.isalpha()]
    turns = sum(a.isupper() != b.isupper() for a, b in zip(letters, letters[1:]))
    ups = sum(c.isupper() for c in letters)
    return len(letters) >= 8 and turns >= len(letters) / 4 and ups >= len(letters) / 5 and bool(re.search(r"[A-Z]{2,}", v))


def _decoded(v: str) -> bool:
    """A Basic header's value: base64 of ``user:password`` with a usable password."""
    import base64
    import binascii

    try:
        user, _, password = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, ValueError):
        return len(v) >= 12 and secretish(v, True)
    return bool(user and password) and not placeholder(password)


def alone_in(text: str) -> list[tuple[int, int]]:
    """Start and end of each long token that stands for a credential by its entropy.

    Several in one line are data, and so is a line of nothing else: a piece of
    something longer.
    """
    found = []
    for m in _TOKEN.finditer(text):
        v = m.group().rstrip(".-")
        begin = text.rfind("\n", 0, m.start()) + 1
        if alone(v, text[max(begin, m.start() - 80) : m.start()]):
            found.append((begin, m.start(), m.start() + len(v)))
    out = []
    for k, (begin, a, b) in enumerate(found):
        if k and found[k - 1][0] == begin or k + 1 < len(found) and found[k + 1][0] == begin:
            continue
        end = text.find("\n", b)
        end = len(text) if end < 0 else end
        if not _BASE64_LINE.fullmatch(text, begin, end):
            out.append((a, b))
    return out


def line_spans(line: str) -> list[tuple[int, int]]:
    """Start and end of each credential in a line, but for private keys."""
    spans = [m.span() for m in KNOWN.finditer(line) if not placeholder(m.group())]
    joined = _JOINS.sub("", line) if _JOINS.search(line) else line
    if joined is not line:
        for m in KNOWN.finditer(joined):
            at = line.find(m.group()[:4])
            if at >= 0 and not placeholder(m.group()):
                spans.append((at, at + len(m.group()) + len(line) - len(joined)))
    for m in _URL.finditer(line):
        if not placeholder(m["pass"]) and not m["pass"].startswith(("$", "{", "<", "%")):
            spans.append(m.span("pass"))
    for m in _QUERY.finditer(line):
        if len(m["v"]) >= 12 and secretish(m["v"], True):
            spans.append(m.span("v"))
    for m in _HEADER.finditer(line):
        if _decoded(m["v"]) if m["b"] else len(m["v"]) >= 16 and secretish(m["v"], True):
            spans.append(m.span("v"))
    for m in _PAIR.finditer(line):
        if m["v"].strip("*") and not placeholder(m["v"]) and (secretish(m["v"], True) or ";" in line and "=" in line[: m.start()]):
            spans.append(m.span("v"))
    for rule in (_CURL, _SQL):
        if rule is _SQL and not _SQL_WITH.search(line):
            continue
        spans += [m.span("v") for m in rule.finditer(line) if not placeholder(m["v"]) and (rule is _CURL or secretish(m["v"], True))]
    spans += [m.span("v") for m in _SQL_ROW.finditer(line) if secretish(m["v"], True)]
    at = taken = 0
    while m := _NAMED.search(line, at):
        at = m.start() + 1 if m.end() == m.start() else max(m.start() + len(m["key"]), m.start() + 1)
        if _KEY.search(m["key"]) and not _ABOUT.search(m["key"]):
            if m["q"] is None and not re.search(r"[=:]\s{0,4}$", line[: m.start("bare")]):
                continue
            if m["q"]:
                # a backslash may be the last character
                value = _QUOTED[m["q"]].match(line, m.end("q")) or _TO_QUOTE[m["q"]].match(line, m.end("q"))
            elif m.start("bare") < taken:
                continue
            else:
                value = _BARE.match(line, m.start("bare"))
            if not value or PRIVATE.search(value.group()):
                continue
            # the head of a long bare value decides, the whole of it is taken
            v = value.group() if m["q"] else value.group()[:JUDGED]
            if secretish(v.strip(), True) and not (m["q"] is None and _IDENT.match(v)):
                spans.append(value.span())
                taken = value.end() if m["q"] is None else taken
    for m in _NOTE.finditer(line):
        v = m["v"].rstrip(".,;:)")
        if not spans and _free(v, line, m):
            spans.append((m.start("v"), m.start("v") + len(v)))
    return _merge(spans)


def _free(v: str, line: str, m: re.Match) -> bool:
    """A token in running text after a telling word."""
    if m.end("v") < len(line) and line[m.end("v")] in "([{":
        return False
    before = line[: m.start("v")]
    # the telling word is letters within one run of base64
    run = re.search(r"[A-Za-z0-9+/=]{16,}$", before[-64:])
    if run and all(re.search(c, run.group()) for c in ("[a-z]", "[A-Z]", "[0-9]")):
        return False
    if re.search(r"[\w)\]]\s*(?::=|==|!=|=)\s*$", before) and not re.search(rf"(?i)(?:{TELLING})\s*=\s*$", before):
        return False
    note = re.match(r"\s*(?://|#|/\*|\*|--|<!--|;|rem\b|>|-\s)", line, re.I) or not re.search(r"[;{}=]", line)
    if not note or _ABOUT.search(re.split(r"[\s:=]", before.strip())[-1] if before.strip() else ""):
        return False
    if re.match(r"^[\w.\-]+\.[a-z]{2,4}$|^v?\d+(\.\d+)+$|^\w+[_\-]\d{1,3}$", v) or "/" in v and not any(c.isdigit() for c in v):
        return False
    return len(v) >= 8 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and secretish(v, True)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _candidate_lines(text: str) -> set[int]:
    """Where the lines begin that hold one of LOOK's stems; plain searches are the fast ones."""
    starts = set()
    low = (text if text.isascii() else text.translate(_FOLD)).lower()
    for where, stems in ((low, _STEMS), (text, _BEGINS)):
        for stem in stems:
            at = where.find(stem)
            while at >= 0:
                starts.add(text.rfind("\n", 0, at) + 1)
                end = text.find("\n", at)
                if end < 0:
                    break
                at = where.find(stem, end)
    return starts


def _body_end(text: str, body: re.Match) -> int:
    """Where the last line ends that is still body of a key without an END line: lines as long as the first, then a shorter one."""
    at, width = body.end(1), len(body.group(1))
    while m := _BODY_NEXT.match(text, at):
        size = len(m.group(1))
        last = size < width
        rest = text[m.end(1) :].strip(" \t\r\n\"'") if last and m.end(1) + 64 > len(text) else "more"
        if size > width or last and rest and not (size % 4 == 0 and re.search(r"[0-9+/=]", m.group(1))):
            break
        at = m.end(1)
        if last:
            break
    return at


def find_in(text: str) -> list[tuple[int, int, int]]:
    """``line_no, start, end`` of every credential of a text, in order."""
    found: list[tuple[int, int, int]] = []
    keys: list[tuple[int, int]] = []
    if "PRIVATE KEY" in text:
        for m in PRIVATE.finditer(text):
            body = PRIVATE_BODY.match(text, m.end())
            if body and entropy(body.group(1)) > 3.0:
                end = PRIVATE_END.search(text, m.end())
                if end and PRIVATE.search(text, m.end(), end.start()):
                    end = None
                stop = end.start() if end else _body_end(text, body)
                keys.append((m.start(), stop))
                found.append((text.count("\n", 0, m.start()) + 1, body.start(1), stop))
    number, counted = 1, 0
    for start in sorted(_candidate_lines(text)):
        end = text.find("\n", start)
        line = text[start : len(text) if end < 0 else end]
        if not LOOK.search(line) or any(a <= start < b for a, b in keys):
            continue
        number += text.count("\n", counted, start)
        counted = start
        found += [(number, start + a, start + b) for a, b in line_spans(line) if not any(x <= start + a < y for x, y in keys)]
    taken = [(a, b) for _, a, b in found] + keys
    for a, b in alone_in(text):
        if not any(x < b and a < y for x, y in taken):
            found.append((text.count("\n", 0, a) + 1, a, b))
    return sorted(set(found))


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "REDACTED") -> str:
    """The text with each credential's characters replaced by ``mark``.

    Quotes, escapes at the ends and line breaks around it stay, so strings and
    blocks stay closed; a multi-line key keeps its number of lines.
    """
    out, at = [], 0
    for _, a, b in found:
        if a < at:
            continue
        inside = text[a:b]
        kept = re.sub(r"[A-Za-z0-9+/=]{16,}", mark, inside) if "\n" in inside or "\\n" in inside else mark
        out += [text[at:a], kept]
        at = b
    return "".join([*out, text[at:]])


def find_credentials(texts: DataFrame, keys: list[str], text: str, redacted: bool = False) -> DataFrame:
    """A row per line with a credential: ``keys, line_no``; or per text, with ``redacted``."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines, clean = [], [], []
            for i, value in enumerate(batch.column(n).to_pylist()):
                if found := find_in(value):
                    if redacted:
                        at.append(i)
                        clean.append(redact(value, found))
                        lines.append(len({x[0] for x in found}))
                    else:
                        own = sorted({x[0] for x in found})
                        at += [i] * len(own)
                        lines += own
            took = batch.select(list(range(n))).take(pa.array(at, pa.int64()))
            cols, names = [*took.columns, pa.array(lines, pa.int32())], [*keys, "credentials" if redacted else "line_no"]
            if redacted:
                cols, names = [*cols, pa.array(clean, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = [f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, *(["credentials int", "redacted string"] if redacted else ["line_no int"])])
    return texts.where(F.length(text) > 0).select(*keys, text).mapInArrow(run, schema)
