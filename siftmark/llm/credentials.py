"""Credentials in source code and configuration: found with key path and byte offsets, redacted in place.

Configuration (JSON, YAML, XML, properties, env, INI, TOML, HCL) is parsed into key paths
and values with offsets (``keypaths``). A value is a credential if the path names
something secret - its last part, or the part above a neutral last one such as ``value``
or a place in a list - and the shape of the value is that of a literal rather than a
reference, a placeholder, a mask or a label. What no parser covers is read line by line:
assignments and calls of code, SQL, shell, docker and netrc files, URLs, headers, PEM
blocks, comments and prose; there too a value has a key and a shape, or the shape of an
issued token.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from siftmark.llm import keypaths
from siftmark.runtime import ship


class Finding(NamedTuple):
    """A credential: where its value starts and ends (bytes), on which line it starts, its key path and kind."""

    line: int
    start: int
    end: int
    key: str
    kind: str


# Names of secrets, as they end a key when letter case and separators are dropped.
SECRET_NAMES = (
    "password passwd passphrase passwort passcode pwd secret token apikey accesskey accesskeyid secretkey secretaccesskey "
    "signingkey encryptionkey masterkey privatekey deploykey accountkey sshkey hmackey sharedkey credential kennwort "
    "contrasena contraseña clave motdepasse smtppass dbpass userpass adminpass rootpass adminpw dbpw userpw rootpw "
    "connectionpassword sharedaccesskey bearer"
).split()
# Whole last words that name a secret.
SECRET_WORDS = frozenset("pass pw pin".split())
# Names of what people choose themselves, so that any word may be the value.
CHOSEN = ("password", "passwd", "passphrase", "pwd", "passwort", "kennwort", "contrasena", "contraseña", "motdepasse")
# Last parts of a key path that say nothing; the part above them counts.
NEUTRAL = frozenset("value val default content plain plaintext plain_text literal string current data text raw".split())
# Parts of a key path under which texts for people stand, and settings that are no secrets.
SHOWN = frozenset("label labels message messages msg title hint hints help placeholder prompt tooltip error errors i18n description caption translation translations".split())
SETTINGS = frozenset("required optional disabled enabled hidden prompt never always string varchar plain strong weak default manual masked inherit forbidden".split())
# Beginnings of a sentence to a person.
SPOKEN = re.compile(r"(?i)^(?:please|enter|type|your|the|a|an|must|should|is|no|not|use|see|set|invalid|wrong|bitte|saisi\w*|introdu\w*|geben)\b|[.:?!…]$")
# Public shapes of issued tokens.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{12,20}"
    r"|gh[pousr]_[A-Za-z0-9]{20,}"
    r"|github_pat_[A-Za-z0-9_]{20,}"
    r"|glpat-[A-Za-z0-9_-]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{16,}"
    r"|AIza[A-Za-z0-9_-]{30,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|npm_[A-Za-z0-9]{30,}"
    r"|pypi-[A-Za-z0-9_-]{30,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r")(?![A-Za-z0-9_])"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
# Of a key without END marker: line breaks, also escaped; lines of base64 in quotes or comments, those behind a prefix, what else stands before or between.
KEY_BREAK = re.compile(r"(?:\\+[rn])+|\r?\n|\r")
KEY_LINE = re.compile(r"""([^A-Za-z0-9+/=\r\n]*(?:(?://|[+/])[\s"'`]+)*)(={0,2}[A-Za-z0-9+/]+={0,2}(?:[ \t]+[A-Za-z0-9+/]{16,}={0,2})*(?<=[A-Za-z0-9+/=]{16})(?:[ \t]+[A-Za-z0-9+/]{1,15}={0,2})?|={0,2}[A-Za-z0-9+/]+={0,2})(?:[\s.…]*\\?\Z|(?=["'`<]))(?:["'`][\s"'`+.,;)\]\\]*\Z)?""")
KEY_RUN = re.compile(r"[^A-Za-z0-9+/=]*((?:[A-Za-z0-9+/]{40,}={0,2}[ \t]+)+(?:[A-Za-z0-9+/]+={0,2}(?![^\s\"'`<]))?)")
KEY_REST = re.compile(r"[ \t]*(={0,2}[A-Za-z0-9+/]+={0,2})[\s.…\"'`]*\Z")
KEY_LOGGED = re.compile(r"""(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{40,}={0,2})[\s.…"'`]*\Z""")
KEY_BLANK = re.compile(r"[^A-Za-z0-9]*\Z")
KEY_HEADER = re.compile(r"[^A-Za-z0-9]*[A-Za-z][A-Za-z0-9-]*: ")
# What stays readable within a key: escaped line breaks, operators and comment signs between its lines; the rest is masked.
KEY_SHOWN = re.compile(rb"""(\\[nr]|(?<![^\s"'`])(?:\+|//?)(?![^\s"'`]))|[A-Za-z0-9+/=]""")
DIGIT = re.compile(r"\d")
URL_USER = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'`<>{}$]*:([^\s/@\"'`<>]{4,})@")
PARAMETER = re.compile(r"(?i)(?:[?&;]|\b)((?:api[_-]?|access[_-]?|auth[_-]?|account|shared)?(?:key|token|secret|password|passwd|pwd|sig|signature))=([^\s&\"'`<>;,)]{6,})")
HEADER = re.compile(r"(?i)\b(bearer|basic|token)\s+([A-Za-z0-9._~+/=-]{8,})")
PAIR_CALL = re.compile(r"""(?i)(?:\bauth\s*=\s*\(|basic_?auth\(|\bauthenticate\(|\blogin\()\s*(?:u?["'][^"']*["'])\s*,\s*u?["']([^"'\s]{4,})["']\s*\)""")
CONNECT = re.compile(r"""(?i)connect(?:ion)?\(\s*["'][^"']*["']\s*,\s*["'][^"']*["']\s*,\s*["']([^"'\s]{4,})["']\s*\)""")
USER_OPTION = re.compile(r"(?:^|\s)(?:-u|--user)[ =][\"']?[^\s:\"']+:([^\s\"']{4,})")
GLUED_OPTION = re.compile(r"(?:\s-u ?[^\s-]+\s(?:.*\s)?)-p([^\s\"'=-][^\s\"']{3,})")
LONG_OPTION = re.compile(r"(?i)--([a-z][a-z-]*)[ =][\"']?([^\s\"'$<>{}`;|]{4,})")
SQL_PASSWORD = re.compile(r"(?i)\b(?:password|identified\s+by)\s+(?:=\s*)?'([^'\s]{4,})'")
NETRC = re.compile(r"(?m)^(?:.*\slogin\s+\S+)?\s*(?:password|passwd)\s+([^\s\"'=:;(){}]{4,})\s*$")
XML_TAG = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>\s*([^<>\s]{4,})\s*</\1>")
XML_ATTRIBUTE = re.compile(r"""(?s)<\w[^<>]*?\b(?:name|key|id)\s*=\s*["']([\w.:-]+)["'][^<>]*?\bvalue\s*=\s*["']([^"'\s<>]{4,})["'][^<>]*?>""")
QUOTED_PAIR = re.compile(r"""(["'])([A-Za-z_][\w.-]*)\1\s*,\s*(["'`])([^"'`\s]{4,})\3""")
CALLED = re.compile(r"""\b(\w+)\(\s*(?:\[\]byte\()?(["'`])([^"'`\s]{4,})\2\s*\)""")
ASSIGNED = re.compile(r"""([A-Za-z_@$][\w@$.-]{0,200})["'`]?\]?\)?\s*(?::\s*[\w<>\[\], |?]+?\s=(?!=)|\|\|=|\?\?=|:=|=>|=(?![=>])|:(?!:))[ \t]*""")
DEFAULTED = re.compile(r"\$\{([\w.-]+):([^\s{}\"']{4,})\}")
VALUE = re.compile(r"""(?:\[\]byte\(|(?:[brufBRUF]{1,2})(?=["'`]))?("{3}|'{3}|["'`])((?:(?!\1)[^\\\r\n]|\\.)*)\1|([^\s,"'`(){}\[\]<>][^\s,"'`(){}\[\]<>]*)""")
NAMED_ENTRY = re.compile(r"""(?m)^([ \t]*)-?[ \t]*["']?(?:name|key)["']?[ \t]*[:=][ \t]*["']?([\w.-]+)["']?[ \t]*,?\r?\n[ \t]*["']?(?:value|default)["']?[ \t]*[:=][ \t]*["']?([^\s"'#]{4,})""")
DECLARED = re.compile(r"""(?m)\bvariable\s+"([\w.-]+)"\s*\{(?:\s*(?!default\b)\w+\s*=\s*[^\n{}]*\n)*\s*default\s*=\s*"([^"\s]{4,})\"""")
CONTINUED = re.compile(r"(?m)^[ \t]*[#!]?[ \t]*([\w.-]+)[ \t]*[=:][ \t]*\\\r?\n[ \t]*(\S{4,})")
FOLDED = re.compile(r"(?m)^([ \t]*)([\w.-]+):[ \t]*[|>][-+]?[ \t]*\r?\n[ \t]+([^\s:]{4,})[ \t]*$")
JOINED = re.compile(r"""([A-Za-z_][\w.]*+)\s*[:=]=?\s*\(?\s*(["'])([^"'\s\\]+)\2((?:\s*(?:[+.\\]\s*)?(?:[+.]\s*)?(["'])[^"'\s\\]+\5)+)""")
JOINED_KEY = re.compile(r"(?<![\w.])[^A-Za-z_\W]*+(?:\.[^A-Za-z_\W]*+)*+([A-Za-z_][\w.]*+)(?=\s*[:=])")
OPERATOR = re.compile(r"\s*[:=]?")
STRING = re.compile(r"""(["'])([^"'\s\\]+)\1""")
PROSE = re.compile(r"(?i)\b(?=[a-z_]*(?:password|passwd|passphrase|pwd|secret|token|key|credential|kennwort|contrasena|motdepasse|pass|pw))([a-z_]++)\b(?:[ \t]+(?!is\b|=)[a-zA-Z]+){0,5}?(?:[ \t]+is|[ \t]*[:=])[ \t]+[`'\"]?([^\s`'\",]{6,})")
NAMED_AFTER = re.compile(r"[`'\"]([^\s`'\"]{4,})[`'\"][ \t]*\(([A-Za-z_][\w ]*)\)")
DOCKER_AUTH = re.compile(r"""["']auth["']\s*:\s*["']([A-Za-z0-9+/=]{8,})["']""")
FIELD = re.compile(r"""["']?([A-Za-z_][\w.-]*)["']?\s*:\s*("[^"]*"|'[^']*'|[^\s,{}"']+)""")
RECORD_BEFORE = re.compile(r"(\{[^{}]*\})\s*,\s*\Z")
RECORD_AFTER = re.compile(r"\s*,\s*(\{[^{}]*\})")

# What stands in a line that is read closer, in lower case.
HINTS = (
    "pass pwd pw secret token key credential kennwort contrase clave auth bearer basic login :// connect( -u --user identified sig= "
    "akia asia abia acca ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xox aiza sg. sk_live_ sk_test_ rk_live_ rk_test_ npm_ pypi- eyj"
).split()
PLACEHOLDER = re.compile(
    r"(?i)\*{3}|^x{4,}$|redacted|replace|change.?me|^to.?do|fixme|^your|[<\[(]your|^\.{2,}|^<|^\[|^\{\{|\$\{|^\$|\{\{|^%[\w(]|^@|example$|^dummy|^sample|^placeholder|^insert|^enter|^null$|^none$|^nil$|^true$|^false$|^undefined$"
)
REFERENCE = re.compile(r"(?i)^(?:env|vault|file|ref|arn|ssm|kms|secret|secrets|var|local|data|os|process|system|config|settings|self|this)[.:/]|^/(?:run|etc|var|home|opt|mnt|srv|secrets?|usr|tmp)/|^\.{0,2}/[\w.-]+/|^https?://|^sha\d+[:-]")
PLAIN = re.compile(r"^[a-zà-ÿ]+(?:[-_./: ][a-zà-ÿ]+)*[:;.,?!]?$|^[A-Z][a-zà-ÿ]+(?:[- ][A-Za-zà-ÿ]+)*[:;.,?!]?$|^[A-Z]+(?:[_-][A-Z]+)*$|^[-+]?[\d.,_:]+[a-zA-Z%]{0,2}$|^X-[A-Za-z_-]+$|^0x[0-9a-fA-F]+$")
HUMPS = re.compile(r"^[a-z]{3,}(?:[A-Z][a-z]{2,})+$|^(?:[A-Z][a-z]{2,})+$")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|\d+")


def names_secret(key: str) -> bool:
    """Whether the last part of a key path names a secret: ``db.adminPw`` and ``API_KEY`` do, ``token.limit`` and ``secretName`` don't."""
    last = re.split(r"[./:]", key.rstrip("."))[-1]
    words = WORDS.findall(last)
    if not words:
        return False
    joined = "".join(words).lower()
    return words[-1].lower() in SECRET_WORDS or joined.endswith(tuple(SECRET_NAMES)) and not joined.endswith(("publickey", "nosecret"))


def is_literal(value: str, bare: bool = False, part: bool = False) -> bool:
    """Whether a value would grant access as it stands. ``bare``: written without quotes; ``part``: the first of joined strings."""
    v = value.strip()
    if len(v) < (2 if part else 5) or any(c.isspace() for c in v):
        return False
    if PLACEHOLDER.search(v) or REFERENCE.search(v):
        return False
    if part:
        return True
    if PLAIN.match(v) or HUMPS.match(v):
        return False
    if bare and re.search(r"[(){};]|^\w+(?:\.\w+)+$|->|::|\[\d*\]", v) and not ISSUED.match(v) and not re.match(r"^(?=.*\d)(?=.*[a-zA-Z])[\w!?%.+/=-]+$", v):
        return False
    return True


def is_chosen(value: str, path: tuple[str, ...]) -> bool:
    """Whether a value may be a password that somebody chose: a word, a number or several words, unless it is meant for a reader."""
    v = value.strip()
    low = v.lower()
    if len(v) < 5 or not v.isprintable() or PLACEHOLDER.search(v) or REFERENCE.search(v) or low in SETTINGS:
        return False
    if any(w in low for w in ("pass", "secret", "token", "key", "kennwort", "contrase")) or SHOWN & {x.lower() for p in path for x in p.split(".")}:
        return False
    if " " not in v:
        return bool(re.fullmatch(r"[\w!?%.+/=@#&*~^-]+", v)) and not re.search(r"^\w+(?:\.\w+)+$|\*{3}", v)
    return len(v.split()) >= 3 and not SPOKEN.search(v)


def is_secret(path: tuple[str, ...], value: str, quoted: bool) -> bool:
    """Whether the value at a key path is a credential, by the names on the path and the shape of the value."""
    keys = [k for k in path if k]
    above = False
    while len(keys) > 1 and (keys[-1].isdigit() or keys[-1].lower() in NEUTRAL):
        keys.pop()
        above = True
    if not keys:
        return False
    last = keys[-1].rstrip("s") if above else keys[-1]
    if not names_secret(last):
        return False
    chosen = re.sub(r"[^a-zà-ÿ]", "", last.lower()).endswith(CHOSEN)
    if is_literal(value, bare=not quoted):
        return not above or chosen or is_mixed(value)
    return chosen and is_chosen(value, path)


def is_random(value: str) -> bool:
    """A value that nobody would write as a word: long, with digits among letters."""
    return len(value) >= 7 and bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value)) and not re.match(r"^[A-Z]+-\d+$|^v?\d+(\.\d+)+\w*$|^[\w.-]+\.(?:java|py|go|ts|js|md|example|test|invalid)$", value)


def is_mixed(value: str) -> bool:
    """A value that is random or at least mixes capitals and small letters as no name does."""
    return is_random(value) or len(value) >= 8 and bool(re.search(r"[a-z]", value)) and bool(re.search(r"[A-Z]", value)) and not HUMPS.match(value) and not re.match(r"^\w+(?:[.:/]\w+)+$", value)


def _basic(value: str) -> bool:
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
    except ValueError:
        return False
    user, colon, password = text.partition(":")
    return bool(colon and user.isprintable() and is_literal(password))


class _Reader:
    """Collects the values found in one text; overlapping ones merge."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int, str, str]] = []
        self.paths: dict[int, str] = {}

    def parsed(self, start: int, end: int, path: str) -> None:
        self.paths[start] = path
        self.add(start, end, path, "value")

    def add(self, start: int, end: int, key: str, kind: str) -> None:
        self.spans.append((start, end, key, kind))

    def hit(self, m: re.Match, group: int, key: str, kind: str, base: int = 0) -> None:
        self.add(base + m.start(group), base + m.end(group), key, kind)


def _parsed(text: str, r: _Reader) -> None:
    """The credentials among the key paths of a configuration text. An object with a name and a value is a key with that value."""
    named: tuple[tuple[str, ...], str] | None = None
    for item in keypaths.items(text):
        path, value = item.path, text[item.start : item.end]
        last = path[-1].lower() if path else ""
        if last in keypaths.NAMING and len(value) <= 200:
            named = (path[:-1], value)
        elif named and named[0] == path[:-1] and last in keypaths.HOLDING:
            path = (*path[:-1], named[1])
        if is_secret(path, value, item.quoted) and not _is_row(text, path[-1], item.start, item.end):
            r.parsed(item.start, item.end, ".".join(path))


def _key_end(text: str, at: int, limit: int) -> int | None:
    """Where the body of a private key without END marker ends, from ``at`` behind its BEGIN; None if there is no body.

    The body is every line of base64 that follows, however many: after headers, indented, in
    quotes or comments, behind the prefix of a log, with escaped line breaks or blanks between.
    A short line counts directly after another. Where no line is one, a run of base64 in the
    first 200 characters starts the body.
    """

    def lines(pos: int) -> Iterator[tuple[int, int]]:
        while pos < limit:
            b = KEY_BREAK.search(text, pos, limit)
            yield pos, b.start() if b else limit
            pos = b.end() if b else limit

    def follow(pos: int, end: int | None) -> int | None:
        lead, prefix, blank, step = None, None, 0, 0
        for start, stop in lines(pos):
            if KEY_BLANK.match(text, start, stop):
                blank += end is not None and not text[start:stop].strip()
                continue
            alike = end is not None and blank in (0, step)
            m = KEY_LINE.match(text, start, stop)
            if m and (len(m[2]) >= 16 or alike and lead in (None, m[1])):
                step, blank = blank if lead is not None else 0, 0
                end, lead, prefix = m.end(2), m[1], None
                if m.end() < stop:
                    break
            elif alike and prefix and DIGIT.sub("0", text[start : start + len(prefix)]) == prefix and (m := KEY_REST.match(text, start + len(prefix), stop)):
                end, blank = m.end(1), 0
            elif m := KEY_LOGGED.search(text, start, stop):
                step, blank = blank if prefix is not None else 0, 0
                end, lead, prefix = m.end(1), None, DIGIT.sub("0", text[start : m.start(1)])
            elif m := KEY_RUN.match(text, start, stop):
                return m.end(1)
            elif end is not None or start > at and not KEY_HEADER.match(text, start, stop):
                break
        return end

    end = follow(at, None)
    if end is None and (m := PEM_BODY.search(text, at, min(limit, at + 200))):
        end = max(follow(m.end(), m.end()), min(limit, at + 200))
    return end


def _whole(text: str, r: _Reader) -> None:
    """Forms that run over several lines."""
    if "PRIVATE KEY" in text:
        begins = list(PEM.finditer(text))
        starts = [m.start() for m in begins]
        ends = [m.span() for m in PEM_END.finditer(text)]
        for n, m in enumerate(begins):
            limit = starts[n + 1] if n + 1 < len(starts) else len(text)
            i = bisect_left(ends, m.end(), key=lambda e: e[0])
            if i < len(ends) and ends[i][0] < limit:
                if PEM_BODY.search(text[m.end() : ends[i][0]].replace("\\n", "\n")):
                    r.add(m.start(), ends[i][1], "", "private key")
            elif (stop := _key_end(text, m.end(), limit)) is not None:
                r.add(m.start(), stop, "", "private key")
    if "value" in text and "<" in text:
        for m in XML_ATTRIBUTE.finditer(text):
            if names_secret(m[1]) and is_literal(m[2]):
                r.hit(m, 2, m[1], "value")
    guarded = (
        ("value" in text or "default" in text, NAMED_ENTRY, 2, 3),
        ("variable " in text, DECLARED, 1, 2),
        ("\\\n" in text or "\\\r" in text, CONTINUED, 1, 2),
        (": |" in text or ": >" in text, FOLDED, 2, 3),
    )
    for worth, pattern, key, value in guarded:
        for m in pattern.finditer(text) if worth else ():
            if names_secret(m[key]) and is_literal(m[value], bare=True):
                r.hit(m, value, m[key], "value")


def _joined(text: str, start: int, end: int, r: _Reader) -> None:
    """A literal that is written as several strings, from the line ``start`` to ``end`` on."""
    at, reach = start, OPERATOR.match(text, end).end()
    while (head := JOINED_KEY.search(text, at, reach)) and head.start(1) <= end:
        m = JOINED.match(text, head.start(1))
        at = m.end() if m else head.end()
        if not m:
            continue
        parts = [(m.start(3), m.end(3)), *[(m.start(4) + s.start(2), m.start(4) + s.end(2)) for s in STRING.finditer(m[4])]]
        joined = "".join(text[a:b] for a, b in parts)
        if (names_secret(m[1]) or ISSUED.fullmatch(joined)) and is_literal(joined):
            r.add(parts[0][0], parts[-1][1], m[1], "joined")


def _fields(record: str) -> list[tuple[str, str]]:
    return [(m[1], m[2]) for m in FIELD.finditer(record)]


def _is_row(text: str, key: str, start: int, end: int) -> bool:
    """Whether a value under the mere word "token" is one of many alike in an array of records.

    So it is if at least three of the nearest eight records beside its own differ from it by
    the name of this one field only, each by another name that is none of a secret, and hold
    a value of the same length there that mixes letters as much: "token" is a name like others.
    """
    first, last = text.rfind("{", 0, start), text.find("}", end)
    if key.lower() != "token" or first < 0 or last < 0:
        return False
    beside, a, b = [], first, last + 1
    for _ in range(4):
        if a >= 0 and (m := RECORD_BEFORE.search(text, max(0, a - 2 * (last - first) - 200), a)):
            beside.append(m[1])
            a = m.start()
        else:
            a = -1
        if b >= 0 and (m := RECORD_AFTER.match(text, b)):
            beside.append(m[1])
            b = m.end()
        else:
            b = -1
    if len(beside) < 3:
        return False
    own = _fields(text[first : last + 1])
    at = [i for i, (k, v) in enumerate(own) if k == key and v.strip("\"'`") == text[start:end]]
    if not at:
        return False
    names, place, others = [k for k, _ in own], at[0], set()
    for record in beside:
        fields = _fields(record)
        if len(fields) == len(own) and [k for k, _ in fields[:place]] == names[:place] and [k for k, _ in fields[place + 1 :]] == names[place + 1 :]:
            name, value = fields[place]
            if not names_secret(name) and len(value.strip("\"'`")) == end - start and is_mixed(value.strip("\"'`")):
                others.add(name)
    return len(others) >= 3


def _line(line: str, base: int, r: _Reader, machine: bool) -> None:
    low = line.lower()
    for m in ISSUED.finditer(line):
        if not PLACEHOLDER.search(m[0]) and "EXAMPLE" not in m[0]:
            r.hit(m, 0, "", "issued", base)
    if "://" in line:
        for m in URL_USER.finditer(line):
            if is_literal(m[1]):
                r.hit(m, 1, "", "url", base)
    if "=" in line:
        for m in PARAMETER.finditer(line):
            linked = m[0][0] in "?&;" or "://" in line[: m.start()] or m[1].lower() in ("accountkey", "sharedkey")
            if linked and is_literal(m[2]) and is_random(m[2]):
                r.hit(m, 2, m[1], "url", base)
    if "bearer" in low or "basic" in low:
        for m in HEADER.finditer(line):
            kind = m[1].lower()
            if kind == "basic" and _basic(m[2]) or kind == "bearer" and is_literal(m[2]) and is_random(m[2]) and len(m[2]) >= 12:
                r.hit(m, 2, "Authorization", "header", base)
    if "auth" in low:
        for m in DOCKER_AUTH.finditer(line):
            if _basic(m[1]):
                r.hit(m, 1, "auth", "value", base)
    for worth, pattern in (("auth" in low or "login" in low, PAIR_CALL), ("connect" in low, CONNECT), ("-u" in low, USER_OPTION), (" -p" in low, GLUED_OPTION), ("'" in line, SQL_PASSWORD)):
        for m in pattern.finditer(line) if worth else ():
            if is_literal(m[1]):
                r.hit(m, 1, "password", "argument", base)
    if "pass" in low and (m := NETRC.match(line)) and (is_literal(m[1]) or machine and len(m[1]) >= 6 and not PLACEHOLDER.search(m[1]) and not PLAIN.match(m[1])):
        r.hit(m, 1, "password", "value", base)
    if "--" in line:
        for m in LONG_OPTION.finditer(line):
            if names_secret(m[1]) and is_literal(m[2], bare=True):
                r.hit(m, 2, m[1], "argument", base)
    if "</" in line:
        for m in XML_TAG.finditer(line):
            if names_secret(m[1]) and is_literal(m[2]):
                r.hit(m, 2, m[1], "value", base)
    if "," in line:
        for m in QUOTED_PAIR.finditer(line):
            if names_secret(m[2]) and is_literal(m[4]):
                r.hit(m, 4, m[2], "argument", base)
    if "(" in line:
        for m in CALLED.finditer(line):
            if names_secret(m[1]) and is_literal(m[3]) and is_mixed(m[3]):
                r.hit(m, 3, m[1], "argument", base)
    if "${" in line:
        for m in DEFAULTED.finditer(line):
            if names_secret(m[1]) and is_literal(m[2]):
                r.hit(m, 2, m[1], "value", base)
    for m in ASSIGNED.finditer(line):
        if not names_secret(m[1]):
            continue
        v = VALUE.match(line, m.end())
        if not v:
            continue
        if v[1]:
            if is_literal(v[2]) and not _is_row(r.text, m[1], base + v.start(2), base + v.end(2)):
                r.hit(v, 2, m[1], "value", base)
        elif v[3]:
            value = v[3].rstrip(";")
            rest = line[v.start(3) + len(value) :].strip()
            if is_literal(value, bare=True) and (not rest or rest[0] in "#,;}<\"'" or rest.startswith("//")):
                r.add(base + v.start(3), base + v.start(3) + len(value), m[1], "value")
    for m in NAMED_AFTER.finditer(line) if "(" in line else ():
        if names_secret(m[2].split()[-1]) and is_literal(m[1]) and is_mixed(m[1]):
            r.hit(m, 1, m[2], "prose", base)
    for m in PROSE.finditer(line):
        value = m[2].rstrip(".;)")
        start = base + m.start(2)
        if names_secret(m[1]) and is_literal(value, bare=True) and is_mixed(value) and not _is_row(r.text, m[1], start, start + len(value)):
            r.add(start, start + len(value), m[1], "prose")


_hints = None


def _hinted(text: str) -> list[int]:
    """Numbers of the lines (from 0) that hold a hint, by one pass of an automaton over the bytes."""
    global _hints
    if _hints is None:
        import ahocorasick

        _hints = ahocorasick.Automaton()
        for h in HINTS:
            _hints.add_word(h, len(h))
        _hints.make_automaton()
    low = text.encode("utf-8", "surrogatepass").lower()
    at = [end for end, _ in _hints.iter(low.decode("latin-1"))]
    if not at:
        return []
    breaks = np.flatnonzero(np.frombuffer(low, np.uint8) == 10)
    return np.unique(np.searchsorted(breaks, np.array(at))).tolist()


def _above(lines: list[str], wanted: list[int]) -> dict[int, str]:
    """For each wanted line the keys of the less indented lines above it, joined by dots, in one pass."""
    out: dict[int, str] = {}
    stack: list[tuple[int, str | None]] = []
    todo = sorted(set(wanted), reverse=True)
    opens = re.compile(r"""\s*(?:-\s*)?["']?([\w.-]+)["']?\s*:\s*(?:\{\s*)?(?:#.*)?\r?$""")
    for number, line in enumerate(lines):
        if not todo:
            break
        depth = len(line) - len(line.lstrip())
        if line.strip():
            while stack and stack[-1][0] >= depth:
                stack.pop()
        if number == todo[-1]:
            keys = [k for _, k in stack]
            cut = max((i for i, k in enumerate(keys) if k is None), default=-1)
            out[todo.pop()] = ".".join(k for k in keys[cut + 1 :] if k)
        if line.strip():
            m = opens.match(line)
            stack.append((depth, m[1] if m else "" if re.match(r"\s*[\[{(]?\s*\r?$", line) else None))
    return out


def find(text: str) -> list[Finding]:
    """The credentials of a text in their order; none for an empty one. Values that overlap count once."""
    rows = _hinted(text) if text else []
    if not rows:
        return []
    r = _Reader(text)
    _parsed(text, r)
    _whole(text, r)
    lines = text.split("\n")
    starts = np.cumsum([0, *[len(line) + 1 for line in lines]])
    machine = "machine " in text
    for i in rows:
        line = lines[i]
        _line(line, int(starts[i]), r, machine)
        if ("=" in line or ":" in line) and ("+" in line or i + 1 < len(lines) and lines[i + 1].lstrip()[:1] in ("+", ".", '"', "'")):
            _joined(text, int(starts[i]), int(starts[i]) + len(line), r)
    merged: list[list] = []
    for start, end, key, kind in sorted(r.spans, key=lambda s: (s[0], -s[1])):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
            merged[-1][2] = merged[-1][2] or key
        else:
            merged.append([start, end, key, kind])
    out, chars, size, number = [], 0, 0, 1
    for start, end, key, kind in merged:
        number += text.count("\n", chars, start)
        size += len(text[chars:start].encode("utf-8", "surrogatepass"))
        length = len(text[start:end].encode("utf-8", "surrogatepass"))
        out.append((Finding(number, size, size + length, r.paths.get(start, key), kind), start in r.paths))
        chars = start
    above = _above(lines, [f.line - 1 for f, parsed in out if not parsed])
    return [f if parsed else f._replace(key=".".join(k for k in (above[f.line - 1], f.key) if k)) for f, parsed in out]


def redact(text: str, findings: list[Finding] | None = None) -> str:
    """The text with every value made unreadable and all other bytes as they were.

    A value becomes as many ``*`` as it has bytes. Of a private key the markers and line
    breaks stay; of joined strings the quotes and operators stay. Redacting twice changes nothing.
    """
    raw = text.encode("utf-8", "surrogatepass")
    pieces, at = [], 0
    for f in findings if findings is not None else find(text):
        value = raw[f.start : f.end]
        pieces.append(raw[at : f.start])
        if value.startswith(b"-----BEGIN"):
            value = re.sub(rb"(?s)(-----BEGIN [A-Z0-9 ]+-----)(.*?)(-----END [A-Z0-9 ]+-----|\Z)", lambda m: m[1] + KEY_SHOWN.sub(lambda c: c[1] or b"*", m[2]) + m[3], value)
        elif f.kind == "joined":
            inside = re.split(rb"""(["'])""", value)
            value = b"".join(b"*" * len(x) if i % 4 == 0 else x for i, x in enumerate(inside))
        else:
            value = b"*" * len(value)
        pieces.append(value)
        at = f.end
    return b"".join([*pieces, raw[at:]]).decode("utf-8", "surrogatepass")


def find_credentials(blobs: DataFrame, key: str = "blob", content: str = "content") -> DataFrame:
    """(``key``, line, start_byte, end_byte, key_path, kind): the credentials of every text, found once per row.

    Whole texts of any kind, whatever their path and the length of their lines; a null or
    empty text has none. A "token" that is one of many alike values in an array of records is
    taken for data (``_is_row``). Repeated rows of the input repeat their findings. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *f) for k, t in zip(batch[key], batch[content]) if isinstance(t, str) for f in find(t)]
            yield pd.DataFrame(rows, columns=[key, "line", "start_byte", "end_byte", "key_path", "kind"])

    ship(blobs.sparkSession)
    kind = blobs.schema[key].dataType.simpleString()
    return blobs.select(key, content).mapInPandas(run, f"`{key}` {kind}, line int, start_byte int, end_byte int, key_path string, kind string")


def redact_credentials(blobs: DataFrame, key: str = "blob", content: str = "content") -> DataFrame:
    """(``key``, found, ``content``): every row with its values redacted and their number; a null content stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch[content]]
            found = [find(t) if t else [] for t in texts]
            yield pd.DataFrame({key: batch[key], "found": [len(f) for f in found], content: [redact(t, f) if f else t for t, f in zip(texts, found)]})

    ship(blobs.sparkSession)
    kind = blobs.schema[key].dataType.simpleString()
    return blobs.select(key, content).mapInPandas(run, f"`{key}` {kind}, found int, `{content}` string")
