"""Configuration texts read into key paths and values with offsets.

JSON and its relatives (JavaScript objects, HCL, TOML tables in braces), YAML, XML and
properties (also env, INI and TOML files) are told apart by their text alone. A value
comes with the path of keys that lead to it and with its place in the text, so it can be
judged by its names and cut out without touching anything around it. Nothing is
decoded; a text that is none of these has no items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Item(NamedTuple):
    """A value: the keys that lead to it, where it starts and ends (characters), whether it stands in quotes."""

    path: tuple[str, ...]
    start: int
    end: int
    quoted: bool


TOKEN = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|/\*.*?\*/|//[^\n]*|\#[^\n]*|\n|[{}\[\](),;:=]|[^\s{}\[\](),;:="'`]+""", re.S)
QUOTES = "\"'`"
PAIR = re.compile(r"""["'][\w .$/@-]+["']\s*:""")
BLOCK = re.compile(r"""(?m)^[ \t]*[\w-]+(?:[ \t]+"[^"\n]*")*[ \t]*\{[ \t]*$""")
SETTING = re.compile(r"""^[ \t]*(?:[#;!][ \t]?|//[ \t]?)?[ \t]*(?:(?:export|set|ENV|ARG)[ \t]+)?(["']?)([A-Za-z_][\w.\[\]/-]*)\1[ \t]*([=:])[ \t]*(.*?)[ \t]*\r?$""")
SECTION = re.compile(r"^\s*\[+\s*([^\[\]\n]+?)\s*\]+\s*(?:[#;].*)?\r?$")
YAML_LINE = re.compile(r"""^([ \t]*)((?:-[ \t]+)*)(?:(["']?)([^\s"'#:{}\[\],&*!|>%@`-][^"'#:\n]*?|[\w.-]+)\3[ \t]*:(?=[ \t]|\r?$))?[ \t]*(.*?)[ \t]*\r?$""")
YAML_KEY = re.compile(r"""(?m)^[ \t]*(?:-[ \t]+)*["']?[\w./ -]+["']?:(?:[ \t]|\r?$)""")
XML_TOKEN = re.compile(r"""<!--(.*?)-->|<!\[CDATA\[(.*?)\]\]>|<[?!][^>]*>|</([\w:.-]+)\s*>|<([\w:.-]+)((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*(/?)>""", re.S)
XML_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(["'])(.*?)\2""", re.S)
STATEMENT = re.compile(r"""\s*(?:[\w".-]+\s*=|[\w-]+(?:\s+"[^"]*")*\s*\{|"[^"]*",?\s*$)""")
#: Lines that tell no format.
ALONE = frozenset("--- ... { } [ ] ) }, ], ),".split())
#: Attributes that name an element, and those that hold its value.
NAMING, HOLDING = ("name", "key", "id", "property"), ("value", "val", "content", "default")


def form(text: str) -> str | None:
    """``json``, ``xml``, ``yaml``, ``block`` (HCL), ``lines`` (properties, env, INI, TOML) or None for any other text."""
    head = text.lstrip("﻿ \t\r\n")[:1]
    if not head:
        return None
    if head == "<":
        return "xml"
    if head in "{[" and PAIR.search(text):
        return "json"
    rows = [r for line in text.split("\n") if (r := line.rstrip()) and (c := r.lstrip())[:1] not in "#;!" and c not in ALONE]
    if not rows:
        return "lines" if SETTING.search(text) else None
    if any(r[-1] in ";{" or r[-1] == ")" for r in rows):  # code, or blocks with braces
        if BLOCK.search(text) and sum(1 for r in rows if STATEMENT.match(r)) >= 0.8 * len(rows):
            return "block"
        return None if any(r[-1] in ";{" or r.endswith("):") for r in rows) else _by_lines(rows)
    keyed = sum(1 for r in rows if YAML_KEY.match(r))
    if keyed:
        keyed += sum(1 for r in rows if r.lstrip().startswith("- "))
        if keyed >= 0.3 * len(rows):
            keyed += sum(1 for r in rows if r[0] in " \t")
        if keyed >= 0.8 * len(rows):
            return "yaml"
    return None if any(r.endswith("):") for r in rows) else _by_lines(rows)


def _by_lines(rows: list[str]) -> str | None:
    plain = sum(1 for r in rows if r[0] in " \t" or r[-1] == "\\" or SECTION.match(r) or (m := SETTING.match(r)) and m[4][:1] not in ("=", ">", "("))
    return "lines" if plain >= 0.8 * len(rows) else None


def items(text: str, kind: str | None = None) -> Iterator[Item]:
    """Every value of a configuration text in its order; none of a text of another kind."""
    kind = kind or form(text)
    if kind == "json" or kind == "block":
        yield from _braced(text, 0, len(text), (), kind == "block")
    elif kind == "xml":
        yield from _xml(text, 0, len(text))
    elif kind == "yaml":
        yield from _yaml(text)
    elif kind == "lines":
        yield from _lines(text)


def _bare(token: str) -> str:
    return token[1:-1] if token[:1] in QUOTES and len(token) > 1 else token


def _braced(text: str, start: int, end: int, prefix: tuple[str, ...], by_line: bool) -> Iterator[Item]:
    """Keys before ``:``, ``=`` or an opening bracket; ``by_line``: a line break ends a statement and labels of a block are keys too."""
    stack: list[tuple[tuple[str, ...], bool, int]] = []
    path, listed, index = prefix, False, 0
    key: tuple[str, ...] = ()
    waits = False
    for m in TOKEN.finditer(text, start, end):
        t = m[0]
        if t == "\n":
            if by_line and not waits:
                key = ()
        elif t[:1] == "#" or t[:2] in ("//", "/*"):
            continue
        elif t in ":=":
            waits = bool(key)
        elif t in "{[(":
            stack.append((path, listed, index))
            path = path + (key or ((str(index),) if listed else ()))
            listed, index, key, waits = t != "{", 0, (), False
        elif t in "}])":
            if stack:
                path, listed, index = stack.pop()
            key, waits = (), False
        elif t in ",;":
            key, waits, index = (), False, index + 1
        elif waits or listed and not key and t[:1] in QUOTES:
            quoted = t[:1] in QUOTES
            yield Item(path + (key or (str(index),)), m.start() + quoted, m.end() - quoted, quoted)
            key, waits = () if waits else (_bare(t),), False
        else:
            key = (*key, _bare(t)) if by_line else (_bare(t),)


def _yaml(text: str) -> Iterator[Item]:
    stack: list[tuple[int, str]] = []
    block: tuple[int, tuple[str, ...]] | None = None
    held: list[tuple[int, int]] = []
    at = 0
    for line in [*text.split("\n"), "\x00"]:
        begin, at = at, at + len(line) + 1
        depth = len(line) - len(line.lstrip(" \t"))
        if block is not None:
            if line.strip() and depth > block[0]:
                held.append((begin + depth, begin + len(line.rstrip())))
                continue
            if not line.strip():
                continue
            if held:
                yield Item(block[1], held[0][0], held[-1][1], False)
            block, held = None, []
        body = line.lstrip(" \t")
        off = 0
        if body[:1] == "#":  # a setting that is commented out is one
            off = len(body) - len(body[1:].lstrip(" \t"))
        m = YAML_LINE.match(line if not off else " " * (depth + off) + line[depth + off :])
        if not m or line[:1] == "\x00" or not body.strip() or off and not m[4]:
            continue
        own = depth + len(m[2])
        if not off:
            while stack and (stack[-1][0] >= own if m[4] else stack[-1][0] >= max(own, 1)):
                stack.pop()
        keys = tuple(k for _, k in stack if not off or _ < own)
        path = (*keys, m[4]) if m[4] else (*keys, "0")
        value, a = m[5], begin + m.start(5)
        if m[4] and not off:
            stack.append((own, m[4]))
        if not value or value[:1] == "#":
            continue
        if value[:1] in "|>" and re.fullmatch(r"[|>][-+0-9]*(?:\s+#.*)?", value):
            block = (depth, path)
        elif value[:1] in "{[" and value[-1:] in "}]":
            yield from _braced(text, a, a + len(value), path, False)
        elif value[:1] in "\"'" and (q := re.match(r"""(["'])((?:(?!\1)[^\\]|\\.)*)\1""", value)):
            yield Item(path, a + 1, a + 1 + len(q[2]), True)
        elif m[4] or m[2]:
            value = re.split(r"\s+#", value, maxsplit=1)[0]
            value = re.sub(r"^[!&]\S+\s+", lambda x: "\x00" * len(x[0]), value)
            a += len(value) - len(value.lstrip("\x00"))
            yield Item(path, a, a + len(value.lstrip("\x00")), False)


def _lines(text: str) -> Iterator[Item]:
    section: tuple[str, ...] = ()
    at, rows = 0, text.split("\n")
    pending: tuple[str, ...] | None = None
    for line in rows:
        begin, at = at, at + len(line) + 1
        if pending is not None:
            bare = line.strip().rstrip("\\").rstrip()
            a = begin + len(line) - len(line.lstrip())
            if bare:
                yield Item(pending, a, a + len(bare), False)
            pending = None
            continue
        if m := SECTION.match(line):
            section = tuple(m[1].strip("\"'").split("."))
            continue
        m = SETTING.match(line)
        if not m:
            continue
        path, value, a = (*section, *m[2].split(".")), m[4], begin + m.start(4)
        if value == "\\":
            pending = path
        elif value[:1] in "\"'" and (q := re.match(r"""("{3}|'{3}|["'])(.*?)\1""", value)):
            yield Item(path, a + len(q[1]), a + len(q[1]) + len(q[2]), True)
        elif value[:1] in "{[" and value[-1:] in "}]":
            yield from _braced(text, a, a + len(value), path, False)
        elif value:
            value = re.split(r"\s+[#;]", value, maxsplit=1)[0].rstrip("\\").rstrip()
            yield Item(path, a, a + len(value), False)


def _xml(text: str, start: int, end: int, path: tuple[str, ...] = ()) -> Iterator[Item]:
    stack = [path]
    names: list[str] = []
    last = start
    for m in XML_TOKEN.finditer(text, start, end):
        if names and text[last : m.start()].strip():
            yield _stripped(text, stack[-1], last, m.start())
        last = m.end()
        if m[1] is not None:
            if "<" in m[1]:
                yield from _xml(text, m.start(1), m.end(1), stack[-1])
        elif m[2] is not None:
            if names and m[2].strip():
                yield _stripped(text, stack[-1], m.start(2), m.end(2))
        elif m[3]:
            if m[3] in names:
                while names.pop() != m[3]:
                    stack.pop()
                stack.pop()
        elif m[4]:
            attributes = {a[1].lower(): (m.start(5) + a.start(3), m.start(5) + a.end(3)) for a in XML_ATTRIBUTE.finditer(m[5])}
            own = next((text[slice(*attributes[n])] for n in NAMING if n in attributes), None)
            here = (*stack[-1], m[4], own) if own else (*stack[-1], m[4])
            for name, (a, b) in attributes.items():
                yield Item(here if own and name in HOLDING else (*stack[-1], m[4], name), a, b, True)
            if not m[6]:
                names.append(m[4])
                stack.append(here)


def _stripped(text: str, path: tuple[str, ...], a: int, b: int) -> Item:
    raw = text[a:b]
    return Item(path, a + len(raw) - len(raw.lstrip()), a + len(raw.rstrip()), False)
