"""Secret scans: base patterns plus assignment-aware lexing.

The base patterns find key formats anywhere. On top, lines that can hold an assignment are cut into tokens (strings with prefixes, triple quotes and
backticks, names, operators, bare words) and read as source or configuration syntax into pairs of a target name and a literal:

- ``name = "x"``, ``name: x``, ``"name": "x"``, ``name := x``, ``name ?= x``, ``Name => 'x'``, ``name == "x"``, ``at["name"] = "x"``, ``var name Type = "x"``,
  ``name: Type = "x"``, ``--name=x``, ``--name x``, ``set name "x"``;
- values that are sums, alternatives and calls: ``A + "x"``, ``a or "x"``, ``new String("x")``, ``getenv("NAME", "x")``;
- calls with a name and a literal, ``put("name", "x")`` and ``setName("x")``;
- elements and attributes: ``<name>x</name>``, ``<add key="name" value="x"/>``; block values (``name: |`` and the line below).

A value that is itself a name is looked up among the constants that the text assigns, by whole and by last part, so ``K = "x"`` before or
after ``password = K`` gives every literal of K the name password as well. A literal is
scored by the most sensitive name it gets and by its own look; those over the threshold are spans of kind ``literal``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import with_columns

#: Fixed patterns of the base kinds, in the order of the kinds, with the least characters of a match (of group 2 for the first).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "literal")

#: What the patterns need at least, to leave most texts alone early.
_LONG_HEX = re.compile(r"[0-9a-f]{16}")

#: Parts of names that say how sensitive the value is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "privatekey": 1.0, "secretkey": 1.0, "accesskey": 0.9, "credential": 0.9, "credentials": 0.9, "signingkey": 0.9,
    "encryptionkey": 0.9, "clientsecret": 1.0, "authkey": 0.9, "bearer": 0.8, "authorization": 0.9, "auth": 0.5, "key": 0.4, "pass": 0.7,
}
#: Last parts of names whose value is about a secret without being one.
ABOUT = {"file", "path", "dir", "type", "name", "url", "uri", "field", "length", "count", "policy", "prefix"}
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)^(?:(?:your|my|the|some)[-_ ]?.*|change[-_ ]?me.*|x{3,}|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%|none|null|nil|true|false|undefined|example.*|placeholder|redacted|todo|test|dummy|sample)$")

#: A name as sensitive as the threshold asks for has one of these in it.
_STEMS = re.compile("pass|pwd|secret|token|cred|bearer|key|authorization", re.IGNORECASE)
#: Where a line can hold a pair.
_SIGN = re.compile(r"[=:(]|--[A-Za-z]|^[ \t]*#?(?:set|define|env|setenv)[ \t]", re.IGNORECASE | re.MULTILINE)
#: Quotes inside words are no strings, so apostrophes of prose are none. A run of name characters is read once.
_TOKEN = re.compile(
    r"""(?P<string>(?<![A-Za-z0-9_])(?P<prefix>[bBrRfFuUL]{1,2}|u8|[@$]{1,2})?(?:(?P<triple>\"{3}|'{3})|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))"""
    r"""|(?P<op>:=|=>|->|::|[=!<>]=|[?+]=|\|\||\?\?|[=:+(),;{}\[\]<>|?])"""
    r"""|(?P<name>(?<![A-Za-z0-9_.\-])-{0,2}[$A-Za-z_][A-Za-z0-9_.\-]*+)"""
    r"""|(?P<bare>[^\s"'`=:+(),;{}\[\]<>|?]++)"""
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]]++""")
_NAME = re.compile(r"[$A-Za-z_][A-Za-z0-9_.\-]*")
_JOIN = re.compile(r"[ \t]*+(?:\+(?![=+])|\.\.|\|\||\?\?|or\b)[ \t]*+")
_SPACE = re.compile(r"[ \t]*+(?:new\b[ \t]*+)?")
#: A command before its quoted argument.
_COMMAND = re.compile(r"[A-Z][A-Za-z]*+-[A-Z][A-Za-z]*+[ \t]++(?=[\"'])")
#: An interpolated string without text of its own.
_FILLED = re.compile(r"(?:\{[^{}]*\})+")
#: Calls whose first literal is a name that the others are values of.
_LOOKUP = re.compile(r"(?:^|[._])(?:get_?env|env|get|get_?property|get_?or_?default|put|set|set_?env|set_?property|define|add_?header|set_?header|putenv|option|config)$", re.IGNORECASE)
_SETTER = re.compile(r"(?:^|\.)(?:set|with|add|put|use)_?[A-Z]", re.ASCII)
#: Words before a value that are no part of it.
_SCHEME = re.compile(r"(?:Bearer|Basic|Token)[ \t]+", re.IGNORECASE)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)(?:[ \t][^<>\n]*+)?>([^<>\n]++)</")
_TAG = re.compile(r"<[A-Za-z_][^<>\n]*+>")
_ATTRIBUTE = re.compile(r"""(?<![\w.\-])([A-Za-z_][\w.\-]*+)[ \t]*+=[ \t]*+(?:"([^"\n]*+)"|'([^'\n]*+)')""")
_ASSIGNS = {"=", ":=", "=>", "?=", "+=", "==", ":"}
_ENDS = {";", ",", "{", "}", "("}
#: Tokens before a sign that can name its target.
_BEFORE = 8
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _LONG_HEX.search(text):
        # runs are maximal, so those long enough are the matches of the longer pattern
        out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]{16,}", text)]
    return out


@lru_cache(4096)
def sensitivity(name: str) -> float:
    """How sensitive a name's value is, by its words and by neighbouring words run together."""
    words = [w.lower() for part in re.split(r"[_.\-]+", name) for w in _PARTS.findall(part)]
    if words and words[-1] in ABOUT:
        return 0.0
    joined = [*words, *(a + b for a, b in zip(words, words[1:], strict=False))]
    return max((SENSITIVE.get(w, 0.0) for w in joined), default=0.0)


def look(value: str) -> float:
    """0 to 1: how far a literal looks like a secret, by its length, kinds of characters and entropy."""
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return min(1.0, 0.2 * (n >= 8) + 0.2 * (n >= 16) + 0.2 * (kinds - 1) + 0.2 * (entropy >= 2.5) + 0.2 * (entropy >= 3.5))


Literal = tuple[str, list[tuple[int, int]]]


class Lines:
    """Reads the pairs of a text: ``found`` has (names, names that constants are looked up by, literal, quoted), ``given`` the names that a name is given."""

    def __init__(self, text: str):
        self.text, self.found, self.given, self.unclosed = text, [], {}, set()
        self.extent, self.calls, self.literals, self.ranges, self.signs = (0, 0), None, [], [], []

    # -- values ------------------------------------------------------------------------------------
    def string(self, m: re.Match) -> tuple[Literal | None, int]:
        """The literal of a string token, none for a mere interpolation, and where it ends."""
        text, mark = self.text, m["triple"]
        if mark:
            close = -1 if mark in self.unclosed else text.find(mark, m.end())
            if close < 0:
                self.unclosed.add(mark)
                return None, m.end()
            value = text[m.end() : close]
            # the lines of a longer one are read for pairs of their own as well
            at, end = m.end() + len(value) - len(value.lstrip()), m.end() if "\n" in value else close + 3
            value = value.strip()
        else:
            at, end = m.start("string") + len(m["prefix"] or "") + 1, m.end()
            value = text[at : end - 1]
        if m["prefix"] and {"f", "F", "$"} & set(m["prefix"]) and _FILLED.fullmatch(value):
            return None, end
        if scheme := _SCHEME.match(value):
            at, value = at + scheme.end(), value[scheme.end() :]
        return (value, [(at, at + len(value))]), end

    def lexed(self, lo: int, end: int) -> None:
        """Reads the brackets of a line once: ``calls`` has for each "(" the literals inside, at any depth, as a range of ``literals``, where it ends, and whether an
        argument has a name of its own. An opened bracket ends with the line at the latest."""
        self.literals, self.calls, self.ranges, signs = [], {}, [], []
        open_, level, at = [], [], lo
        while at < end and (m := _TOKEN.search(self.text, at, end)):
            at, op = m.end(), m["op"]
            if op in ("(", "[", "{"):
                open_.append((m.start(), len(self.literals)))
            elif op in (")", "]", "}"):
                if open_:
                    start, first = open_.pop()
                    self.calls[start] = (first, len(self.literals), at)
            elif m["string"]:
                literal, at = self.string(m)
                if literal and open_:
                    self.literals.append(literal)
                    level.append(open_[-1][0])
            elif op in _ASSIGNS:
                signs.append(m.start())
                # a literal before a sign of its own bracket is a key
                if op != "==" and open_ and self.literals and level[-1] == open_[-1][0] and open_[-1][1] < len(self.literals):
                    self.literals.pop()
                    level.pop()
        for start, first in open_:
            self.calls[start] = (first, len(self.literals), end)
        self.signs = signs

    def call(self, name: str, at: int) -> tuple[int, int, int]:
        """The range of literals that a call's bracket holds as values, and where it ends. What a name among them is given is noted."""
        if self.calls is None:
            self.lexed(*self.extent)
        first, past, close = self.calls.get(at, (0, 0, at + 1))
        if past - first > 1 and _NAME.fullmatch(key := self.literals[first][0]) and (_LOOKUP.search(name) or sensitivity(key)):
            self.ranges.append((first + 1, past, key))
            first += 1
        elif past - first == 1 and _LOOKUP.search(name):
            first = past  # the name of what is looked up
        # an argument with a name of its own is read as a pair of the line
        named = bisect_left(self.signs, close) > bisect_left(self.signs, at)
        return (past if named else first), past, close

    def settled(self) -> None:
        """Gives each literal of a line the most sensitive name among the calls around it; calls lie in each other, so one pass does."""
        waiting, around = sorted(self.ranges, key=lambda r: (-r[0], r[1])), []
        for i, literal in enumerate(self.literals) if waiting else ():
            while around and around[-1][0] <= i:
                around.pop()
            while waiting and waiting[-1][0] <= i:
                _, past, name = waiting.pop()
                around.append((past, max(name, around[-1][1] if around else name, key=sensitivity)))
            if around:
                self.found.append(((around[-1][1],), (), literal))

    def value(self, names: tuple[str, ...], at: int, end: int, aliases: tuple[str, ...]) -> int:
        """Reads what is given to ``names`` from ``at`` on: literals, names and calls, joined by signs. Returns where it ends."""
        text, joined = self.text, None
        while True:
            at = _SPACE.match(text, at, end).end()
            m = _TOKEN.match(text, at, end)
            if m and m["string"]:
                literal, at = self.string(m)
                if literal and joined:
                    joined = (joined[0] + literal[0], joined[1] + literal[1])
                else:
                    joined = literal
            else:
                if joined:
                    self.found.append((names, aliases, joined))
                joined = None
                if command := _COMMAND.match(text, at, end):
                    at = command.end()
                    continue
                m = _BARE.match(text, at, end)
                if not m:
                    return at
                word, at = m[0], m.end()
                if at < end and text[at] == "(":
                    first, past, at = self.call(word, at)
                    self.found += [(names, aliases, literal) for literal in self.literals[first:past]]
                else:
                    self.found.append((names, (), (word, [m.span()])))
                    for name in aliases:
                        self.given.setdefault(name, []).append(word)
            go = _JOIN.match(text, at, end)
            if not go:
                break
            at = go.end()
        if joined:
            self.found.append((names, aliases, joined))
        return at

    # -- targets -----------------------------------------------------------------------------------
    def said(self, m: re.Match) -> str | None:
        """The name that a token is, or that it quotes."""
        if m["name"]:
            return m["name"].lstrip("-$")
        if m["string"] and not m["triple"]:
            inner = m["string"][len(m["prefix"] or "") + 1 : -1]
            return inner if _NAME.fullmatch(inner) else None
        return None

    def targets(self, before: list[re.Match], op: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Names of an assignment's target, by the tokens before the sign, and those that constants are looked up by."""
        if not before:
            return (), ()
        if before[-1]["op"] == "]" and len(before) > 1 and (key := self.said(before[-2])):
            own = [key, *([n] if len(before) > 3 and (n := self.said(before[-4])) else [])]
            return tuple(own), (key,)
        if op in (":", "=>"):
            own = self.said(before[-1])
            return ((own,), (own,)) if own else ((), ())
        own = tuple(n for t in before if (n := self.said(t)))
        return own, own[-2:]

    def line(self, lo: int, end: int) -> int:
        """Reads one line; returns where reading goes on, which is later after a string of several lines."""
        text, before, at = self.text, [], lo
        self.extent, self.calls, self.literals, self.ranges = (lo, end), None, [], []
        while at < end and (m := _TOKEN.search(text, at, end)):
            at, op = m.end(), m["op"]
            if op in _ASSIGNS:
                names, aliases = self.targets(before, op)
                if op == ":" and names and (typed := self.annotation(at, end)):
                    at = self.value((*names, *typed[0]), typed[1], end, aliases)
                    before = []
                elif names:
                    block = text[at:end].strip()
                    if op == ":" and block in ("|", ">", "|-", ">-"):
                        return self.block(names, end)
                    at = max(at, self.value(names, at, end, aliases))
                    before = []
                else:
                    before = []
            elif op in _ENDS:
                if op == "(" and before and before[-1]["name"]:
                    name = before[-1]["name"]
                    first, past, _ = self.call(name, m.start())
                    if past > first and _SETTER.search(name):
                        self.ranges.append((first, past, name))
                before = []
            else:
                if m["string"]:
                    literal, at = self.string(m)
                    if literal and len(before) > 1 and before[-1]["name"] and (before[-2]["name"] or "").lower() in ("set", "define", "env", "setenv"):
                        self.found.append(((before[-1]["name"],), (before[-1]["name"],), literal))
                elif m["name"] and m["name"].startswith("--") and at < end and text[at] in " \t":
                    at = max(at, self.value((m["name"].lstrip("-"),), at, end, ()))
                before = [*before[1 - _BEFORE :], m]
        return max(at, end)

    def annotation(self, at: int, end: int) -> tuple[tuple[str, ...], int] | None:
        """The names of a type that stands after a colon and before a sign, and where that sign ends."""
        names, depth = [], 0
        for m in _TOKEN.finditer(self.text, at, end):
            if m["op"] in ("=", ":="):
                return tuple(names), m.end()
            depth += (m["op"] in ("[", "<")) - (m["op"] in ("]", ">"))
            if m["string"] or m["op"] in ("(", ")", ";", "{", "}", ":") or m["op"] == "," and depth <= 0 or m["bare"] and m["bare"][0] not in "&*":
                return None
            if m["name"]:
                names.append(m["name"])
        return None

    def block(self, names: tuple[str, ...], end: int) -> int:
        """The line below a block sign is the value."""
        stop = self.text.find("\n", end + 1)
        stop = len(self.text) if stop < 0 else stop
        value = self.text[end + 1 : stop]
        if value.strip() and value[0] in " \t":
            at = end + 1 + len(value) - len(value.lstrip())
            self.found.append((names, (), (value.strip(), [(at, at + len(value.strip()))])))
            return stop
        return end

    def read(self) -> Lines:
        text, end = self.text, -1
        for sign in _SIGN.finditer(text):
            if sign.start() < end:
                continue  # its line has been read
            lo = max(end + 1, text.rfind("\n", 0, sign.start()) + 1)
            stop = text.find("\n", max(sign.start(), lo))
            end = self.line(lo, len(text) if stop < 0 else stop)
            self.settled()
        if "</" in text:
            for m in _ELEMENT.finditer(text):
                self.found.append(((m[1],), (), (m[2], [m.span(2)])))
        if "value" in text:
            for tag in _TAG.finditer(text):
                own = {m[1].lower(): m for m in _ATTRIBUTE.finditer(tag[0])}
                name = next((own[k] for k in ("key", "name", "id") if k in own), None)
                if name and "value" in own:
                    g = 2 if own["value"][2] is not None else 3
                    a, b = (tag.start() + x for x in own["value"].span(g))
                    self.found.append(((name[2] or name[3] or "",), (), (own["value"][g], [(a, b)])))
        return self


def literal_spans(text: str, threshold: float = 0.55) -> list[Span]:
    """Literals whose name's sensitivity times their look is at least ``threshold``.

    A sensitive name hands its sensitivity on to the names that it is given by earlier or later lines, and so to all their quoted literals;
    each name is followed once, so long chains cost no more than their length."""
    if not _STEMS.search(text):
        return []
    lines = Lines(text).read()
    own = {name: s for name in {n for f in lines.found for n in f[0]} if (s := sensitivity(name)) >= threshold}
    if not own:
        return []
    known, by_part = lines.given.keys() | {n for f in lines.found for n in f[1]}, {}
    for name in known:
        by_part.setdefault(name.rsplit(".", 1)[-1], set()).add(name)
    reached: dict[str, float] = {}
    for name in sorted(own, key=lambda n: (-own[n], n)):
        todo = [name]
        while todo:
            if (one := todo.pop()) not in reached:
                reached[one] = own[name]
                for other in lines.given.get(one, ()):
                    todo.append(other)
                    todo += by_part.pop(other.rsplit(".", 1)[-1], ())
    out = set()
    for names, aliases, (value, places) in lines.found:
        s = max([own.get(n, 0.0) for n in names] + [reached.get(n, 0.0) for n in aliases])
        # a value that the text assigns to is a name
        if s >= threshold and value not in known and s * look(value) >= threshold:
            out |= {("literal", a, b) for a, b in places if b > a}
    return list(out)


def spans(text: str) -> list[Span]:
    """All spans by start, then kind."""
    return sorted(base_spans(text) + literal_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, found: list[Span], mark: str = "<{kind}>") -> str:
    """The text with every run of overlapping spans replaced by one mark (of the kind that begins it)."""
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += [text[at:a], mark.format(kind=kind)]
        at = max(at, b)
    return "".join([*out, text[at:]]) if found else text


def secret_scan(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """All columns of ``docs`` plus spans (array of kind, start, end; code points, end exclusive), for every row.

    With ``redact`` the text has its spans replaced by their kinds. Defined cases: a text is read whole, in time that grows with its length; a null text is scanned as an empty
    one (and stays null); spans of different kinds may overlap; repeated rows give equal results; an empty table gives
    an empty table; an input column named spans is replaced.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [spans(t) if t else [] for t in texts]
            columns = {"spans": pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], kind)}
            if redact:
                columns[text] = pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
            yield columns

    return with_columns(docs, scan, "spans array<struct<kind:string,start:bigint,end:bigint>>" + (f", `{text}` string" if redact else ""))
