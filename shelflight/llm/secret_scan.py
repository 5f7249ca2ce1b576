"""Secrets in texts: fixed patterns, and literals that reach names of secrets by assignment.

The second part reads source and configuration syntax without a grammar of any
one language: a lexer gives strings, names, bare values and operators; an
assignment is a target (a name, a key, the first argument of a definition, a
markup element) and the terms of its value, literals and other names. A
literal counts for the most sensitive target that it reaches, directly or by
constants assigned to constants; each assignment is visited once, so cycles and
long chains cost no more than their length. A literal's score is the sensitivity
of that name times how much the value looks like a secret.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")
#: Least score of a literal.
THRESHOLD = 0.55
#: Characters of a value that count for its score, which no longer value would change but by its entropy.
LONGEST = 4096

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words of names that hold secrets, with their weights; two words are neighbours in a name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "credential": 1.0, "credentials": 1.0,
    "apikey": 1.0, "api key": 1.0, "access key": 1.0, "secret key": 1.0, "private key": 1.0, "signing key": 1.0,
    "encryption key": 1.0, "account key": 1.0, "api token": 1.0, "auth token": 1.0, "access token": 1.0, "refresh token": 1.0,
    "bearer token": 1.0, "connection string": 0.9, "bearer": 0.8, "token": 0.6, "auth": 0.6, "pass": 0.6, "key": 0.6,
    "salt": 0.6, "signature": 0.6, "jwt": 0.6, "cookie": 0.6, "dsn": 0.6, "webhook": 0.6,
}
#: Words that count inside a longer word too, as in dbpassword.
_INNER = ("password", "passwd", "passphrase", "secret", "apikey", "credential", "token")
#: Words that make a name a description of a secret rather than a holder of one.
HARMLESS = frozenset(
    "count length size max min limit field label policy hint type expires expiry ttl timeout public column placeholder"
    " regex pattern prompt reset format index foreign primary sort path file url uri header version keyboard".split()
)
_PLACEHOLDER = re.compile(
    r"(?i)(?:.*(?:changeme|change_me|example|placeholder|dummy|redacted|your[_ -]|todo|xxxx|\*\*\*).*|none|null|nil|true|false|undefined|default"
    r"|\$\{.*|\$\(.*|\{\{.*|<.*>|%\(.*|%[A-Za-z_]+%|\$[A-Za-z_]+|env\..*|process\.env.*|(.)\1*)$",
    re.S,
)

_TOKEN = re.compile(
    r"""
    (?P<newline>\n)
  | (?P<blank>[^\S\n]++|\\\n)
  | (?P<escape>\\.)
  | (?P<string>(?<!\w)[rRbBuUfF]{0,2}(?:
        \"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\" | '''(?:[^'\\]++|\\.|'(?!''))*+'''
      | "(?:[^"\\\n]++|\\.)*+" | '(?:[^'\\\n]++|\\.)*+' | `(?:[^`\\\n]++|\\.)*+`))
  | (?P<name>[^\W\d][\w$]*+(?:(?:\.|->|::|-)(?=[^\W\d])[\w$]++)*+)
  | (?P<assign>:=|=>|\+=|=(?!=)|(?<![:=!<>]):(?!:))
  | (?P<join>\.\.?|\+|&|~)
  | (?P<other>.)
    """,
    re.X | re.S,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
#: A name, or names and numbers joined by operators; the parts share no character, so that nothing is tried twice.
_EXPRESSION = re.compile(r"[\w$.\->:]+\(?|[\w$]+[.+&~][\w$.+&~]*+")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>\n]{6,})</\1>")
_ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*+=\s*+["']([^"'\n]{1,200})["']\s++value\s*+=\s*+["']([^"'\n]{6,})["']""")
_DEFINERS = frozenset("define setenv putenv set add setproperty put".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_QUOTES = re.compile(r"""[rRbBuUfF]{0,2}(\"\"\"|'''|["'`])""")
#: Tests of whole columns, in linear time whatever the text: a text that fails one holds no finding of its kinds.
_MAY_HAVE_BASE = r"""AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_MAY_HAVE_TARGET = (
    "(?i)(?:" + "|".join(sorted({w.split()[-1] for w in SENSITIVE})) + r""")[\pL\pN_$.-]*["'\]]*\s*(?:[:=,>+]|value)"""
)


class Finding(NamedTuple):
    """A span in code points, end exclusive; the secret itself in it; for literals the name it reaches and its score."""

    kind: str
    start: int
    end: int
    value_start: int
    value_end: int
    name: str | None = None
    score: float | None = None


class Literal(NamedTuple):
    start: int
    end: int
    quoted: bool


class Assignment(NamedTuple):
    """Names that get the value of the joined terms: literals, and names of other values."""

    names: tuple[str, ...]
    terms: tuple[Literal | str, ...]
    at: int


def base_findings(text: str) -> list[Finding]:
    """Matches of the fixed patterns, leftmost and without overlap for each kind, by start and kind."""
    found = [Finding("assign", *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    # a run that is too short holds no longer run, so the length may stand in the pattern
    found += [Finding("access", *m.span(), *m.span()) for m in _ACCESS.finditer(text)]
    found += [Finding("hex", *m.span(), *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(f: Finding) -> tuple:
    return f.start, KINDS.index(f.kind), f.end


def _content(text: str, start: int, end: int) -> tuple[int, int]:
    """The span inside a string's quotes."""
    mark = _QUOTES.match(text, start)
    return mark.end(), end - len(mark[1])


def _target(text: str, recent: deque) -> str | None:
    """The name that an operator behind these tokens assigns to."""
    if recent and recent[-1][0] == "]":
        recent = deque(list(recent)[:-1])
    if not recent or recent[-1][0] not in ("name", "string"):
        return None
    kind, start, end = recent[-1]
    if kind == "string":
        start, end = _content(text, start, end)
    return text[start:end] if end - start <= 200 else None


def assignments(text: str) -> Iterator[Assignment]:
    """Targets with the terms of their values, in the order in which values end.

    A value ends at a line's end, a comma, semicolon or closing bracket; it goes on
    behind an operator that joins and inside parentheses. Arguments of calls are no
    terms. ``a = b = "x"`` has two targets; in ``a: T = "x"`` T is a type.
    """
    recent: deque = deque(maxlen=3)
    names: list[str] = []
    terms: list[Literal | str] = []
    active, expects, depth, calls, by, began = False, False, 0, 0, "", 0

    def done() -> Assignment:
        return Assignment(tuple(names), tuple(terms), began)

    at, size = 0, len(text)
    while at < size:
        if active and expects and not calls and not terms:
            bare = _BARE.match(text, at)
            # a value that is no name and no expression, as in settings files
            if bare and not _TOKEN.fullmatch(text, *bare.span()) and not _EXPRESSION.fullmatch(bare[0]):
                terms.append(Literal(*bare.span(), False))
                expects, at = False, bare.end()
                recent.append(("bare", *bare.span()))
                continue
        m = _TOKEN.match(text, at)
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind in ("blank", "escape"):
            continue
        if kind == "other":
            kind = m[0]
        if active:
            ends = False
            if calls:  # inside the arguments of a call
                calls += {"(": 1, ")": -1}.get(kind, 0)
                ends = kind == "newline" and calls > 64
            elif kind == "string" and (expects or (terms and isinstance(terms[-1], Literal))):
                terms.append(Literal(*_content(text, start, at), True))
                expects = False
            elif kind == "name" and expects:
                terms.append(m[0])
                expects = False
            elif kind == "join" and not expects:
                expects = True
            elif kind == "(" and not expects and recent and recent[-1][0] == "name" and terms and isinstance(terms[-1], str):
                terms.pop()
                calls = 1
            elif kind == "(" and expects:
                depth += 1
            elif kind == ")" and depth:
                depth -= 1
            elif kind == "newline":
                ends = not (depth or (expects and terms))
            elif kind == "assign" and len(terms) == 1 and isinstance(terms[0], str) and not expects:
                if by == ":" and m[0] == "=":
                    terms.pop()  # the type of the target
                else:
                    names.append(terms.pop())
                expects, by = True, m[0]
            else:
                ends = True
            if ends:
                if terms:
                    yield done()
                active, names, terms, depth, calls = False, [], [], 0, 0
        if not active:
            name = None
            if kind == "assign":
                name = _target(text, recent)
            elif kind == "," and len(recent) == 3 and [t[0] for t in recent] == ["name", "(", "string"]:
                called = text[recent[0][1] : recent[0][2]].rpartition(".")[2]
                name = _target(text, recent) if called.lower() in _DEFINERS else None
            if name:
                active, expects, names, by, began = True, True, [name], m[0], start
        recent.append((kind, start, at))
    if active and terms:
        yield done()


def _markup(text: str) -> Iterator[Assignment]:
    for pattern in (_ELEMENT, _ATTRIBUTES):
        for m in pattern.finditer(text):
            yield Assignment((m[1],), (Literal(*m.span(2), True),), m.start())


def sensitivity(name: str) -> float:
    """0 to 1: how surely a variable, key or element of this name holds a secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or any(w in HARMLESS for w in words):
        return 0.0
    known = [SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE.get(f"{a} {b}", 0.0) for a, b in zip(words, words[1:])]
    known += [SENSITIVE[i] for w in words for i in _INNER if i in w]
    return max(known)


def secrecy(value: str, quoted: bool) -> float:
    """0 to 1: how much a value looks like a secret, by length, entropy and kinds of characters; 0 for placeholders."""
    if len(value) < 6 or _PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    if not quoted and (kinds < 2 or not re.search("[0-9]", value)):
        return 0.0
    found = 0.4 * min(1.0, n / 16) + 0.3 * min(1.0, entropy / 4) + 0.1 * min(3, kinds)
    return found * (0.4 if re.search(r"\s", value) else 1.0)


def _last(name: str) -> str:
    return re.split(r"\.|->|::", name)[-1]


class _Constants:
    """All assignments of a text, and which of them a name means at a place: the last before it, or the first behind it."""

    def __init__(self, text: str):
        self.known = [*assignments(text), *_markup(text)]
        self.by_name: dict[str, list[int]] = {}
        for i, a in enumerate(self.known):
            for form in {f for n in a.names for f in (n, _last(n))}:
                self.by_name.setdefault(form, []).append(i)
        self.places = {name: [self.known[i].at for i in own] for name, own in self.by_name.items()}
        # twice, so that names which are assigned behind their use have a value too
        self.values = [""] * len(self.known)
        for _ in range(2):
            for i, a in enumerate(self.known):
                parts = (text[t.start : t.end] if isinstance(t, Literal) else self._value(t, a.at) for t in a.terms)
                self.values[i] = "".join(parts)[:LONGEST]

    def meant(self, name: str, at: int) -> int | None:
        for form in (name, _last(name)):
            if form in self.by_name:
                return self.by_name[form][max(0, bisect_right(self.places[form], at - 1) - 1)]
        return None

    def _value(self, name: str, at: int) -> str:
        i = self.meant(name, at)
        return "" if i is None else self.values[i]


def literal_findings(text: str) -> list[Finding]:
    """Literals that reach a sensitive name with a score of ``THRESHOLD`` or more, by start.

    The score is that of the whole value which the name gets, joined over all
    constants in it; each literal of that value is a finding.
    """
    constants = _Constants(text)
    ranked = []
    for i, (own, value) in enumerate(zip(constants.known, constants.values)):
        quoted = all(t.quoted for t in own.terms if isinstance(t, Literal))
        for name in own.names:
            if (weight := sensitivity(name)) and (shown := secrecy(value, quoted)):
                ranked.append((weight * (0.5 + 0.5 * shown), name, i))
    reached: set[int] = set()
    found: dict[tuple[int, int], Finding] = {}
    # the highest scores first: each assignment is reached once, for the best of the names that it leads to
    for score, name, first in sorted(ranked, key=lambda x: (-x[0], x[2])):
        if score < THRESHOLD:
            break
        waiting = [first]
        while waiting:
            i = waiting.pop()
            if i in reached:
                continue
            reached.add(i)
            for t in constants.known[i].terms:
                if isinstance(t, Literal):
                    if t.end > t.start:
                        found.setdefault((t.start, t.end), Finding("literal", t.start, t.end, t.start, t.end, name, round(score, 6)))
                elif (k := constants.meant(t, constants.known[i].at)) is not None:
                    waiting.append(k)
    return sorted(found.values(), key=_order)


def findings(text: str, base: bool = True, literals: bool = True) -> list[Finding]:
    """Base findings, and literals that do not lie wholly in one of them, by start and kind."""
    fixed = base_findings(text) if base else []
    starts, furthest = [], []
    for f in fixed:  # by start: the furthest end of all that begin up to here
        starts.append(f.start)
        furthest.append(max(f.end, furthest[-1] if furthest else 0))
    more = []
    for f in literal_findings(text) if literals else []:
        k = bisect_right(starts, f.start)
        if not k or furthest[k - 1] < f.end:
            more.append(f)
    return sorted(fixed + more, key=_order)


def redacted(text: str, found: list[Finding], mask: str = "[secret]") -> str:
    """``text`` with the mask in place of each secret; secrets that overlap become one."""
    parts, at = [], 0
    for start, end in sorted((f.value_start, f.value_end) for f in found):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_FINDINGS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType())]
        + [T.StructField(c, T.IntegerType()) for c in ("start", "end", "value_start", "value_end")]
        + [T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]
    )
)
_ARROW = pa.list_(
    pa.struct(
        [("kind", pa.string())]
        + [(c, pa.int32()) for c in ("start", "end", "value_start", "value_end")]
        + [("name", pa.string()), ("score", pa.float64())]
    )
)


def scan_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, findings and, with ``redact``, the text with its secrets masked.

    Each whole text is scanned. findings (``Finding``) come by start, then by kind;
    a null or empty text has none, and stays as it is. Repeated rows all stay; an
    empty table gives no rows; other columns are ignored. Texts are scanned where
    they lie, a few at a time, without a shuffle.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    names = [doc_id, "findings"] + (["redacted"] if redact else [])
    kinds = [rows.schema["id"].dataType, _FINDINGS] + ([T.StringType()] if redact else [])
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                may = [pc.fill_null(pc.match_substring_regex(part.column(1), p), False).to_pylist() for p in (_MAY_HAVE_BASE, _MAY_HAVE_TARGET)]
                # not pc.if_else: over a slice of a column with nulls it gives other rows' bytes
                texts = part.column(1).to_pylist()
                found = [findings(t, *m) if any(m) else [] for t, *m in zip(texts, *may)]
                columns = [part.column(0), pa.array([[f._asdict() for f in own] for own in found], _ARROW)]
                if redact:
                    columns.append(pa.array([redacted(t, f) if t else t for t, f in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def spelled(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Findings of the given kinds as kind:start:end, joined by commas."""
    own = F.filter(found, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def of_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")
