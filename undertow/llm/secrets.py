"""Secret scans by assignment-aware lexing.

The base patterns give their spans as they stand.  Beside them a lexer reads source and configuration syntax -
``name = "literal"``, ``name: literal``, ``"name": "literal"``, ``export NAME=literal``, ``name := 'literal'``,
``<name>literal</name>`` and ``--name literal`` - into pairs of a target name and a literal.  A name assigned from a
bare name takes over that constant (``key = A`` after ``A = "..."``), also across concatenations, and the literal is
scored at the place where it stands, by the most sensitive name that it reaches:

    score = sensitivity of the name's parts + length + mix of characters - placeholders

Literals at or above ``THRESHOLD`` are spans of the kind ``lexed``; a literal that overlaps a base span is not
reported again.

Edge cases: a NULL or empty text has no spans; a text of any length is read whole, once; repeated rows are read each;
offsets are code points, ends exclusive.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import map_batches, texts_of

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(rb"[0-9a-f]{32}")  # bytes: texts without such a run need no second look
KINDS = ("assign", "access", "hex", "lexed")
LEAST = {"assign": 8, "access": 16, "hex": 32}
ASSIGN_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Parts of a name and what they say about its value.
SENSITIVE = {
    "password": 4, "passwd": 4, "passphrase": 4, "pwd": 4, "secret": 4, "apikey": 4, "accesskey": 4, "privatekey": 4,
    "token": 3, "credential": 3, "credentials": 3, "auth": 3, "bearer": 3, "signature": 2, "pass": 3,
    "key": 2, "private": 2, "session": 1, "access": 1, "api": 1, "client": 1, "salt": 2, "cert": 1, "dsn": 2, "jwt": 3,
}
HARMLESS = {"public": -3, "path": -3, "file": -3, "name": -3, "length": -3, "count": -3, "size": -3, "type": -3, "url": -2, "limit": -3, "expires": -3, "timeout": -3, "max": -2, "min": -2}
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|your[-_ ].*|changeme|example.*|placeholder|none|null|nil|true|false|undefined|todo|redacted|test|dummy)$")
THRESHOLD = 6

LEXER = re.compile(
    r"""
      (?P<tag><(?P<tname>[A-Za-z_][\w.-]*+)>(?P<tlit>[^<>\s]++)</(?P=tname)>)
    | (?P<name>(?<![\w.-])["']?(?:--)?[A-Za-z_][\w.-]*+["']?)
      (?P<op>\x20*(?::=|=>|[:=])\x20*|(?<=\w)\x20+(?=["']))
      (?P<value>(?:"[^"\n]*"|'[^'\n]*'|`[^`\n]*`|[^\s"'`,;(){}\[\]<>\#&|+]+)(?:\x20*\+\x20*(?:"[^"\n]*"|'[^'\n]*'|[A-Za-z_][\w.]*))*)
    """,
    re.X | re.A,
)
PIECE = re.compile(r""""([^"\n]*)"|'([^'\n]*)'|`([^`\n]*)`|([^\s"'`+]+)""")
BARE_NAME = re.compile(r"[A-Za-z_][\w.]*\Z", re.A)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return found


def name_score(name: str) -> int:
    """How sensitive a target name is: its parts, and its pairs of parts, in camel or snake case."""
    parts = [p.lower() for p in PART.findall(name)]
    both = [a + b for a, b in zip(parts, parts[1:])]
    best = max([SENSITIVE.get(p, 0) for p in (*parts, *both)], default=0)
    more = sum(1 for p in parts if p in SENSITIVE) > 1
    return best + more + sum(HARMLESS.get(p, 0) for p in parts)


def literal_score(literal: str) -> float:
    if len(literal) < 8 or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return -9.0
    n = len(literal)
    bits = -sum(k / n * log2(k / n) for k in (literal.count(c) for c in set(literal)))
    kinds = any(c.islower() for c in literal) + any(c.isupper() for c in literal) + any(c.isdigit() for c in literal) + any(not c.isalnum() for c in literal)
    return (1 if n >= 12 else 0) + (1 if n >= 20 else 0) + (kinds - 1) + (1 if bits >= 3 else 0) + (-2 if kinds == 1 else 0)


def pairs(text: str) -> list[tuple[str, list[tuple[int, int, str] | str]]]:
    """(target name, pieces of its value) in order; a piece is a literal with its place, or the name it takes over."""
    found = []
    for m in LEXER.finditer(text):
        if m["tag"]:
            found.append((m["tname"], [(m.start("tlit"), m.end("tlit"), m["tlit"])]))
            continue
        pieces: list[tuple[int, int, str] | str] = []
        for p in PIECE.finditer(text, m.start("value"), m.end("value")):
            k = p.lastindex
            if k == 4 and BARE_NAME.match(p[4]):
                pieces.append(p[4])  # a name, or a bare word of a configuration
                if ":" in m["op"] or "=" in m["op"]:
                    pieces.append((p.start(4), p.end(4), p[4]))
            else:
                pieces.append((p.start(k), p.end(k), p[k]))
        found.append((m["name"].strip("\"'").lstrip("-"), pieces))
    return found


def lexed(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of literals that reach a sensitive name, without those inside base spans."""
    constants: dict[str, dict[tuple[int, int], str]] = {}
    best: dict[tuple[int, int], int] = {}
    values: dict[tuple[int, int], str] = {}
    for name, pieces in pairs(text):
        reached: dict[tuple[int, int], str] = {}
        for piece in pieces:
            if isinstance(piece, str):
                reached |= constants.get(piece, {})
            elif not any(isinstance(p, str) and p == piece[2] and p in constants for p in pieces):
                reached[piece[:2]] = piece[2]
        constants[name] = reached
        score = name_score(name)
        whole = "".join(reached.values())
        for place, literal in reached.items():
            values[place] = whole if len(reached) > 1 else literal
            best[place] = max(best.get(place, -9), score)
    starts = sorted((a, b) for a, b, _ in base)
    upto, top = [], -1
    for _, b in starts:
        top = max(top, b)
        upto.append(top)
    found = []
    for (a, b), score in best.items():
        if score >= 2 and score + literal_score(values[a, b]) >= THRESHOLD:
            k = bisect_right(starts, (b - 1, 1 << 62)) - 1  # the base spans that begin before b
            if k < 0 or upto[k] <= a:
                found.append((a, b, "lexed"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans of a text."""
    base = spans_of(text)
    return base, lexed(text, base)


def scan_batches(batches):
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans")}
        for raw in texts_of(batch, 1):
            base, more = [], []
            # what every match of the lexer holds: a sign, a closing tag, or a quote behind a blank
            pairs_possible = b"=" in raw or b":" in raw or b"</" in raw or b' "' in raw or b" '" in raw
            if pairs_possible or b"AKIA" in raw or LONG_HEX.search(raw):
                text = raw.decode()
                low = raw.lower()
                if pairs_possible and any(n in low for n in ASSIGN_NAMES):
                    base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
                if b"AKIA" in raw:
                    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
                if LONG_HEX.search(raw):
                    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
                if pairs_possible:
                    more = lexed(text, base)
            for kind in KINDS:
                rows[f"n_{kind}"].append(sum(s[2] == kind for s in (*base, *more)))
            rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows["spans"].append(joined([*base, *more]))
        kinds = {"base_sha256": pa.string(), "spans": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()]], names=["doc_id", *rows])


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key (as doc_id), counts per kind, digest of the base spans and all spans of every row."""
    narrow = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    return map_batches(narrow, scan_batches, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string")
