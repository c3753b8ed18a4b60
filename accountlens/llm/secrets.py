"""Secrets in text, and credentials whose parts lie apart.

Base spans are found by their form alone: assignments, access identifiers and long hex runs. The
method adds weak candidates, which say nothing alone: login names, short passwords and endpoints. They
are known by a word in the name before the separator, also a compound one (DB_USER, secret_key, dbHost). A
scope is a paragraph (lines up to a blank one). Within it the parts are interval-joined: a weak
candidate is reported only if parts of the other roles lie beside it, not within it (and start within
``reach`` characters, if a reach is given). An identifier (access span or login) needs a secret (assign
or hex span or weak password), a weak password an identifier or endpoint, an endpoint both an identifier
and a secret that don't overlap.

Offsets are code points, ends exclusive. Null and empty texts have no spans; a text is scanned whole.
Rows that repeat each give a row, other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.llm.common import map_arrow

BASE = ("assign", "access", "hex")
WEAK = ("login", "weak_secret", "endpoint")
KINDS = BASE + WEAK
#: Parts of a credential start at most so many characters apart; None: anywhere in one scope.
REACH: int | None = None

# The forms of base spans and the least lengths of their matches.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ASSIGN_LEAST = 12
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ACCESS_LEAST = 18
_HEX = re.compile(r"[0-9a-f]{16,}")

_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: The name before a separator, from its first letter; a run of name characters is tried once.
_NAME = re.compile(r"""(?<![\w.-])[.-]*+(\w[\w.-]*+)["']?\x20*+[:=]""", re.ASCII)
#: Roles of a name by the words in it, the last one counts. Short words are no part of longer ones in lower case.
_ROLE = re.compile(
    r"""(?P<login>(?i:user|login|account|(?:client|key)[_.-]?id(?![a-z])))
    |(?P<weak_secret>(?i:passw|pwd|secret|token|(?:api|access|private|auth|db)(?:key|pass(?![a-z])))
        |(?:(?<![A-Za-z])(?i:key|pass)|(?<=[a-z])(?:Key|Pass)|(?<=[A-Z])(?:KEY|PASS))(?:s|phrase)?(?![a-z]))
    |(?P<endpoint>(?:(?<![A-Za-z])(?i:host)|(?<=[a-z])Host|(?<=[A-Z])HOST|(?:db|pg)host)(?:s|name)?(?![a-z]))""",
    re.ASCII | re.VERBOSE,
)
_ROLE_WORDS = ("user", "login", "account", "client", "key", "pass", "pwd", "secret", "token", "host")
_VALUES = {
    "login": re.compile(r"""\x20*["']?[\w.@+-]{3,}""", re.ASCII),
    "weak_secret": re.compile(r"""\x20*["']?[^\s"',;]{4,}""", re.ASCII),
    "endpoint": re.compile(r"""\x20*["']?[\w.-]+""", re.ASCII),
}
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.ASCII | re.IGNORECASE)
_BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of assignments, access identifiers and hex runs, in that order by start."""
    low = text.lower()
    spans = []
    if any(w in low for w in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    spans.sort()
    return spans


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that need company; those that overlap an assignment are part of it."""
    low = text.lower()
    found = []
    if any(w in low for w in _ROLE_WORDS):
        ends = dict.fromkeys(_VALUES, 0)
        for m in _NAME.finditer(text):
            role = None
            for word in _ROLE.finditer(m[1]):
                role = word.lastgroup
            # what lies within a value of the same role is part of it
            value = _VALUES[role].match(text, m.end()) if role and m.end() >= ends[role] else None
            if value:
                ends[role] = value.end()
                found.append((m.start(1), KINDS.index(role), value.end()))
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in _URL.finditer(text)]
    if not found:
        return []
    strong = [(s, e) for s, k, e in base if k == 0]
    starts = np.array([s for s, _ in strong], np.int64)
    ends = np.array([e for _, e in strong], np.int64)
    kept = []
    for s, k, e in sorted(found):
        i = int(np.searchsorted(starts, e)) - 1
        if k == 5 or i < 0 or ends[i] <= s:
            kept.append((s, k, e))
    return kept


def linked(text: str, base: list, weak: list, reach: int | None = REACH) -> list[tuple[int, int, int]]:
    """The weak candidates with complementary parts in their scope.

    A part that overlaps the candidate is no other part, and parts that overlap are one.
    """
    breaks = np.array([m.start() for m in _BLANK.finditer(text)], np.int64)
    roles = ((1, 3), (0, 2, 4), (5,))  # identifiers, secrets, endpoints
    parts = [sorted((s, e) for s, k, e in chain(base, weak) if k in kinds) for kinds in roles]
    starts = [np.array([s for s, _ in p], np.int64) for p in parts]

    def near(role: int, own: tuple[int, int]) -> Iterator[tuple[int, int]]:
        at = own[0]
        scope = int(np.searchsorted(breaks, at, "right"))
        lo = int(breaks[scope - 1]) if scope else 0
        hi = int(breaks[scope]) if scope < len(breaks) else len(text)
        if reach is not None:
            lo, hi = max(lo, at - reach), min(hi, at + reach)
        i, j = np.searchsorted(starts[role], lo, "left"), np.searchsorted(starts[role], hi, "right")
        return (parts[role][n] for n in range(i, j) if _apart(parts[role][n], own))

    out = []
    for s, k, e in weak:
        own = (s, e)
        if k == 3:
            found = any(True for _ in near(1, own))
        elif k == 4:
            found = any(True for _ in chain(near(0, own), near(2, own)))
        else:
            found = any(_apart(a, b) for a in near(0, own) for b in near(1, own))
        if found:
            out.append((s, k, e))
    return out


def _apart(a: tuple[int, int], b: tuple[int, int]) -> bool:
    return a[1] <= b[0] or b[1] <= a[0]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = REACH) -> DataFrame:
    """(id, base, spans) of each row: arrays of (kind, start, end), by start, then kind.

    ``base`` are the base spans, ``spans`` these and the linked weak ones.
    """
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def make():
        def named(spans: list) -> list:
            return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

        def work(batch: pa.RecordBatch) -> list:
            base, every = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = base_spans(text)
                weak = weak_spans(text, found)
                base.append(named(found))
                every.append(named(sorted(found + linked(text, found, weak, reach))) if weak else base[-1])
            return [batch.column(0), pa.array(base, pa.list_(one)), pa.array(every, pa.list_(one))]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    return map_arrow(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, base {span}, spans {span}"
    ).withColumnRenamed("id", id_col)
