"""Secret scans with multipart credential linking.

*Base* findings are strong patterns: an assignment to a password-like name, an
access key identifier, a long run of hexadecimal digits.  *Weak* candidates are
parts that mean little alone: a user or client identifier, an endpoint, an
opaque token.  A weak candidate is reported only where complementary parts meet:
every part is an interval of code points, intervals are joined when they lie in
one scope (a block of lines without a blank line between them) no further than
``reach`` code points apart, and a weak part is reported when its interval joins
one of each kind that it needs (each question is two binary searches in the scope's
starts and ends, so the work is linear in the text but for a logarithm):

* an opaque token needs an identifier (access or user);
* an endpoint needs an identifier and a secret (assignment or token that is reported);
* a user identifier needs a secret and an endpoint.

The whole text is scanned.  RE2 screens each column of texts first, so that the
exact, position-giving scan visits only texts that hold a candidate.

Defined results
---------------
* text null or empty: no finding, redacted as it is;
* very long texts: scanned whole; an empty table gives an empty result;
* a null key or any other null passes through, no column but the text is looked at;
* overlapping kinds: each is reported, in order of start, then kind as listed;
* repeated rows: each is scanned, with the same result;
* other columns pass through ``scan`` untouched, except ones named like its
  outputs, which are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words
from .runtime import small_batches

# Base patterns; ASCII letters match in either case in the first.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SHORTEST = {"assign": 12, "access": 18, "hex": 16}
# Weak parts.
USER = r"""(?:client_?id|user(?:name)?|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
ENDPOINT = r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:/@-]{4,}"
OPAQUE = r"[A-Za-z0-9+/=_-]{20,}"

#: All kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "opaque", "user", "endpoint")

_FLAGS = re.ASCII | re.IGNORECASE
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, _FLAGS), re.compile(ACCESS), re.compile(HEX)
_HEX_LONG = re.compile(r"[0-9a-f]{16,}")
_USER, _ENDPOINT, _OPAQUE = re.compile(USER, _FLAGS), re.compile(ENDPOINT, _FLAGS), re.compile(OPAQUE)
_BLANK = re.compile(r"\n[\x20\t\r]*(?=\n)")
#: For RE2. Whatever the exact patterns find, these match too.
_SCREEN = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "user": r"""(?i)(client_?id|user(name)?|account|login)["']?\x20*[:=]""",
}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base findings of one text: (start, end, kind), leftmost and non-overlapping for each kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST["assign"]]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST["access"]]
    # Runs of the class are maximal, so the long ones are the matches that stay.
    out += [(m.start(), m.end(), "hex") for m in _HEX_LONG.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _opaque(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and len(set(token)) >= 8


class _Parts:
    """Intervals by scope, with their starts and their ends in order, for joins with a reach: two searches for each question."""

    def __init__(self, spans: list[tuple[int, int]], edges: list[int]):
        self.edges = edges
        self.scopes: dict[int, tuple[list[int], list[int]]] = {}
        for s, e in spans:
            starts, ends = self.scopes.setdefault(bisect_right(edges, s), ([], []))
            starts.append(s)
            ends.append(e)
        for starts, ends in self.scopes.values():
            starts.sort()
            ends.sort()

    def meets(self, start: int, end: int, reach: int) -> bool:
        """Whether an interval that does not overlap (start, end) starts in its scope and lies in reach."""
        scope = self.scopes.get(bisect_right(self.edges, start))
        if scope is None:
            return False
        starts, ends = scope
        after = bisect_left(starts, end)
        if after < len(starts) and starts[after] <= end + reach:
            return True
        before = bisect_right(ends, start)
        return before > 0 and ends[before - 1] >= start - reach


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = 300) -> list[tuple[int, int, str]]:
    """Weak candidates whose complementary parts co-occur."""
    users = [m.span(1) for m in _USER.finditer(text)]
    access = [(s, e) for s, e, kind in base if kind == "access"]
    if not users and not access:
        return []  # every rule needs an identifier
    edges = [m.end() for m in _BLANK.finditer(text)]
    assigned = [(s, e) for s, e, kind in base if kind != "access"]
    covered = access + assigned + users
    endpoints = [m.span() for m in _ENDPOINT.finditer(text)]
    taken = sorted(covered + endpoints)
    starts = [s for s, _ in taken]
    farthest = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    opaque = []
    for m in _OPAQUE.finditer(text):
        at = bisect_left(starts, m.end())
        if not (at and farthest[at - 1] > m.start()) and _opaque(m.group()):
            opaque.append(m.span())
    identifiers = _Parts(access + users, edges)
    opaque = [x for x in opaque if identifiers.meets(*x, reach)]
    secrets = _Parts(assigned + opaque, edges)
    hosts = _Parts(endpoints, edges)
    out = [(s, e, "opaque") for s, e in opaque]
    out += [(s, e, "endpoint") for s, e in endpoints if identifiers.meets(s, e, reach) and secrets.meets(s, e, reach)]
    out += [(s, e, "user") for s, e in users if secrets.meets(s, e, reach) and hosts.meets(s, e, reach)]
    return out


def spans(text: str, reach: int = 300) -> list[tuple[int, int, str]]:
    """All findings of one text in order."""
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, reach), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, found: list[tuple[int, int, str]], mask: str = "[REDACTED]") -> str:
    """The text with each maximal overlap of findings replaced."""
    out, at, n = [], 0, 0
    found = sorted(found)
    while n < len(found):
        start, end = found[n][0], found[n][1]
        while n < len(found) and found[n][0] < end:
            end = max(end, found[n][1])
            n += 1
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
#: Text bytes handled at once; one longer text is handled alone.
CHUNK_BYTES = 2 << 20


def scan(docs: DataFrame, text: str = "text", reach: int = 300, redacted: bool = False) -> DataFrame:
    """``docs`` with ``spans`` (start, end, kind; code points, end exclusive) and, if asked for, ``redacted``.

    One map over the input, no shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("spans", *(["redacted"] if redacted else []))
    added = [T.StructField("spans", SPAN)] + ([T.StructField("redacted", T.StringType())] if redacted else [])

    def run(batches):
        for t in words.chunks(batches, text, CHUNK_BYTES):
            texts = words.as_strings(t[text])
            hit = np.zeros(len(texts), bool)
            for pattern in _SCREEN.values():
                hit |= np.asarray(pc.match_substring_regex(texts, pattern))
            rows = np.flatnonzero(hit)
            counts = np.zeros(len(texts), np.int64)
            found: list[tuple[int, int, str]] = []
            clean: list[str] = []
            masked = np.zeros(len(texts), bool)
            for i in rows.tolist():
                own = texts[i].as_py()
                part = spans(own, reach)
                counts[i] = len(part)
                found += part
                if redacted and part:
                    masked[i] = True
                    clean.append(redact(own, part))
            parts = pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.string())], ["start", "end", "kind"])
            column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), parts)
            extra = [column]
            if redacted:
                own = t[text].combine_chunks().cast(pa.string())
                if clean:
                    own = pc.replace_with_mask(own, pa.array(masked), pa.array(clean, pa.string()))
                extra.append(own)
            for name, column in zip(("spans", "redacted"), extra, strict=False):
                t = t.append_column(name, column)
            yield from t.to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
