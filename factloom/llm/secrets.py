"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class with an allow-list.

Candidates are maximal runs of key-like characters. Over each run of a class, a window of fixed width slides; its symbol counts
change by one in and one out per step, and with them the sum of c log2 c, so a step costs the same whatever the width.
A run with a window whose entropy and changes of kind (lower, upper, digit) reach the class's thresholds, or whose entropy alone reaches a higher one, is a span as a whole, if the run has the class's groups.
Both thresholds are at or below what all but a few in a thousand windows of random keys of the class reach, changes of base32 keys (2 in a hundred have fewer) excepted.
Runs of letters of one case aren't told from words, nor are keys shorter than a window found.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rows

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")


class CharClass(NamedTuple):
    """A character class to slide over: its name, members, window width, bits a character and changes of kind that a window needs, bits at which any changes do, and groups of which a run needs members."""

    kind: str
    members: str
    width: int
    bits: float
    changes: int
    sure: float
    groups: tuple[str, ...]


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("entropy_hex", _DIGIT + "abcdefABCDEF", 24, 2.88, 2, 3.2, (_DIGIT, "abcdefABCDEF")),
    CharClass("entropy_base64", _LOWER + _UPPER + _DIGIT + "+/_-", 20, 3.5, 6, 3.9, (_DIGIT, _LOWER, _UPPER)),
    CharClass("entropy_lower", _LOWER + _DIGIT, 20, 3.2, 2, math.inf, (_DIGIT, _LOWER)),
    CharClass("entropy_upper", _UPPER + _DIGIT, 20, 3.14, 2, math.inf, (_DIGIT, _UPPER)),
)
#: Parts of candidates that aren't secrets: placeholders, a documented example, the digests of integrity attributes, and UUIDs. So are ALPHABET successive characters (9 before 0) or more.
ALLOWED = re.compile(
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|sha256-[A-Za-z0-9+/_-]{43}=?|sha512-[A-Za-z0-9+/_-]{86}(?:==)?|(?i:example|placeholder|changeme|your_|dummy|x{4,})"
    "|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
)
ALPHABET = 8


def _table(members: str) -> np.ndarray:
    t = np.zeros(129, bool)
    t[[ord(c) for c in members]] = True
    return t


_HEX_TABLE = _table("0123456789abcdef")
_KEY_TABLE = _table(_LOWER + _UPPER + _DIGIT + "+/_-=")
_CHAR_KIND = _table(_LOWER) * 1 + _table(_UPPER) * 2 + _table(_DIGIT) * 3


def runs(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of the runs of True of at least so many."""
    edge = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    edge = np.concatenate([[0], edge, [len(flags)]]) if len(flags) else np.zeros(1, int)
    a, b = edge[:-1], edge[1:]
    keep = np.flatnonzero(b - a >= least)
    return [(int(a[k]), int(b[k])) for k in keep if flags[a[k]]]


def window_entropy(s: str, width: int) -> np.ndarray:
    """Bits a character of each window of s, by counts that change by one symbol in and one out."""
    n = len(s) - width + 1
    if n <= 0:
        return np.zeros(0)
    logs = [0.0, *(k * math.log2(k) for k in range(1, width + 2))]  # one symbol is in before the other is out
    counts: dict[str, int] = {}
    total, out = 0.0, np.empty(n)
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += logs[k + 1] - logs[k]
        counts[c] = k + 1
        if i >= width:
            k = counts[gone := s[i - width]]
            total += logs[k - 1] - logs[k]
            counts[gone] = k - 1
        if i >= width - 1:
            out[i - width + 1] = math.log2(width) - total / width
    return out


def unallowed(candidate: str) -> list[tuple[int, int]]:
    """Start and end of what a candidate has besides its allowed parts."""
    free = np.ones(len(candidate), bool)
    for m in ALLOWED.finditer(candidate):
        free[m.start() : m.end()] = False
    codes = np.frombuffer(candidate.encode("utf-32-le"), np.uint32).astype(np.int64)
    for a, b in runs((np.diff(codes) == 1) | (codes[:-1] == ord("9")) & (codes[1:] == ord("0")), ALPHABET - 1):
        free[a : b + 1] = False
    return runs(free, 1)


def _mixed(part: str) -> bool:
    """Whether letters alone change case as no words in camel case do."""
    return len(re.findall("(?=[A-Z]{2})", part)) >= 2 and len(re.findall("[a-z][A-Z]", part)) >= 4


def entropy_spans(candidate: str, classes: tuple[CharClass, ...] = CLASSES) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the runs of one candidate string that hold a window of high entropy, without those within another class's."""
    codes = np.minimum(np.frombuffer(candidate.encode("utf-32-le"), np.uint32), 128)
    out: list[tuple[str, int, int]] = []
    for c in classes:
        for a, b in runs(_table(c.members)[codes], c.width):
            part = candidate[a:b]
            if any(s <= a and b <= e for _, s, e in out):
                continue
            has = [any(ch in group for ch in part) for group in c.groups]
            if not all(has) and not (c.kind == "entropy_base64" and all(has[1:]) and _mixed(part)):
                continue
            kinds = _CHAR_KIND[codes[a:b]]
            change = (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
            inside = np.concatenate([[0], np.cumsum(change)])
            bits, changes = window_entropy(part, c.width), inside[c.width - 1 :] - inside[: len(part) - c.width + 1]
            if ((bits >= c.sure) | (bits >= c.bits) & (changes >= c.changes)).any():
                while c.kind == "entropy_base64" and b < min(len(candidate), a + len(part) + 2) and candidate[b] == "=":  # padding
                    b += 1
                out.append((c.kind, a, b))
    return out


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans (kind, start, end) of a text, in code points."""
    base: list[tuple[str, int, int]] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)
    base += [("hex", a, b) for a, b in runs(_HEX_TABLE[codes], 24)]
    added = []
    for a, b in runs(_KEY_TABLE[codes], min(c.width for c in CLASSES)):
        for x, y in unallowed(text[a:b]):
            added += [(k, a + x + i, a + x + j) for k, i, j in entropy_spans(text[a + x : a + y]) if not any(s <= a + x + i and a + x + j <= e for _, s, e in base)]
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(base + added, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets of each text of docs(doc_id, text): doc_id, spans array of (kind, start, end), base_spans likewise without what entropy adds.

    Null and empty texts have none. Repeated rows stay repeated. An empty table gives an empty result. Other columns are ignored.
    Texts are scanned whole, one at a time; nothing is shuffled.
    """
    one = "array<struct<kind:string,start:long,end:long>>"

    def rows(b):
        found = [scan(t or "") for t in b.column(1).to_pylist()]
        shape = lambda spans: [{"kind": k, "start": a, "end": e} for k, a, e in spans]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return {"doc_id": b.column(0), "base_spans": pa.array([shape(x) for x, _ in found], kind), "spans": pa.array([shape(y) for _, y in found], kind)}

    return by_rows(docs.select("doc_id", "text"), rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base_spans {one}, spans {one}")


def span_text(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all as kind:start:end, comma-joined)."""
    found = secret_spans(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text("base_spans").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"),
    )


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, and what overlaps it, replaced by one mark."""
    out, at = [], 0
    for _, a, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
