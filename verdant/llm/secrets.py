"""Secret scans: three fixed patterns, and values in a credential context judged by their guess cost.

The guess cost of a value is the least sum, over segmentations into dictionary words, dates, repeats, keyboard walks and
brute-force spans, of each span's log10 guesses; a dynamic programme over end positions finds it. Values that cost more
than MIN_GUESS are spans of kind `guess`.

Null text: empty, no spans. Repeated rows: each is scanned. Empty table: no rows. Very long texts and values: whole, in linear time.
Ties between segmentations: their cost is one. Other columns are not read. Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as all runs of which those under 32 are dropped
# The keywords of ASSIGN stand anywhere, as there; the others do not follow a letter. A quoted value ends at its quote.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z])(?:pwd|passphrase|pass|credentials?|auth|bearer|private_?key|access_?key|client_?secret)|password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*"""
    r"""(?:"(?P<double>[!#-~]{6,})|'(?P<single>[!-&(-~]{6,})|(?P<bare>[!#-&(-~][!-~]{5,}))""",
    re.I | re.A,
)
KINDS = ("assign", "access", "hex", "guess")
MIN_GUESS = 8.0
MAX_SPAN = 32
# Common words of passwords, by falling frequency.
COMMON = """password love admin welcome monkey dragon master letmein login princess sunshine shadow football baseball superman batman
secret test guest root user qwerty hello freedom whatever trustno summer winter spring autumn change default example sample token""".split()
RANK = {w: i + 2 for i, w in enumerate(COMMON)}
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {(r[i], r[i + d]) for r in ROWS for i in range(len(r)) for d in (1, -1) if 0 <= i + d < len(r)}
# Keys under each other are neighbours, too: those of the next row at the same place or one before.
NEXT |= {p for a, b in zip(("1234567890", *ROWS[1:]), ROWS[1:]) for i, x in enumerate(a) for y in b[max(i - 1, 0) : i + 1] for p in ((x, y), (y, x))}
WALK = math.log10(47)
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?")


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation takes; 0 for an empty value."""
    low, n = value.lower(), len(value)
    size = 10 * any(c.isdigit() for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 33 * any(not c.isalnum() for c in value)
    step = math.log10(max(size, 10))
    best = [0.0] + [math.inf] * n
    runs, walks = [n] * n, [n] * n  # where the run of equal letters, and of neighbours on the keyboard, from each place ends
    for i in range(n - 2, -1, -1):
        runs[i] = runs[i + 1] if value[i] == value[i + 1] else i + 1
        walks[i] = walks[i + 1] if (low[i], low[i + 1]) in NEXT else i + 1
    for i in range(n):
        at = best[i]
        best[i + 1] = min(best[i + 1], at + step)
        for j in range(i + 3, min(n, i + MAX_SPAN) + 1):
            if (rank := RANK.get(low[i:j])) is not None:
                best[j] = min(best[j], at + math.log10(rank) + (0.3 if value[i:j] != low[i:j] else 0) + 0.3)
        if m := DATE.match(value, i):
            best[m.end()] = min(best[m.end()], at + (2.1 if m.end() - i == 4 else 4.6))
        for ends, cost in ((runs, lambda k: step + math.log10(k)), (walks, lambda k: WALK + math.log10(4 * k))):
            # every end within MAX_SPAN, and the whole of a longer one, so a value of equal letters takes linear time
            for j in {*range(i + 3, min(ends[i], i + MAX_SPAN) + 1), ends[i]}:
                if j - i >= 3:
                    best[j] = min(best[j], at + cost(j - i))
    return best[n]


def spans(text: str | None, min_guess: float = MIN_GUESS) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed in KINDS."""
    if not text:
        return []
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    out += [(*m.span(m.lastgroup), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[m.lastgroup]) >= min_guess]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by mark."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for s, e, _ in found:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans as an array of (start, end, kind) of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t)] for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, spans array<struct<start: bigint, end: bigint, kind: string>>")


def digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"]):
                found = spans(t)
                base = [x for x in found if x[2] != "guess"]
                rows.append((i, *(sum(x[2] == k for x in base) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
