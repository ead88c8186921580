"""Delimiter detection from the first rows of a file."""

from __future__ import annotations

import json
from collections.abc import Iterable

from ..plans.errors import DelimitedError
from ..plans.limits import PROBE_BYTES, PROBE_ROWS
from .codecs import ENDINGS, Zip

# Candidates in order, and what file name endings suggest.
CANDIDATES = (",", "\t", ";", "|", ":", "^", "~")
HINTS = {".csv": ",", ".psv": "|", ".tab": "\t", ".tsv": "\t"}


def hint_of(path: str, compression=None) -> str | None:
    name = (compression.entry if isinstance(compression, Zip) and compression.entry != "*" else path).rsplit("/", 1)[-1].lower()
    if compression and not isinstance(compression, Zip):
        end = next((e for e in sorted(ENDINGS, key=len, reverse=True) if name.endswith(e)), "")
        name = name[: len(name) - len(end)]
    return next((d for e, d in HINTS.items() if name.endswith(e)), None)


def detect_delimiter(chunks: Iterable[bytes], hint: str | None = None) -> str:
    """The candidate that occurs equally often, outside quotes, in all of the first rows.

    At most PROBE_BYTES and PROBE_ROWS are looked at; blank lines are skipped; any quote toggles
    quoting.  A stable hint wins, else the one most frequent.
    """
    data, ended = b"", True
    for c in chunks:
        data += c
        if len(data) > PROBE_BYTES:
            data, ended = data[:PROBE_BYTES], False
            break
    rows: list[list[int]] = []
    counts, quoted, filled = [0] * len(CANDIDATES), False, False
    codes = {ord(c): i for i, c in enumerate(CANDIDATES)}
    for b in data:
        if b == 34:
            quoted, filled = not quoted, True
        elif not quoted and b in (10, 13):
            if filled:
                rows.append(counts)
                if len(rows) == PROBE_ROWS:
                    break
            counts, filled = [0] * len(CANDIDATES), False
        else:
            filled = True
            if not quoted and b in codes:
                counts[codes[b]] += 1
    else:
        if filled and ended and not quoted:
            rows.append(counts)
    if not rows:
        raise DelimitedError("delimiter auto-detection failed: input has no complete rows")
    stable = {c: rows[0][i] for i, c in enumerate(CANDIDATES) if rows[0][i] and all(r[i] == rows[0][i] for r in rows)}
    if hint in stable:
        return hint
    if not stable:
        raise DelimitedError("delimiter auto-detection failed: no supported delimiter has a stable positive count across the probe rows; specify delimiter explicitly")
    best = max(stable.values())
    top = [c for c, n in stable.items() if n == best]
    if len(top) > 1:
        raise DelimitedError("delimiter auto-detection is ambiguous between " + ", ".join(map(json.dumps, top)) + "; specify delimiter explicitly")
    return top[0]
