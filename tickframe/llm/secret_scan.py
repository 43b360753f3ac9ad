"""Secrets in texts: credential patterns, and high-entropy strings that no pattern names.

The entropy scan looks at candidate strings, the maximal runs of characters
that encoded keys are made of. A window slides over each candidate; its
Shannon entropy is kept up to date from the counts of the two characters that
leave and enter. A window counts when its entropy reaches the threshold of its
character class. Candidates that read as words, numbers, dates, paths or
versions are on the allow-list.

Null and empty texts have no spans. Texts are read whole, whatever their
length. Every row gets its own result, so repeated rows and ties are alike; an
empty table gives an empty table. A column named like the result is replaced,
all others stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm import arrays

# The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

WINDOW = 20
#: Bits a character at which a window of the class counts; a class without an entry never does.
THRESHOLDS = {"hex": 2.9, "alnum": 3.6, "base64": 3.6}
#: Candidates that match one of these wholly are not secrets: runs of letters or of digits joined by punctuation, and UUIDs.
ALLOW = (
    r"[+/_.=-]*(?:(?:[A-Za-z]+|[0-9]+)(?:[+/_.=-]+|$))*",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}[.=-]*",
)

SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _table(characters: str) -> np.ndarray:
    out = np.zeros(129, bool)
    out[[ord(c) for c in characters]] = True
    return out


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_HEX = _table(_DIGITS + "abcdef")
_TOKEN = _table(_DIGITS + _LOWER + _LOWER.upper() + "+/_.=-")


def _runs(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of True of at least that length."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist()))


def _class(counts: dict[str, int]) -> str:
    """The narrowest class that holds the window's characters; letters alone or digits alone are words and numbers."""
    present = [c for c, n in counts.items() if n]
    if not any(c.isdigit() for c in present) or not any(c.isalpha() for c in present):
        return "plain"
    if all(c in "0123456789abcdef" for c in present) or all(c in "0123456789ABCDEF" for c in present):
        return "hex"
    return "alnum" if all(c.isalnum() for c in present) else "base64"


def entropy_spans(candidate: str, window: int, thresholds: dict[str, float]) -> list[tuple[int, int]]:
    """Unions of the windows of ``candidate`` that reach their class's threshold."""
    weigh = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weigh[n + 1] - weigh[n]
        if i >= window:
            gone = candidate[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += weigh[n - 1] - weigh[n]
        if i >= window - 1 and math.log2(window) - total / window >= thresholds.get(_class(counts), math.inf) - 1e-9:
            if spans and i - window + 1 <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def _assigned(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(w in low for w in ASSIGN_WORDS):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]


def _access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS] if "AKIA" in text else []


def secret_spans(
    text: Column, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allow: Sequence[str] = ALLOW
) -> Column:
    """The spans of a text by start and kind; offsets are code points, ends are exclusive."""
    allowed = re.compile("|".join(f"(?:{x})" for x in allow)) if allow else None

    def scan(texts: list[str]) -> list[list[dict]]:
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.minimum(points, 128)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, text in enumerate(texts):
            found[i] += [(a, 0, b) for a, b in _assigned(text)] + [(a, 1, b) for a, b in _access(text)]
        for a, b in _runs(_HEX[points], MIN_HEX):
            i = int(np.searchsorted(begins, a, "right")) - 1
            found[i].append((a - int(begins[i]), 2, b - int(begins[i])))
        for a, b in _runs(_TOKEN[points], window):
            i = int(np.searchsorted(begins, a, "right")) - 1
            a, b = a - int(begins[i]), b - int(begins[i])
            candidate = texts[i][a:b]
            if not any(c.isdigit() for c in candidate) or (allowed and allowed.fullmatch(candidate)):
                continue
            base = [(s, e) for s, k, e in found[i] if k < 3]
            found[i] += [
                (a + s, 3, a + e)
                for s, e in entropy_spans(candidate, window, thresholds)
                if not any(p <= a + s and a + e <= q for p, q in base)
            ]
        return [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(rows)] for rows in found]

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [pa.array(scan(["" if t is None else t for t in part.column(0).to_pylist()]), _SPAN) for part in arrays.slices(batch, "text")]
        return pa.concat_arrays(parts) if parts else pa.array([], _SPAN)

    return spans(text)


def find_secrets(df: DataFrame, text: str = "text", into: str = "secret_spans", **options) -> DataFrame:
    """``df`` with the spans of each text."""
    return arrays.bounded_batches(df).withColumn(into, secret_spans(F.col(text), **options))


def redact(df: DataFrame, text: str = "text", spans: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of a text replaced by ``mark``; spans that touch or overlap become one mark."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, rows in zip(texts.to_pylist(), found.to_pylist()):
            if rows:
                done, parts = 0, []
                for row in rows:
                    if row["start"] > done or not parts:
                        parts += [t[done : row["start"]], mark]
                    done = max(done, row["end"])
                t = "".join([*parts, t[done:]])
            out.append(t)
        return pa.array(out, pa.string())

    # Rows without spans keep their text without a round trip through Python.
    has = F.size(F.coalesce(F.col(spans), F.array().cast(SPANS))) > 0
    return df.withColumn(text, F.when(has, cut(F.when(has, F.col(text)), F.col(spans))).otherwise(F.col(text)))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
