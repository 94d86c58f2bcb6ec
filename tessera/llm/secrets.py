"""Secret scans: known shapes, and Shannon entropy in a sliding window.

Two layers look at every whole text.

*Base rules* are three patterns (``assign``, ``access``, ``hex``), each matched leftmost and
without overlaps, after which matches that are too short are dropped.  A span is the whole
match, in code points, end exclusive.

*Entropy*: a candidate is a maximal run of characters that keys are written in.  Base spans and
allow-listed stretches (identifiers in UUID form, digests after a ``sha256-`` marker, alphabets,
placeholder words) are cut out of it, and a window slides over each part that is left, so what
stands beside an allowed stretch is still judged.  The Shannon entropy of the window is kept up
to date by adding one character and removing one: the counts change by one each, and so does
the sum of ``n log n`` terms.  There are two character classes: hexadecimal digits (looked for
in every stretch of them, also inside a longer run) and the base-64 alphabet (windows with a
character that is no hexadecimal digit).  A window needs a digit and a letter, which leaves out
words, paths, numbers and dates.  Windows above the class's threshold are joined into spans.

Defined results: null and empty texts have no spans; the digest of "no base spans" is the
SHA-256 of the empty string; texts of any length are read whole; an empty table gives an empty
result; repeated rows, and rows of one id, get a result each; a null id stays null; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import _base

# The three base shapes, as the result contract states them.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 32 or more is the same as a maximal run that is then tested for length.
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_DIGITS = frozenset("0123456789")
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_NO_HEX = (_LETTERS | frozenset("+/_=-")) - _HEX_DIGITS


@dataclass(frozen=True)
class Config:
    hex_window: int = 20
    hex_bits: float = 3.0
    base64_window: int = 20
    base64_bits: float = 3.75


# Stretches that look random by design, or stand for a value, and carry no secret.
ALLOWED = re.compile(
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"  # UUID
    r"|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+"  # subresource integrity
    r"|(?i:0123456789|abcdefghij|example|x{6,}|placeholder|changeme)"
)
_HEX_RUN = re.compile(r"[0-9a-fA-F]+")


def high_entropy_windows(text: str, width: int, least: float, needs: tuple = ()) -> list[tuple[int, int]]:
    """Joined windows of ``width`` characters with at least ``least`` bits a character, and at
    least one character of each set in ``needs``.

    ``sum(n log2 n)`` over the counts is updated for the one character that enters and the
    one that leaves, so a step costs the same whatever the width.
    """
    if len(text) < width:
        return []
    counts: dict[str, int] = {}
    spread = 0.0
    term = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    whole = math.log2(width)
    found: list[tuple[int, int]] = []
    latest = [-1] * len(needs)
    for i, c in enumerate(text):
        for k, wanted in enumerate(needs):
            if c in wanted:
                latest[k] = i
        if i >= width:
            old = text[i - width]
            m = counts[old]
            counts[old] = m - 1
            spread += term[m - 1] - term[m]
        n = counts.get(c, 0)
        counts[c] = n + 1
        spread += term[n + 1] - term[n]
        start, end = i - width + 1, i + 1
        if start >= 0 and whole - spread / width >= least - 1e-9 and all(at >= start for at in latest):
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], end)
            else:
                found.append((start, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if _KEYWORD.search(text):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def _free(start: int, end: int, barred: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the barred stretches leave of a range."""
    for a, b in sorted(barred):
        if a > start:
            yield start, min(a, end)
        start = max(start, b)
        if start >= end:
            return
    yield start, end


def entropy_spans(text: str, taken: list[tuple[str, int, int]], config: Config = Config()) -> list[tuple[str, int, int]]:
    spans: list[tuple[str, int, int]] = []
    base: list[tuple[int, int]] = []  # disjoint, in order
    for a, b in sorted((a, b) for _, a, b in taken):
        if base and a <= base[-1][1]:
            base[-1] = (base[-1][0], max(base[-1][1], b))
        else:
            base.append((a, b))
    ends = [b for _, b in base]
    for m in _CANDIDATE.finditer(text):
        barred = []
        for k in range(bisect_right(ends, m.start()), len(base)):
            if base[k][0] >= m.end():
                break
            barred.append(base[k])
        barred += [x.span() for x in ALLOWED.finditer(text, m.start(), m.end())]
        for start, end in _free(m.start(), m.end(), barred):
            piece = text[start:end]
            for h in _HEX_RUN.finditer(piece):
                at = start + h.start()
                spans += [("entropy_hex", at + a, at + b) for a, b in high_entropy_windows(h[0], config.hex_window, config.hex_bits, (_DIGITS, _LETTERS))]
            found = high_entropy_windows(piece, config.base64_window, config.base64_bits, (_DIGITS, _LETTERS, _NO_HEX))
            spans += [("entropy_base64", start + a, start + b) for a, b in found]
    return spans


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan_text(text: str | None, config: Config = Config()) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256 and all spans of one text."""
    text = text or ""
    base = base_spans(text)
    kinds = [k for k, _, _ in base]
    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
    spans = _joined(base + entropy_spans(text, base, config))
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, spans


def scan(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    fields = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[scan_text(t.as_py(), config) for t in batch.column(1)])) or [()] * len(fields)
            columns = [pa.array(c, kind) for c, kind in zip(found, fields.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *fields])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(_base.documents(spark, sf_dir))
