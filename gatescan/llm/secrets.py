"""Operator 6: secret scanning by sliding-window Shannon entropy.

Base spans come from three plain patterns (kinds assign, access and hex). The method adds spans of kind entropy: candidate
strings are maximal runs of characters that keys are made of; over each, a window of fixed size slides, its entropy kept up by
counts that change by one character a step. Windows above the threshold of their character class are merged. Windows that touch
a mark of the allow-list (placeholders, identifiers of known harmless shape), paths of short plain segments and spans that lie
within a base span are suppressed. Strings of letters alone are judged by their entropy like all others.

Candidates are found for a whole block of texts at once, so texts without any cost little. Spans are (kind, start, end) in
code points, end exclusive. Defined cases: null text is empty and has no spans; a null id stays; rows are independent, repeated
ones repeat their spans; an empty table gives an empty result; other columns are not read by scan() and stay in redact_secrets().
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatescan.llm.bpe import blocks, raw_texts

KINDS = ("assign", "access", "hex", "entropy")
#: Base patterns, and the length that the named group needs (fixed values).
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ASSIGN_WORDS = re.compile(rb"passw|secret|token|api_?key", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
#: Characters of a sliding window, and the entropy in bits that a window of each class needs.
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "digit": math.inf, "alpha": 4.1, "mixed": 3.7}
#: Marks of harmless strings: placeholders and identifiers of version 1 to 5 form. A window that touches one is no secret.
_MARKS = re.compile(rb"EXAMPLE|example|placeholder|xxxx|XXXX|0123456789|abcdefgh|ABCDEFGH|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Harmless paths: short segments that are a number, or up to three names with a number behind each.
_SEGMENT = rb"(?=[a-z0-9_-]{0,20}(?:/|\Z))(?:(?:[a-z_-]+[0-9]{0,4}){0,3}|[0-9]{1,8})"
_PATH = re.compile(rb"(?:https?)?/{0,2}" + _SEGMENT + rb"(?:/" + _SEGMENT + rb")+")


def _class_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_HEX = _class_table(b"0123456789abcdef")
_CANDIDATE = _class_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_XLOGX = np.array([0.0] + [c * math.log2(c) for c in range(1, 4096)])


def _runs(data: np.ndarray, table: np.ndarray, least: int) -> list[tuple[int, int]]:
    inside = np.concatenate(([False], table[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    a, b = edge[0::2], edge[1::2]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def _char_class(window_counts: tuple[int, int, int]) -> str:
    hexes, digits, letters = window_counts
    if digits == WINDOW:
        return "digit"
    if hexes == WINDOW and digits:
        return "hex"
    return "alpha" if not digits else "mixed"


def entropy_spans(s: bytes) -> list[tuple[int, int]]:
    """Merged windows of a candidate string whose entropy reaches the threshold of their class."""
    counts = [0] * 256
    total = 0.0  # sum of c * log2(c)
    hexes = digits = letters = 0
    out: list[tuple[int, int]] = []
    for k, c in enumerate(s):
        total += _XLOGX[counts[c] + 1] - _XLOGX[counts[c]]
        counts[c] += 1
        hexes += 48 <= c <= 57 or 97 <= c <= 102
        digits += 48 <= c <= 57
        letters += 65 <= c <= 90 or 97 <= c <= 122
        if k >= WINDOW:
            d = s[k - WINDOW]
            total += _XLOGX[counts[d] - 1] - _XLOGX[counts[d]]
            counts[d] -= 1
            hexes -= 48 <= d <= 57 or 97 <= d <= 102
            digits -= 48 <= d <= 57
            letters -= 65 <= d <= 90 or 97 <= d <= 122
        if k >= WINDOW - 1 and math.log2(WINDOW) - total / WINDOW >= THRESHOLDS[_char_class((hexes, digits, letters))]:
            start = k - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((start, k + 1))
    return out


def _suspicious(s: bytes) -> list[tuple[int, bytes]]:
    """The parts of a candidate string that lie between marks, with their places; none of a harmless path."""
    cuts = [(m.start(), m.end()) for m in _MARKS.finditer(s)]
    parts = [(a, s[a:b]) for a, b in zip([0, *(e for _, e in cuts)], [*(b for b, _ in cuts), len(s)], strict=True)]
    return [(a, part) for a, part in parts if len(part) >= WINDOW and not _PATH.fullmatch(part)]


def scan_block(texts: list[bytes]) -> list[list[tuple[int, str, int]]]:
    """(start, kind, end) in bytes for each text, ordered by start and then kind as listed."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    buf = b"\n".join(texts)
    data = np.frombuffer(buf, dtype=np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.empty(0, dtype=np.int64)
    for k, t in enumerate(texts):
        if _ASSIGN_WORDS.search(t):
            found[k] += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= ASSIGN_LENGTH]
        if b"AKIA" in t:
            found[k] += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= ACCESS_LENGTH]

    def owner(a: int) -> int:
        return int(np.searchsorted(begins, a, side="right")) - 1

    for a, b in _runs(data, _HEX, HEX_LENGTH):
        k = owner(a)
        found[k].append((a - int(begins[k]), 2, b - int(begins[k])))
    for a, b in _runs(data, _CANDIDATE, WINDOW):
        s = buf[a:b]
        if not any(48 <= c <= 57 for c in s) and len(set(s)) < 18:
            continue
        k = owner(a)
        base = [(x, y) for x, kind, y in found[k] if kind < 3]
        for x, y in [(p + x, p + y) for p, part in _suspicious(s) for x, y in entropy_spans(part)]:
            x, y = x + a - int(begins[k]), y + a - int(begins[k])
            if not any(p <= x and y <= q for p, q in base):
                found[k].append((x, 3, y))
    return [[(a, KINDS[kind], b) for a, kind, b in sorted(f)] for f in found]


def _in_code_points(text: bytes, spans: list[tuple[int, str, int]]) -> list[dict]:
    if not spans:
        return []
    if text.isascii():
        return [{"kind": k, "start": a, "end": b} for a, k, b in spans]
    start = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    at = lambda p: int(start[p - 1]) if p else 0
    return [{"kind": k, "start": at(a), "end": at(b)} for a, k, b in spans]


def redact(text: bytes, spans: list[tuple[int, str, int]], mark: bytes = b"[SECRET]") -> bytes:
    """The text with each maximal union of spans replaced by a mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return b"".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<kind,start,end>>) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in blocks(whole, "t"):
                texts = raw_texts(b.column(1))
                spans = [_in_code_points(t, s) for t, s in zip(texts, scan_block(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], [id_col, "spans"])

    return docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, with every span in text_col replaced by [SECRET]. Null texts stay null."""
    n = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for b in blocks(whole, text_col):
                column = b.column(n)
                texts = raw_texts(column)
                spans = scan_block(texts)
                if any(spans):
                    clean = [None if x is None else redact(t, s).decode() for x, t, s in zip(column.to_pylist(), texts, spans, strict=True)]
                    b = b.set_column(n, b.schema.field(n), pa.array(clean, b.schema.field(n).type))
                yield b

    return docs.mapInArrow(run, docs.schema)
