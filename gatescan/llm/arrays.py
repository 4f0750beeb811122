"""NumPy helpers that run inside Spark tasks: word boundaries, word and window hashes, compact integer columns.

Everything here works on one bounded block of documents at a time and holds no state between tasks but small tables.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: The bytes that separate words: space and \t \n \v \f \r.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_BASE_BYTE = _U(0x9E3779B97F4A7C15)
_BASE_WORD = _U(0xD6E8FEB86659FD93)
#: Bytes hashed at once; a segment ends at a word's end, so one longer word makes a longer segment.
_SEGMENT = 1 << 16
#: Slices of up to so many bytes can be read eight bytes at a time, and so many slices at once, so that they stay in a processor's cache.
SHORT, _PART = 64, 1 << 13


def _random_bytes_table() -> np.ndarray:
    raw = b"".join(hashlib.sha256(b"byte %d" % i).digest()[:8] for i in range(256))
    return np.frombuffer(raw, dtype="<u8").copy() | _U(1)


_BYTE_VALUE = _random_bytes_table()


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as long as they are asked for."""

    def __init__(self, base: np.uint64):
        inverse = pow(int(base), -1, 1 << 64)
        self.bases = (base, _U(inverse))
        self.tables = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 2 * len(self.tables[0]))
            for k in (0, 1):
                t = np.full(size, self.bases[k], dtype=_U)
                t[0] = 1
                self.tables[k] = np.cumprod(t, dtype=_U)
        return self.tables[0], self.tables[1]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE_BYTE), _Powers(_BASE_WORD)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (multiply and xor-shift), so that every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """The words of a block of texts: byte positions in `buf`, 64-bit hashes, and each text's first word (n + 1 offsets)."""

    buf: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def find_words(texts: list[bytes], short: bool = False) -> Words:
    """Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r. Null texts must come as b''. short: hashes of the second
    kind of slice_hashes(), which cost less."""
    buf = b"\n" + b"\n".join(texts) + b"\n"
    data = np.frombuffer(buf, dtype=np.uint8)
    space = np.frombuffer(buf.translate(_SPACE.tobytes()), dtype=bool)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    offsets = np.searchsorted(starts, first)
    if not short:
        return Words(buf, starts, ends, slice_hashes(data, starts, ends), offsets)
    eight = eights(buf)
    return Words(buf, starts, ends, slice_hashes(data, starts, ends, eight, heads(eight, starts, ends - starts)), offsets)


def eights(buf: bytes) -> np.ndarray:
    """The eight bytes from each position of buf on as one integer, the first one lowest; zeros follow the end."""
    return np.ndarray(len(buf), "<u8", buf + bytes(8), strides=(1,))


def heads(eight: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each slice, or all of a shorter one. No slice is empty; slices of one size are equal if these are,
    as far as they reach."""
    out = np.empty(len(starts), dtype=_U)
    for a in range(0, len(starts), _PART):
        part = slice(a, a + _PART)
        np.left_shift(eight[starts[part]], (np.maximum(8 - size[part], 0) << 3).view(_U), out=out[part])
    return out


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, eight: np.ndarray | None = None, head: np.ndarray | None = None) -> np.ndarray:
    """Hashes of data[start:end] for ascending slices that don't overlap; equal bytes have equal hashes. With eights() and heads(),
    no slice may be empty, and the hashes are others: those of slices up to SHORT bytes come from eight bytes at a time."""
    if eight is not None:
        size, hashes = ends - starts, np.empty(len(starts), dtype=_U)
        for a in range(0, len(starts), _PART):
            part = slice(a, a + _PART)
            hashes[part] = mix64(head[part] + size[part].view(_U) * _BASE_WORD)
        left, done = np.flatnonzero(size > 8), 8
        while len(left) and done < SHORT:
            hashes[left] = mix64(hashes[left] * _BASE_BYTE + heads(eight, starts[left] + done, size[left] - done))
            done += 8
            left = left[size[left] > done]
        if len(left):
            hashes[left] = slice_hashes(data, starts[left], ends[left])
        return hashes
    hashes = np.empty(len(starts), dtype=_U)
    w = 0
    while w < len(starts):
        begin = int(starts[w])
        stop = max(w + 1, int(np.searchsorted(ends, begin + _SEGMENT, side="right")))
        end = int(ends[stop - 1])
        power, inverse = _BYTE_POWERS.get(end - begin + 1)
        terms = _BYTE_VALUE.take(data[begin:end], mode="clip")
        terms *= power[: end - begin]
        total = np.empty(end - begin + 1, dtype=_U)
        total[0] = 0
        np.cumsum(terms, out=total[1:])
        a, b = starts[w:stop] - begin, ends[w:stop] - begin
        hashes[w:stop] = (total[b] - total[a]) * inverse[a]
        w = stop
    return mix64(hashes)


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for each pair, whose ranges lie within the data; equal bytes have equal hashes."""
    power, inverse = _BYTE_POWERS.get(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=_U)
    total[0] = 0
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=total[1:])
    return (total[end] - total[start]) * inverse[start]


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of every `size` consecutive word hashes (len - size + 1 of them, none if there are fewer words)."""
    n = len(hashes)
    if n < size:
        return np.empty(0, dtype=_U)
    out = np.empty(n - size + 1, dtype=_U)
    step = 1 << 17
    for at in range(0, n - size + 1, step):
        part = hashes[at : min(n, at + step + size - 1)]
        power, inverse = _WORD_POWERS.get(len(part) + 1)
        total = np.empty(len(part) + 1, dtype=_U)
        total[0] = 0
        np.cumsum(part * power[: len(part)], out=total[1:])
        k = len(part) - size + 1
        out[at : at + k] = (total[size:] - total[:-size]) * inverse[:k]
    return mix64(out)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, index of the first word) of each window of `size` words that lies within one text."""
    hashes = rolling(words.hashes, size)
    owner = words.owner()
    at = np.flatnonzero(owner[: len(hashes)] == owner[size - 1 :]) if len(hashes) else np.empty(0, dtype=np.int64)
    return hashes[at], owner[at] if len(at) else at, at


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, lowest first, with as many planes as the largest needs.

    Planes of small numbers are mostly zeros, which Spark's shuffle compression removes.
    """
    values = np.ascontiguousarray(values, dtype="<u8")
    top = int(values.max()) if len(values) else 0
    planes = max(1, (top.bit_length() + 7) // 8)
    return values.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack_ints(data: bytes, n: int) -> np.ndarray:
    """The inverse of pack_ints for n values."""
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        raw = np.frombuffer(data, dtype=np.uint8)
        out[:, : len(raw) // n] = raw.reshape(-1, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as packed differences."""
    gaps = keys.astype(_U, copy=True)
    gaps[1:] -= keys[:-1]
    return pack_ints(gaps)


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_ints(data, n), dtype=_U)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.empty(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))
