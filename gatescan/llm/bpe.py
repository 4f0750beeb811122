"""Operator 1: byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that lies inside no vocabulary token can never be merged across, so a cut there is certain.
The cuts of a whole block of texts are found at once from a 256 x 256 table; the fragments between them are encoded
independently of each other (each distinct one once, many at a time) and their ids are concatenated.

A cut is made only where it also leaves the vocabulary's pre-splitting pattern unchanged: the character on the left must be
ASCII or of two bytes from U+00C0 on, and no white space (the pattern looks ahead from white space); the byte on the right
must start a character and must be no apostrophe unless an ASCII letter or digit precedes it (an apostrophe at a fragment's
start could look like a contraction).

Texts that hold an added token's string, such as <|endoftext|>, get that token's id there, as the tokenizers library does.
Null texts count as empty; empty texts have no ids. Ids leave as little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatescan.llm.arrays import SHORT, eights, group_starts, heads, slice_hashes

#: The pattern of byte-level pre-splitting that belongs to such vocabularies (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word of ASCII letters and U+00C0 to U+00FF without the two signs there, after a space or none: one piece of that pattern.
_ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_NO_RANK, _NO_KEY = np.uint32(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fragments remembered in a worker between blocks, the longest of them in bytes, and bytes of text encoded at once. Longer ones
#: are encoded each time, so the memory of the others (at most 64 + 4 * 64 bytes and their objects) is bounded by their number.
CACHED_FRAGMENTS, CACHED_BYTES = 400_000, 64
BLOCK_BYTES = 4 << 20
#: New fragments whose merges are done together, so that their arrays stay in a processor's cache.
MERGED_AT_ONCE = 1 << 14


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, inverted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Lookup:
    """An immutable hash table from 64-bit keys to 32-bit values that NumPy can read many keys of at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 19):
        self.levels = []
        left, salt = np.arange(len(keys)), 0
        while len(left):
            factor = np.uint64((0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * salt) & 0xFFFFFFFFFFFFFFFF | 1)
            shift = np.uint64(64 - bits)
            slot = (keys[left] * factor) >> shift
            table_keys, table_values = np.full(1 << bits, _NO_KEY), np.full(1 << bits, _NO_RANK)
            _, first = np.unique(slot, return_index=True)
            table_keys[slot[first]], table_values[slot[first]] = keys[left[first]], values[left[first]]
            self.levels.append((factor, shift, table_keys, table_values))
            left, salt, bits = np.delete(left, first), salt + 1, max(10, bits - 2)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), _NO_RANK)
        left = None  # the keys not found yet whose slots were taken by others on each level so far
        for factor, shift, table_keys, table_values in self.levels:
            own = keys if left is None else keys[left]
            slot = ((own * factor) >> shift).view(np.int64)
            there = table_keys.take(slot, mode="clip")
            hit = np.flatnonzero(there == own)
            out[hit if left is None else left[hit]] = table_values[slot[hit]]
            more = np.flatnonzero((there != own) & (there != _NO_KEY))
            left = more if left is None else left[more]
        return out


def distinct_slices(buf: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """buf is cut before each start (the first is 0). Which slices are the distinct ones, and for each slice its number among them.
    All bytes of slices of one hash are compared; should they differ, every slice counts as distinct."""
    data, every, eight = np.frombuffer(buf, dtype=np.uint8), np.arange(len(starts)), eights(buf)
    ends = np.append(starts[1:], len(buf))
    size, bits = ends - starts, np.uint64(max(1, (len(starts) - 1).bit_length()))
    head = heads(eight, starts, size)
    key = slice_hashes(data, starts, ends, eight, head) >> bits << bits | every.astype(np.uint64)  # hash and slice in one integer, which sorts fastest
    key.sort()
    order = (key & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    at = group_starts(key >> bits)
    first, number = order[at], np.empty(len(starts), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
    same = first[number]
    if (size != size[same]).any() or (head != head[same]).any():
        return every, every
    left, done = np.flatnonzero((size > 8) & (same != every)), 8
    while len(left) and done < SHORT:
        own, other, rest = starts[left] + done, starts[same[left]] + done, size[left] - done
        if (heads(eight, own, rest) != heads(eight, other, rest)).any():
            return every, every
        done += 8
        left = left[size[left] > done]
    if any(buf[a : a + n] != buf[b : b + n] for a, b, n in zip(starts[left].tolist(), starts[same[left]].tolist(), size[left].tolist(), strict=True)):
        return every, every
    return first, number


class Codec:
    """Encoder and decoder of one byte-level vocabulary file (JSON, BPE with merges). Lives in a worker process."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        byte_of = _byte_of_char()
        vocab = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token: list[bytes] = [b""] * size
        inside = np.zeros((256, 256), dtype=bool)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.token[i] = token
        for token in vocab:
            for pair in zip(token, token[1:], strict=False):
                inside[pair] = True
        byte = np.arange(256)
        alnum = ((byte | 0x20 >= 0x61) & (byte | 0x20 <= 0x7A) & (byte < 128)) | ((byte >= 0x30) & (byte <= 0x39))
        plain = (byte < 128) & ~np.isin(byte, [*range(9, 14), *range(0x1C, 0x21)])
        right = (byte & 0xC0) != 0x80
        cut = np.where(plain, 1, np.where((byte & 0xC0) == 0x80, 2, 0))[:, None] * (~inside & right[None, :])
        cut[:, ord("'")] *= alnum
        self.cut = cut.astype(np.uint8).reshape(-1)
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.uint64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        raw = [(bytes(byte_of[c] for c in a), bytes(byte_of[c] for c in b)) for a, b in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in raw], dtype=np.uint64)
        self.made = np.array([vocab[a + b] for a, b in raw], dtype=np.uint64)
        self.rank = _Lookup(keys, np.arange(len(raw), dtype=np.uint32))
        self.split = regex.compile(_PATTERN)
        self.special = regex.compile(b"|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known: dict[bytes, bytes] = {}

    def fragments(self, sections: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The sections joined, where each fragment begins in order, and how many each section has. An empty section has none."""
        lengths = np.array(list(map(len, sections)), dtype=np.int64)
        counts, full = np.zeros(len(sections), dtype=np.int64), np.flatnonzero(lengths)
        buf = b"".join(sections)
        if not buf:
            return buf, np.empty(0, dtype=np.int64), counts
        data = np.frombuffer(buf, dtype=np.uint8)
        kind = self.cut[data[:-1].astype(np.uint16) << 8 | data[1:]]
        cut = np.empty(len(data), dtype=bool)  # before this byte
        cut[1:] = kind == 1
        perhaps = np.flatnonzero(kind == 2)
        lead = data[perhaps - 1]
        cut[perhaps[(lead >= 0xC3) & (lead <= 0xDF)] + 1] = True
        begins = (np.cumsum(lengths) - lengths)[full]
        cut[begins] = True
        at = np.flatnonzero(cut)
        counts[full] = np.diff(np.append(np.searchsorted(at, begins), len(at)))
        return buf, at, counts

    def pieces(self, fragment: bytes) -> list[bytes]:
        if _ONE_WORD(fragment):
            return [fragment]
        if fragment[:1] == b"\n" and _ONE_WORD(fragment[1:]):
            return [b"\n", fragment[1:]]
        return [p.encode() for p in self.split.findall(fragment.decode())]

    def merge(self, fragments: list[bytes]) -> list[bytes]:
        """The ids of each fragment. Rounds over all of them: in each piece the pair of lowest rank is merged wherever it stands.

        That equals merging one pair at a time, as a merge can only create pairs of higher rank.
        """
        pieces, counts, at = [], np.ones(len(fragments), dtype=np.int64), 0  # no list for each fragment, which the garbage collector would walk
        for k in [k for k, f in enumerate(fragments) if not _ONE_WORD(f)]:
            own = self.pieces(fragments[k])
            pieces += fragments[at:k] + own
            counts[k], at = len(own), k + 1
        pieces += fragments[at:]
        tokens = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        sizes = np.array(list(map(len, pieces)), dtype=np.int64)
        final = np.zeros(len(pieces), dtype=np.int64)
        number, done = np.arange(len(pieces)), []
        starts = np.cumsum(sizes) - sizes
        rank = np.full(len(tokens), _NO_RANK)
        rank[:-1] = self.rank.get(tokens[:-1] << np.uint64(32) | tokens[1:])
        rank[starts + sizes - 1] = _NO_RANK
        while len(tokens):
            lowest = np.minimum.reduceat(rank, starts)
            if (ended := lowest == _NO_RANK).any():
                over = np.repeat(ended, sizes)
                done.append((number[ended], sizes[ended], tokens[over]))
                tokens, rank, number, sizes, lowest = tokens[~over], rank[~over], number[~ended], sizes[~ended], lowest[~ended]
                starts = np.cumsum(sizes) - sizes
                if not len(tokens):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            apart = np.diff(at, prepend=-2) > 1
            if not apart.all():  # of overlapping pairs, every second one from the left
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(apart, index, 0))) % 2 == 0]
            tokens[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]  # a pair that ends a piece has no rank, and so ends it now
            keep = np.ones(len(tokens), dtype=bool)
            keep[at + 1] = False
            ends = np.zeros(len(tokens), dtype=bool)
            ends[starts + sizes - 1] = True
            ends[at] = ends[at + 1]
            left = np.flatnonzero(keep)
            tokens, rank, ends = tokens[left], rank[left], ends[left]
            at = at - np.arange(len(at))
            again = np.concatenate((at, at[at > 0] - 1))
            again = again[~ends[again]]
            rank[again] = self.rank.get(tokens[again] << np.uint64(32) | tokens[again + 1])
            rank[at[ends[at]]] = _NO_RANK
            stop = np.flatnonzero(ends) + 1
            sizes = np.diff(stop, prepend=0)
            starts = stop - sizes
        if not done:
            return [b""] * len(fragments)
        number, sizes = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        tokens = np.concatenate([d[2] for d in done]).astype("<u4")
        final[number] = sizes
        target = np.cumsum(final) - final
        ids = np.empty(len(tokens), dtype="<u4")
        ids[np.repeat(target[number] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(tokens))] = tokens
        per = np.cumsum(counts)
        ends = np.append(0, np.cumsum(final))[per] * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes of little-endian unsigned 32-bit integers."""
        if self.special and any(self.special.search(t) for t in texts):
            sections, owner = [], []
            for k, t in enumerate(texts):
                at = 0
                for m in self.special.finditer(t):
                    sections += [t[at : m.start()], m[0]]
                    owner += [k, -self.added[m[0]] - 1]
                    at = m.end()
                sections.append(t[at:])
                owner.append(k)
            plain = iter(self._encode([s for s, k in zip(sections, owner, strict=True) if k >= 0]))
            out, at = [b""] * len(texts), 0
            for k in owner:
                if k >= 0:
                    at = k
                    out[at] += next(plain)
                else:
                    out[at] += (-k - 1).to_bytes(4, "little")
            return out
        return self._encode(texts)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        buf, starts, counts = self.fragments(texts)
        if not len(starts):
            return [b""] * len(texts)
        first, number = distinct_slices(buf, starts)
        begin, end = starts[first].tolist(), np.append(starts, len(buf))[first + 1].tolist()
        found = [buf[a:b] for a, b in zip(begin, end, strict=True)]
        ids = list(map(self.known.get, found))
        new = [f for f, i in zip(found, ids, strict=True) if i is None]
        if len(self.known) + len(new) > CACHED_FRAGMENTS:  # those of this block stay
            self.known = {f: i for f, i in zip(found, ids, strict=True) if i is not None}
        if new:
            made = [i for at in range(0, len(new), MERGED_AT_ONCE) for i in self.merge(new[at : at + MERGED_AT_ONCE])]
            self.known.update((f, i) for f, i in zip(new, made, strict=True) if len(f) <= CACHED_BYTES)
            left = iter(made)
            ids = [next(left) if i is None else i for i in ids]
        sizes = np.array(list(map(len, ids)), dtype=np.int64) // 4
        tokens, at, size = np.frombuffer(b"".join(ids), dtype="<u4"), (np.cumsum(sizes) - sizes)[number], sizes[number]
        ends = np.cumsum(size)
        raw = tokens[np.repeat(at - ends + size, size) + np.arange(ends[-1])].tobytes()
        ends = (4 * np.append(0, ends)[np.cumsum(counts)]).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the ids' text; bytes that form no character become U+FFFD. Special tokens keep their strings."""
        raw = b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, read once in each worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes together."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def raw_texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary) for every row; a null text counts as empty, a null id stays. Other columns are not read.

    Rows are independent: no shuffle, repeated rows give repeated results, an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for whole in batches:
            for b in blocks(whole, "t"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.encode(raw_texts(b.column(1))), pa.binary())], [id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, ids binary")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded string) from binary ids; null ids decode to the empty string."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for whole in batches:
            for b in blocks(whole, "ids"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x).decode() for x in raw_texts(b.column(1))], pa.string())], [id_col, "decoded"])

    return encoded.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {id_type}, decoded string")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary, decoded string): encoding and the decoding of its result in one pass over the rows."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for whole in batches:
            for b in blocks(whole, "t"):
                ids = c.encode(raw_texts(b.column(1)))
                text = [c.decode(x).decode() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string())], [id_col, "ids", "decoded"])

    return docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, ids binary, decoded string")
