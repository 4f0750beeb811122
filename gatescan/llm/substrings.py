"""Operator 5: substring dedup by Rabin-Karp hashes of every fixed-length window of words.

Each chunk of documents sends the hashes of its distinct windows with the smallest document that has them; Spark brings equal
hashes together and answers whether a smaller document exists in another chunk. A window is repeated if its words also start in
a document with a smaller id; overlapping repeated windows merge into maximal removal intervals, and the words in them go.
Windows are judged on the input, not on what is left.

Hashes have 64 bits. With n distinct windows about n*n / 2**65 pairs collide: 0.001 over 10**8 windows.

Defined cases: null text has no words; a document of fewer words than the window keeps all; a null id is compared with nothing
and loses nothing; rows with the same id count as one document, so they do not remove each other's windows; within one document
a repeated window is kept. Words are those of `[^ \\t-\\r]+`, unchanged. All columns of the rows are carried along.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatescan.llm import chunks as C
from gatescan.llm.arrays import Words, find_words, group_starts, windows
from gatescan.llm.bpe import raw_texts

WINDOW = 13


def _windows_by_key(words: Words, ids: np.ndarray, valid: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest id of each, and for every window its document's id and the number of its key."""
    keys, owner, at = windows(words, size)
    use = valid[owner] if len(owner) else np.empty(0, dtype=bool)
    keys, owner, at = keys[use], owner[use], at[use]
    order = np.argsort(keys)
    starts = group_starts(keys[order])
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    own = ids[owner]
    least = np.minimum.reduceat(own[order], starts) if len(starts) else np.empty(0, dtype=np.int64)
    return keys[order][starts], least, number, at


def _open(rows: pa.Table, id_col: str, text_col: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    ids = rows.column(id_col).combine_chunks()
    return raw_texts(rows.column(text_col).combine_chunks()), np.array(ids.fill_null(0), dtype=np.int64), np.array(ids.is_valid())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, suffix: str = "") -> DataFrame:
    """All columns of docs, and n_words, n_removed, removed (array of maximal intervals of word numbers, end exclusive) and
    kept_text (the words that stay, joined by one space), each with the suffix; with the empty suffix, underscores are added until no column of docs has such a name."""
    while not suffix.strip("_") and {c + suffix for c in ("n_words", "n_removed", "removed", "kept_text")} & set(docs.columns):
        suffix += "_"
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    out = T.StructType([*docs.schema.fields, *(T.StructField(f.name + suffix, f.dataType) for f in T._parse_datatype_string("n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"))])
    chunks = C.checkpoint(C.pack(docs, text_col))
    bits = C.bucket_bits(C.total_bytes(chunks))

    def keys_of(rows: pa.Table):
        texts, ids, valid = _open(rows, id_col, text_col)
        keys, least, _, _ = _windows_by_key(find_words(texts), ids, valid, size)
        return keys, least

    def judge(ids, starts):
        least = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(ids))))
        return least < ids

    def finish(rows: pa.Table, elsewhere: np.ndarray) -> pa.Table:
        texts, ids, valid = _open(rows, id_col, text_col)
        words = find_words(texts)
        _, least, number, at = _windows_by_key(words, ids, valid, size)
        owner = np.searchsorted(words.offsets, at, side="right") - 1
        gone = at[(elsewhere[number] > 0) | (least[number] < ids[owner])]
        change = np.zeros(len(words.starts) + 1, dtype=np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + size, -1)
        covered = np.cumsum(change[:-1]) > 0
        n_words, n_removed, removed, kept = np.diff(words.offsets), [], [], []
        for k, text in enumerate(texts):
            part = covered[words.offsets[k] : words.offsets[k + 1]]
            split, count = text.split(), int(part.sum())
            n_removed.append(count)
            if count:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], part, [False])).astype(np.int8))).tolist()
                removed.append([{"start": a, "end": b} for a, b in zip(edge[0::2], edge[1::2], strict=True)])
                split = itertools.compress(split, (~part).tolist())
            else:
                removed.append([])
            kept.append(b" ".join(split).decode())
        columns = dict(zip(rows.schema.names, rows.columns, strict=True))
        columns |= {"n_words" + suffix: pa.array(n_words, pa.int64()), "n_removed" + suffix: pa.array(n_removed, pa.int64()), "removed" + suffix: pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_text" + suffix: pa.array(kept, pa.string())}
        return pa.table(columns)

    return C.gather(chunks, C.answer(C.scatter(chunks, keys_of, bits), judge), finish, out)
