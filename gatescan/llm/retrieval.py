"""Operator 11: ranked lexical search by dense blocked matrix products.

Items are ranked against all documents. Only terms that items hold matter: documents are read once and kept as short lists of
(term number, occurrences), a stored table, from which document frequencies, lengths and scores are taken. A task multiplies tiles:
items by their terms (weights times repeats) with terms by documents (impacts), in float64. All entries are whole numbers, and a tile of
terms is cut before any sum could reach 2^53, so products are exact; the tiles of an item's terms are added in 64-bit integers. From
each tile come the documents at least as good as the k-th, ties included, and a task keeps k of an item by (score, id). Tasks' lists
meet in two steps, so an item's candidates of all tasks never come to one task.

Items are taken in blocks of ITEM_ENTRIES distinct (item, term) entries (a longer item is a block of its own), which bounds what
is broadcast and what the driver holds; each block is one more pass over the documents.

Terms are maximal runs of characters other than `\\x00-\\x2F \\x3A-\\x40 \\x5B-\\x60 \\x7B-\\x7F`, A-Z lower-cased. The weight of a
term in df of N documents is floor(1000 ln((2N+2)/(2df+1))); its impact in a document of n terms is (10^9 tf) div (1000 tf + 12 m) with
m = 75 + (25 n N) div L, L being the terms of all documents.

Defined cases: null and empty texts have no terms, rank nowhere and aren't counted in N; a repeated row is a document (or an item) of
its own; null ids rank last among equal scores; equal (score, id) are in any order; items without a matching document give no row; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatescan.llm.chunks import stored
from gatescan.llm.sums import SALTS, collected
from gatescan.operators.scans import BLOCK, in_range_partitions, starts_of

TOP = 20
#: Distinct (item, term) entries of a block of items; items, terms and documents of a tile; terms of a part of the counts.
ITEM_ENTRIES, ITEM_TILE, TERM_TILE, DOC_TILE, PART = 1 << 18, 256, 2048, 1024, 4096
#: Impacts are below this, as 12 m is at least 900.
IMPACT = 1_000_000
EXACT = 1 << 53


def _plain() -> bytes:
    """A byte table: letters and digits stay, A-Z are lower-cased, other ASCII becomes a space, bytes of wider characters stay."""
    kept = lambda c: c >= 0x80 or chr(c).isalnum()
    return bytes(ord(chr(c).lower()) if c < 0x80 and kept(c) else c if kept(c) else 0x20 for c in range(256))


_PLAIN = _plain()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


@dataclass
class Items:
    """A block of items: their numbers, and the entries (term, weighted repeats) of each, which begin at offsets."""

    numbers: np.ndarray
    offsets: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray
    vocabulary: dict[bytes, int]


def _read_items(rows: list) -> Items:
    vocabulary: dict[bytes, int] = {}
    terms, repeats, offsets = [], [], [0]
    for r in rows:
        for term, q in Counter(terms_of(bytes(r.text or b""))).items():
            terms.append(vocabulary.setdefault(term, len(vocabulary)))
            repeats.append(q)
        offsets.append(len(terms))
    return Items(np.array([r.item for r in rows], dtype=np.int64), np.array(offsets), np.array(terms, dtype=np.int64), np.array(repeats, dtype=np.int64), vocabulary)


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item long, id, text binary, block long): item numbers the rows, block the blocks of about ITEM_ENTRIES entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entries = [len(set(terms_of(t.as_py() or b""))) + len(t.as_py() or b"") // 16 + 1 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(entries, pa.int64())], ["id", "text", "entries"])

    kind = items.schema[id_col].dataType.simpleString()
    sized = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, text binary, entries long")
    ranged = in_range_partitions(sized, ["id"], 64)
    starts = starts_of(ranged.groupBy(BLOCK).agg(F.sum("entries").alias("n")), [BLOCK]).select(BLOCK, "before")
    own = Window.partitionBy(BLOCK).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.withColumn("own", F.coalesce(F.sum("entries").over(own), F.lit(0))).join(starts, BLOCK)
    return stored(whole.select((F.shiftleft(BLOCK, 33) + F.col("__place")).alias("item"), "id", "text", F.floor((F.col("before") + F.col("own")) / ITEM_ENTRIES).cast("long").alias("block")))


def _postings(docs: DataFrame, id_col: str, text_col: str, items: Items) -> DataFrame:
    """(doc long, n long, terms array<int>, counts array<int>) of the documents with terms; of terms, those that the items hold."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            lengths, at, terms, counts = [], [0], [], []
            for t in b.column(1):
                found = terms_of(t.as_py() or b"")
                lengths.append(len(found))
                tally = Counter(map(get, found))
                tally.pop(None, None)
                terms += tally.keys()
                counts += tally.values()
                at.append(len(terms))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), *lists], ["doc", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, counts array<int>").where("n > 0")


def _frequencies(postings: DataFrame, terms: int) -> np.ndarray:
    """The documents that hold each term."""
    parts = -(-terms // PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * PART, dtype=np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "total": pa.array([x.tobytes() for x in total.reshape(parts, PART)], pa.binary())})

    got = collected(postings.select("terms").mapInArrow(run, "part int, total binary"))
    return np.concatenate([got[k] for k in range(parts)]) if got else np.zeros(parts * PART, dtype=np.int64)


@dataclass
class Tile:
    """Up to ITEM_TILE items with their own small vocabulary, cut into pieces whose sums stay below 2^53."""

    first: int
    local: np.ndarray  # a term's place in the tile, or -1
    pieces: list[tuple[int, int]]
    item: np.ndarray
    place: np.ndarray
    value: np.ndarray
    n_items: int


def _tiles(items: Items, weights: np.ndarray) -> list[Tile]:
    out = []
    for first in range(0, len(items.numbers), ITEM_TILE):
        last = min(len(items.numbers), first + ITEM_TILE)
        a, e = items.offsets[first], items.offsets[last]
        terms, value = items.terms[a:e], items.repeats[a:e] * weights[items.terms[a:e]]
        item = np.repeat(np.arange(last - first), np.diff(items.offsets[first : last + 1]))
        own = np.unique(terms)
        local = np.full(len(items.vocabulary), -1, dtype=np.int64)
        local[own] = np.arange(len(own))
        place = local[terms]
        largest = np.zeros(len(own), dtype=np.int64)
        np.maximum.at(largest, place, value)
        pieces, start, bound = [], 0, 0
        for k, v in enumerate(largest.tolist()):
            if k > start and (k - start == TERM_TILE or bound + v * IMPACT >= EXACT):
                pieces.append((start, k))
                start, bound = k, 0
            bound += v * IMPACT
        out.append(Tile(first, local, [*pieces, (start, len(own))] if len(own) else [], item, place, value, last - first))
    return out


def _scores(tile: Tile, terms: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores (items by documents, int64) of a tile of documents, given as entries (term, document, impact)."""
    total = np.zeros((tile.n_items, n_docs), dtype=np.int64)
    place = tile.local[terms]
    for a, e in tile.pieces:
        there, own = (place >= a) & (place < e), (tile.place >= a) & (tile.place < e)
        right, left = np.zeros((e - a, n_docs)), np.zeros((tile.n_items, e - a))
        right[place[there] - a, doc[there]] = impact[there]
        left[tile.item[own], tile.place[own] - a] = tile.value[own]
        total += (left @ right).astype(np.int64)
    return total


class _Best:
    """The best documents of each item so far: score, whether the id is null, id."""

    def __init__(self, n: int, top: int):
        self.top, self.rows = top, [np.empty((3, 0), dtype=np.int64) for _ in range(n)]
        self.least = np.ones(n, dtype=np.int64)  # a score that can still enter

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        limit = self.least[first : first + len(scores)]
        if scores.shape[1] > self.top:
            limit = np.maximum(limit, np.partition(scores, -self.top, axis=1)[:, -self.top])
        item, at = np.nonzero(scores >= limit[:, None])
        cuts = np.searchsorted(item, np.arange(len(scores) + 1))
        for k in np.unique(item).tolist():
            own = at[cuts[k] : cuts[k + 1]]
            both = np.concatenate([self.rows[first + k], np.stack([scores[k, own], null[own], ids[own]])], axis=1)
            both = both[:, np.lexsort((both[2], both[1], -both[0]))[: self.top]]
            self.rows[first + k] = both
            if both.shape[1] == self.top:
                self.least[first + k] = both[0, -1]


def _ranked(postings: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc, score): the best documents of each item in each task."""
    shared = postings.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        tiles, best = _tiles(items, weights), _Best(len(items.numbers), top)
        for b in batches:
            for at in range(0, b.num_rows, DOC_TILE):
                part = b.slice(at, DOC_TILE)
                length = np.array([75 + 25 * n * n_docs // n_terms for n in part.column(1).to_pylist()], dtype=np.int64)
                doc = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy())
                terms, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * length[doc])
                ids, null = part.column(0).fill_null(0).to_numpy(zero_copy_only=False), part.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                for tile in tiles:
                    best.add(tile.first, _scores(tile, terms, doc, impact, part.num_rows), ids, null)
        for number, rows in zip(items.numbers.tolist(), best.rows, strict=True):
            if rows.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], number)), pa.array(rows[2], mask=rows[1] > 0), pa.array(rows[0])], ["item", "doc", "score"])

    return postings.mapInArrow(run, "item long, doc long, score long")


def search(items: DataFrame, docs: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """item_col, rank int, doc_id (id_col), score long: each item's best documents with a score above 0, equal scores by id."""
    numbered = _item_blocks(items, item_col, item_text_col)
    blocks = numbered.agg(F.max("block")).first()[0]
    found = None
    for k in range(0 if blocks is None else blocks + 1):
        block = _read_items(numbered.where(F.col("block") == k).orderBy("item").collect())
        if not block.vocabulary:
            continue
        postings = stored(_postings(docs, id_col, text_col, block))
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _frequencies(postings, len(block.vocabulary)).tolist()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in df], dtype=np.int64)
        part = _ranked(postings.where(F.size("terms") > 0), block, weights, n_docs, n_terms, top)
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    if found is None:
        found = items.sparkSession.createDataFrame([], "item long, doc long, score long")
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return last.join(numbered.select("item", "id"), "item").select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
