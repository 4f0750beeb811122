"""Operator 2: lexical retrieval packing of documents into training sequences.

Document frequencies and the average length are counted over all documents. Each document is placed by content: its shard of a
few megabytes is chosen by its term of highest BM25 weight that another document has too, so copies and documents about the same
rare term meet, whatever the size of the corpus; only a term of more documents than a shard holds is split by a hash of the row.
Each shard tokenises its documents, builds an inverted index with BM25 weights over lower-cased words, and fills windows: a seed
document queries with all its terms, and all unused documents that share one are ranked; those that fit are taken in order of
their scores. What room is left is filled by cutting the best unused document that doesn't fit; its rest opens the next window.
Only if no scored document is left does the first unused one by id follow. So every window of a shard is full but its last.
Of a corpus of more than MOST_TERMS shared terms, only the most frequent are broadcast; the frequencies of all others come to each
chunk of documents by the key exchange of chunks.py and travel on with the documents, so every term counts exactly, whatever the
size of the vocabulary. Neighbours whose placing terms differ can still lie in different shards; the README gives the measured share that is met.

A row that repeats another is packed again. Null text is empty and has only the end id; a null id stays null. Only the id and
text columns are read. Ties of scores go to the document that comes first by (id, text checksum).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatescan.llm import chunks as C
from gatescan.llm.arrays import find_words, group_starts, mix64, pack_ints, pack_sorted, unpack_ints, unpack_sorted
from gatescan.llm.bpe import blocks, codec, raw_texts

LENGTH, END_ID = 2048, 1
SHARD_BYTES = 4 << 20
#: Terms are counted apart in at least so many ranges (log2), each of about so many bytes of text.
TERM_BITS, RANGE_BYTES = 6, 96 << 20
#: Terms whose document frequencies are broadcast at most: 12 bytes each, 24 MB whatever the corpus. Those of the rest are exchanged.
MOST_TERMS = 1 << 21
#: A term of more than one in so many documents of a shard has its weights as a full row.
HEAVY = 8
K1, B = 1.2, 0.75


def postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term (48 bits of its hash), text and frequency of each distinct (term, text), in that order, and the words of each text."""
    words = find_words([t.lower() for t in texts], short=True)
    length = np.diff(words.offsets)
    docs = np.repeat(np.arange(len(texts), dtype=np.uint64), length)
    if len(texts) <= 1 << 16:  # both in one integer, which sorts fastest
        both = words.hashes
        both &= ~np.uint64(0xFFFF)
        both |= docs
        both.sort()
        at = group_starts(both)
        own = both[at]
        return own >> np.uint64(16), (own & np.uint64(0xFFFF)).astype(np.int64), np.diff(np.append(at, len(both))), length
    terms = words.hashes >> np.uint64(16)
    order = np.argsort(terms, kind="stable")
    terms, docs = terms[order], docs[order]
    new = np.ones(len(terms), dtype=bool)
    new[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    return terms[at], docs[at].astype(np.int64), np.diff(np.append(at, len(terms))), length


def by_text(docs: np.ndarray, n: int) -> np.ndarray:
    """The order of postings (by term, then text) by text, then term."""
    return np.argsort(docs.astype(np.uint16) if n <= 1 << 16 else docs, kind="stable")


class Statistics:
    """Document frequencies (ascending terms, the MOST_TERMS most frequent of two documents or more), number of documents, their words
    and bytes. If these are all terms of two documents or more (whole), the frequency of any other is 1."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, n: int, words: int, size: int, whole: bool = True):
        self.terms, self.df, self.n, self.words, self.size, self.whole = terms, df, n, words, size, whole

    def frequency(self, terms: np.ndarray, others: int = 1) -> np.ndarray:
        if not len(self.terms):
            return np.full(len(terms), others, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.df[at], others).astype(np.int64)

    def rarity(self, df: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - df + 0.5) / (df + 0.5))

    def norm(self, length: np.ndarray) -> np.ndarray:
        return K1 * (1 - B + B * length / max(1.0, self.words / self.n if self.n else 1.0))


def weights(rarity: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """BM25 weights of postings, given the rarity of their terms and the norm of their texts."""
    return rarity * tf * (K1 + 1) / (tf + norm)


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, texts: list[bytes], corpus: Statistics | None = None, carried: np.ndarray | None = None):
        """Without corpus, the shard is the corpus. carried: the document frequency of each text's distinct terms, text by text, where
        the corpus doesn't hold all."""
        terms, docs, tf, length = postings(texts)
        self.n = len(texts)
        starts = group_starts(terms)
        df = np.diff(np.append(starts, len(terms)))
        corpus = corpus or Statistics(terms[starts], df, self.n, int(length.sum()), 0)
        if carried is None:
            wide = corpus.frequency(terms[starts])
        else:
            wide = np.empty(len(terms), dtype=np.int64)
            wide[by_text(docs, self.n)] = carried
            wide = wide[starts]
        keep = np.repeat(df > 1, df)  # a term of one document finds no neighbour
        docs, tf, wide, df = docs[keep], tf[keep], wide[df > 1], df[df > 1]
        self.ends = np.cumsum(df)
        self.begins = self.ends - df
        self.docs = docs
        self.weight = weights(np.repeat(corpus.rarity(wide), df), tf, corpus.norm(length)[docs])
        by_doc = by_text(docs, self.n)
        self.term_of = np.repeat(np.arange(len(df)), df)[by_doc]
        self.doc_ends = np.cumsum(np.bincount(docs, minlength=self.n))
        heavy = HEAVY * df > self.n
        self.row = np.where(heavy, np.cumsum(heavy) - 1, -1)
        self.rows = np.zeros((int(heavy.sum()), self.n))
        full = np.repeat(heavy, df)
        self.rows[np.repeat(self.row, df)[full], docs[full]] = self.weight[full]

    def neighbours(self, doc: int, used: np.ndarray) -> list[int]:
        """All unused documents that share a term, best first."""
        return self.ranked(doc, used).tolist()

    def ranked(self, doc: int, used: np.ndarray) -> np.ndarray:
        terms = self.term_of[int(self.doc_ends[doc - 1]) if doc else 0 : int(self.doc_ends[doc])]
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(axis=0)
        terms = terms[row < 0]
        if len(terms):
            begins = self.begins[terms]
            size = self.ends[terms] - begins
            ends = np.cumsum(size)
            at = np.arange(int(ends[-1])) + np.repeat(begins - ends + size, size)
            score += np.bincount(self.docs[at], weights=self.weight[at], minlength=self.n)
        score[used] = 0
        some = np.flatnonzero(score > 0)
        return some[np.argsort(-score[some], kind="stable")]


def fill(lengths: list[int], index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    used, sizes = np.zeros(len(lengths), dtype=bool), np.array(lengths, dtype=np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = offset = nxt = 0

    def place(doc: int, start: int, most: int) -> int:
        nonlocal sequence, offset
        n = min(lengths[doc] - start, most)
        out.append((doc, start, n, sequence, offset))
        offset += n
        if offset == window:
            sequence, offset = sequence + 1, 0
        return start + n

    carried: tuple[int, int] | None = None
    while True:
        if carried:
            seed, start = carried
            carried = None
        else:
            while nxt < len(lengths) and used[nxt]:
                nxt += 1
            if nxt == len(lengths):
                return out
            seed, start = nxt, 0
            used[seed] = True
        while start < lengths[seed]:
            start = place(seed, start, window - offset)
        if not offset:
            continue
        ranked = index.ranked(seed, used)
        for doc in ranked[sizes[ranked] <= window - offset].tolist():
            if lengths[doc] <= window - offset:
                used[doc] = True
                place(doc, 0, window)
                if not offset:
                    break
        while offset:
            rest = ranked[~used[ranked]]
            while nxt < len(lengths) and used[nxt]:
                nxt += 1
            if not len(rest) and nxt == len(lengths):
                return out
            doc = int(rest[0]) if len(rest) else nxt
            used[doc] = True
            at = place(doc, 0, window - offset)
            if at < lengths[doc]:
                carried = (doc, at)


def corpus_statistics(rows: DataFrame) -> Statistics:
    """Of the texts in column t of rows. Every term of every document is counted; the driver gets the MOST_TERMS most frequent (equal
    shares of each range of hashes), so that its memory and the broadcast are bounded. exchanged() finds those of the others."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()
    bits = max(TERM_BITS, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
    most = max(1, MOST_TERMS >> bits)

    def merge(parts):
        keys = np.concatenate([p[0] for p in parts])
        order = np.argsort(keys)
        keys, counts = keys[order], np.concatenate([p[1] for p in parts])[order]
        starts = group_starts(keys)
        return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts

    def count(batches):
        parts, held, words = [(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))], 0, 0
        for whole in batches:
            for b in blocks(whole, "t"):
                terms, _, _, length = postings(raw_texts(b.column(0)))
                starts = group_starts(terms)
                parts.append((terms[starts], np.diff(np.append(starts, len(terms)))))
                words, held = words + int(length.sum()), held + len(starts)
                if held > max(1 << 21, 2 * len(parts[0][0])):
                    parts, held = [merge(parts)], 0
        keys, counts = merge(parts)
        cuts = [0, *np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(48 - bits)).tolist(), len(keys)]
        for k, (a, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if e > a:
                yield pa.RecordBatch.from_pydict({"bucket": [k], "words": [words], "n": [e - a], "shared": [0], "keys": [pack_sorted(keys[a:e])], "df": [pack_ints(counts[a:e])]}, schema=packed)
                words = 0

    def add(table: pa.Table) -> pa.Table:
        n = table.column("n").to_pylist()
        keys, df = merge([(unpack_sorted(x.as_py(), k), unpack_ints(y.as_py(), k).astype(np.int64)) for x, y, k in zip(table.column("keys"), table.column("df"), n, strict=True)])
        keys, df = keys[df > 1], df[df > 1]
        shared, kept = len(keys), np.sort(np.lexsort((keys, -df))[:most])
        keys, df = keys[kept], df[kept]
        return pa.Table.from_pydict({"bucket": [table.column("bucket")[0].as_py()], "words": [pc.sum(table.column("words")).as_py()], "n": [len(keys)], "shared": [shared], "keys": [pack_sorted(keys)], "df": [pack_ints(df)]}, schema=packed)

    packed = pa.schema([("bucket", pa.int32()), ("words", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("keys", pa.binary()), ("df", pa.binary())])
    schema = "bucket int, words long, n long, shared long, keys binary, df binary"
    found = sorted(rows.select("t").mapInArrow(count, schema).groupBy("bucket").applyInArrow(add, schema).collect(), key=lambda r: r["bucket"])
    terms = np.concatenate([np.empty(0, dtype=np.uint64), *[unpack_sorted(r["keys"], r["n"]) for r in found]])
    df = np.concatenate([np.empty(0, dtype=np.int64), *[unpack_ints(r["df"], r["n"]).astype(np.int64) for r in found]]).astype(np.int32)
    return Statistics(terms, df, n, sum(r["words"] for r in found), size, whole=sum(r["shared"] for r in found) == len(terms))


def shards_of(texts: list[bytes], row_hash: np.ndarray, corpus: Statistics, shards: int, found: tuple | None = None, df: np.ndarray | None = None) -> np.ndarray:
    """The shard of each text: by its shared term of highest weight, or by row_hash if it shares none. found: the texts' postings, and
    df the document frequency of each, if known already."""
    terms, docs, tf, length = found or postings(texts)
    starts = group_starts(terms)
    times = np.diff(np.append(starts, len(terms)))
    per = corpus.frequency(terms[starts]) if df is None else df[starts]
    use = np.repeat(per > 1, times)
    terms, docs, tf, per, times = terms[use], docs[use], tf[use], per[per > 1], times[per > 1]
    order = by_text(docs, len(texts))
    weight, starts = weights(np.repeat(corpus.rarity(per), times), tf, corpus.norm(length)[docs])[order], group_starts(docs[order])
    best = order[weight == np.repeat(np.maximum.reduceat(weight, starts), np.diff(np.append(starts, len(order))))] if len(order) else order
    first = best[group_starts(docs[best])]
    key = row_hash.astype(np.uint64, copy=True)
    splits = np.maximum(1, np.ceil(np.repeat(per, times)[first] * (corpus.size / max(1, corpus.n)) / SHARD_BYTES)).astype(np.uint64)
    key[docs[first]] = terms[first] + row_hash[docs[first]] % splits * np.uint64(0x9E3779B97F4A7C15)
    return (mix64(key) % np.uint64(shards)).astype(np.int64)


def dealt(rows: DataFrame, model) -> DataFrame:
    """rows (id, t) with their shard; model is a broadcast Statistics of all terms."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        corpus: Statistics = model.value
        shards = max(1, -(-corpus.size // SHARD_BYTES))
        for whole in batches:
            for b in blocks(whole, "t"):
                shard = shards_of(raw_texts(b.column(1)), b.column(2).to_numpy().view(np.uint64), corpus, shards)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shard)], ["id", "t", "shard"])

    return rows.withColumn("h", F.xxhash64("id", "t")).mapInArrow(run, f"id {id_type}, t string, shard long")


def exchanged(rows: DataFrame, model) -> DataFrame:
    """rows (id, t) with their shard, n and df: the packed document frequencies of their n distinct terms in ascending order; model is a
    broadcast Statistics that lacks terms. The frequencies of those are added up by ranges of terms and come back to each chunk."""
    id_type = rows.schema["id"].dataType.simpleString()
    chunks = C.checkpoint(C.pack(rows.withColumn("h", F.xxhash64("id", "t")), "t"))

    def lacking(table: pa.Table):
        found = postings(raw_texts(table.column("t").combine_chunks()))
        starts = group_starts(found[0])
        terms = found[0][starts]
        return found, terms, np.diff(np.append(starts, len(found[0]))), model.value.frequency(terms, others=0)

    def keys_of(table: pa.Table):
        _, terms, times, df = lacking(table)
        return terms[df == 0] << np.uint64(16), times[df == 0]

    def judge(times: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.repeat(np.add.reduceat(times, starts), np.diff(np.append(starts, len(times))))

    def finish(table: pa.Table, values: np.ndarray) -> pa.Table:
        found, _, times, df = lacking(table)
        df[df == 0] = values.astype(np.int64)
        df, docs = np.repeat(df, times), found[1]
        shard = shards_of([b""] * table.num_rows, table.column("h").combine_chunks().to_numpy().view(np.uint64), model.value, max(1, -(-model.value.size // SHARD_BYTES)), found, df)
        by_doc, ends = df[by_text(docs, table.num_rows)], np.cumsum(np.bincount(docs, minlength=table.num_rows)).tolist()
        packed = [pack_ints(by_doc[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table({"id": table.column("id"), "t": table.column("t"), "shard": pa.array(shard), "n": pa.array(np.diff([0, *ends])), "df": pa.array(packed, pa.binary())})

    answers = C.answer(C.scatter(chunks, keys_of, C.bucket_bits(model.value.size)), judge)
    return C.gather(chunks, answers, finish, f"id {id_type}, t string, shard long, n long, df binary")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (longs); with_ids adds ids binary."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    model = docs.sparkSession.sparkContext.broadcast(corpus_statistics(rows))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        ids, texts, shard = table.column("id").to_pylist(), raw_texts(table.column("t").combine_chunks()), table.column("shard")[0].as_py()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0, zlib.crc32(texts[k])))
        ids, texts = [ids[k] for k in order], [texts[k] for k in order]
        end = end_id.to_bytes(4, "little")
        tokens = [x + end for x in codec(path).encode(texts)]
        lengths = [len(x) // 4 for x in tokens]
        carried = None
        if not model.value.whole:
            df, distinct = table.column("df").to_pylist(), table.column("n").to_pylist()
            carried = np.concatenate([unpack_ints(df[k], distinct[k]) for k in order]).astype(np.int64)
        pieces = fill(lengths, Index(texts, model.value, carried), length)
        cut = [tokens[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
        out = {
            id_col: pa.array([ids[p[0]] for p in pieces], table.schema.field("id").type), "start": [p[1] for p in pieces], "length": [p[2] for p in pieces], "ids_crc32": [zlib.crc32(x) for x in cut],
            "doc_tokens": [lengths[p[0]] for p in pieces], "sequence_id": [(shard << 32) + p[3] for p in pieces], "offset": [p[4] for p in pieces],
        }
        whole = pa.table(out | ({"ids": pa.array(cut, pa.binary())} if with_ids else {}))
        del texts, tokens, cut, out
        C.give_back()
        return whole

    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    placed = dealt(rows, model) if model.value.whole else exchanged(rows, model)
    return placed.groupBy("shard").applyInArrow(run, schema)
