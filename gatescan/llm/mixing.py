"""Operator 4: language-model scoring by online logistic context mixing.

The text that is scored is the token sequence: lower-cased words joined by one space, then an end. Each byte is a path through a
binary code tree (a Huffman tree of the corpus' byte frequencies), and every branch is one bit. Several predictors give a bit's
log-odds, each from the counts of one hashed context: the last 2, 3 or 4 bytes, and the word so far. Their log-odds are added
with weights from the set that the bit's depth in the tree selects (the gate). The weights belong to one text and are refined as
it is read: after each block (short ones first) they take a step down the gradient of the code length, so every bit is
predicted from bits before its block only, and the code lengths add up to a proper total.

Context counts are gathered over all training texts: each task counts into hashed cells, the tasks' counts are added per range of
cells in Spark, and the finished table of log-odds goes to the scoring tasks. Its cells grow with the corpus up to TABLE_BITS
(one byte each), which bounds what is broadcast. Word counts for the base score are exact over any vocabulary: they travel by
the key exchange of chunks.py and grow with the corpus.

Defined cases: null or empty text is one end token; a null id counts as the empty id in the held-out rule; with no training
rows every token is unknown and predictors give even odds. Repeated rows repeat their results.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatescan.llm import chunks as C
from gatescan.llm.arrays import find_words, group_starts, pack_ints, pack_sorted, prefix_hashes, unpack_ints, unpack_sorted
from gatescan.llm.bpe import raw_texts
from gatescan.llm.language import held_out

#: log2 of the cells of a predictor's table at most, and at least.
TABLE_BITS, LEAST_TABLE_BITS = 22, 14
#: Parts that a table's cells are cut into while they are added up.
PARTS = 32
PREDICTORS = 4
GATES = 10
#: Added to both counts of a cell, log-odds per step of the stored byte, first weights, and the size of a weight step.
PRIOR, STEP, FIRST_WEIGHTS, RATE = 0.3, 1 / 12, (0.1, 0.25, 0.35, 0.45), 0.08
#: A text's weights are refined after so many bytes, then after each further LAST_BLOCK.
BLOCK_ENDS = (32, 64, 128, 256, 512, 1024, 2048)
LAST_BLOCK = 2048
_U32 = np.uint32
_NODE = _U32(0x9E3779B1)


class CodeTree:
    """A Huffman tree over all 256 bytes: for each depth the branch (hashed) and the bit that a byte takes, and each byte's depth."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
        paths: dict[int, list[tuple[int, int]]] = {510: []}
        for node in range(510, 255, -1):
            for bit, child in enumerate(children[node]):
                paths[child] = [*paths[node], (510 - node, bit)]
        self.depth = np.array([len(paths[b]) for b in range(256)])
        size = int(self.depth.max())
        self.node, self.bit = np.zeros((size, 256), dtype=_U32), np.zeros((size, 256), dtype=np.int8)
        for b in range(256):
            for d, (node, bit) in enumerate(paths[b]):
                self.node[d, b], self.bit[d, b] = node, bit
        self.node *= _NODE
        self.sign = (2 * self.bit - 1).astype(np.float32)


    def cells(self, bits: int) -> np.ndarray:
        """What each branch changes in the number of a context's cell."""
        return self.node >> _U32(32 - bits)


def normal_form(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def contexts(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All bytes, where each text begins, and for each predictor the hash of every byte's context."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    place = np.arange(n)
    back = []
    for k in (1, 2, 3, 4):  # the k-th byte before, 10 (an end) before the start
        b = np.full(n, 10, dtype=_U32)
        b[k:] = data[:-k] if k < n else data[:0]
        for j in range(k):
            b[(begins + j)[lengths > j]] = 10
        back.append(b)
    shift = _U32(32 - bits)

    def mixed(x: np.ndarray, salt: int) -> np.ndarray:
        x = x + _U32(salt)
        return (x * _U32(0x85EBCA6B) ^ x >> _U32(15)) * _U32(0xC2B2AE35) >> shift

    two = back[0] | back[1] << _U32(8)
    three = two | back[2] << _U32(16)
    four = three | back[3] << _U32(24)
    boundary = back[0] == 32
    boundary[begins[lengths > 0]] = True
    start = np.maximum.accumulate(np.where(boundary, place, 0))
    word = (prefix_hashes(data, start, place) >> np.uint64(32)).astype(_U32) + (place - start).astype(_U32)
    return data, begins, [mixed(two, 0x2545F491), mixed(three, 0x6C62272E), mixed(four, 0x7F4A7C15), mixed(word, 0x51ED270B)]


def count_bits(texts: list[bytes], tree: CodeTree, counts: list[np.ndarray], bits: int) -> None:
    """Adds the bits of the texts to counts[predictor][cell + 2**bits * bit]. Equal (context, byte) pairs are counted first, by
    sorting, and each distinct pair then goes down the tree once."""
    data, _, own = contexts(texts, bits)
    cells = tree.cells(bits) | tree.bit.astype(_U32) << _U32(bits)
    for k in range(PREDICTORS):
        pair = np.sort(own[k] << _U32(8) | data if bits <= 24 else own[k].astype(np.uint64) << np.uint64(8) | data)
        starts = group_starts(pair)
        times = np.diff(np.append(starts, len(pair))).astype(_U32)
        pair = pair[starts]
        sym, context = (pair & 255).astype(np.uint8), (pair >> 8).astype(_U32)
        depth = tree.depth[sym]
        for d in range(int(depth.max()) if len(sym) else 0):
            use = np.flatnonzero(depth > d)
            if len(use) < len(sym):
                depth, sym, context, times = depth[use], sym[use], context[use], times[use]
            np.add.at(counts[k], (context ^ cells[d].take(sym)).astype(np.int64), times)


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Signed bytes in units of STEP."""
    return np.clip(np.rint((np.log(ones + PRIOR) - np.log(zeros + PRIOR)) / STEP), -127, 127).astype(np.int8)


def code_bits(texts: list[bytes], tree: CodeTree, tables: list[np.ndarray], bits: int) -> np.ndarray:
    """The code length in bits of each text (normal form)."""
    data, begins, hashes = contexts(texts, bits)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    cells = tree.cells(bits)  # all of 32 bits: the loop below moves them more than it computes
    weights = np.tile(np.array(FIRST_WEIGHTS, dtype=np.float32), (len(texts), GATES, 1))
    total = np.zeros(len(texts))
    low, block = 0, 0
    while True:
        docs = np.flatnonzero(lengths > low)
        if not len(docs):
            return total / math.log(2)
        high = BLOCK_ENDS[block] if block < len(BLOCK_ENDS) else low + LAST_BLOCK
        n = np.minimum(lengths[docs], high) - low
        owner = np.repeat(np.arange(len(docs)), n)
        at = np.repeat(begins[docs] + low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sym = data[at]
        own = [h[at] for h in hashes]
        depth = tree.depth[sym]
        gradient = np.zeros((len(docs), GATES, PREDICTORS), dtype=np.float32)
        energy = np.zeros((len(docs), GATES, 1), dtype=np.float32)
        for d in range(int(depth.max())):
            use = np.flatnonzero(depth > d)
            if len(use) < len(sym):
                sym, owner, depth = sym[use], owner[use], depth[use]
                own = [h[use] for h in own]
            gate = min(d, GATES - 1)
            node, sign = cells[d].take(sym), tree.sign[d].take(sym)
            odds = [tables[k].take(own[k] ^ node, mode="clip").astype(np.float32) for k in range(PREDICTORS)]
            starts = group_starts(owner)
            present = owner[starts]
            w = weights[docs[present], gate] * np.float32(STEP)
            run = np.diff(np.append(starts, len(owner)))
            dot = odds[0] * np.repeat(w[:, 0], run)
            for k in range(1, PREDICTORS):
                dot += odds[k] * np.repeat(w[:, k], run)
            dot *= sign
            e = np.exp(np.clip(-dot, -15, 30))
            one = e + np.float32(1)
            total[docs[present]] += np.add.reduceat(np.log(one), starts, dtype=np.float64)
            wrong = e / one  # the share not given to the bit that came
            error = wrong * sign
            for k in range(PREDICTORS):
                gradient[present, gate, k] += np.add.reduceat(error * odds[k], starts)
            curve = wrong * (1 - wrong)
            energy[present, gate, 0] += np.add.reduceat(curve * (odds[1] * odds[1] + odds[3] * odds[3]), starts)
        weights[docs] += np.float32(RATE) * gradient * np.float32(STEP) / (energy * np.float32(STEP * STEP) + 8)
        low, block = high, block + 1


def _normal(b: pa.RecordBatch) -> pa.RecordBatch:
    """A block of rows with its texts in normal form, once for all passes."""
    n = b.schema.get_field_index("t")
    return b.set_column(n, "t", pa.array([normal_form(t) for t in raw_texts(b.column(n))], pa.binary()))


def _training(rows: pa.Table) -> list[bytes]:
    train = np.array(rows.column("train").combine_chunks())
    return [t for t, use in zip(raw_texts(rows.column("t").combine_chunks()), train.tolist(), strict=True) if use]


def _sliced(texts: list[bytes], most: int = 1 << 20):
    """Consecutive texts of about `most` bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def byte_counts(chunks: DataFrame) -> np.ndarray:
    def run(batches):
        for b in batches:
            for payload in b.column(0):
                n = np.bincount(np.frombuffer(b"".join(_training(C.from_ipc(payload.as_py()))), dtype=np.uint8), minlength=256)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(n.astype(np.int64))], ["b", "n"])

    rows = chunks.select("payload").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(256, dtype=np.int64)
    for r in rows:
        counts[r["b"]] = r["n"]
    return counts


def train_tables(chunks: DataFrame, tree: CodeTree, bits: int) -> list[np.ndarray]:
    """The log-odds tables: 2**bits signed bytes for each predictor, whatever the size of the corpus."""
    part_bits = bits - int(math.log2(PARTS))

    def count(batches):
        counts = [np.zeros(2 << bits, dtype=_U32) for _ in range(PREDICTORS)]
        for b in batches:
            for payload in b.column(0):
                for texts in _sliced(_training(C.from_ipc(payload.as_py()))):
                    count_bits(texts, tree, counts, bits)
        for k, c in enumerate(counts):
            for p in range(PARTS):
                own = np.concatenate([c[(b << bits) + (p << part_bits) : (b << bits) + (p + 1 << part_bits)] for b in (0, 1)])
                if len(at := np.flatnonzero(own)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([p], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([pack_sorted(at.astype(np.uint64))], pa.binary()), pa.array([pack_ints(own[at])], pa.binary())], ["k", "part", "n", "at", "count"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 << part_bits, dtype=np.int64)
        for n, at, c in zip(table.column("n").to_pylist(), table.column("at"), table.column("count"), strict=True):
            total[unpack_sorted(at.as_py(), n).astype(np.int64)] += unpack_ints(c.as_py(), n).astype(np.int64)
        zeros, ones = total[: 1 << part_bits], total[1 << part_bits :]
        return pa.table({"k": table.column("k")[:1], "part": table.column("part")[:1], "odds": pa.array([log_odds(zeros, ones).tobytes()], pa.binary())})

    sent = chunks.select("payload").mapInArrow(count, "k int, part int, n int, at binary, count binary")
    found = sent.groupBy("k", "part").applyInArrow(add, "k int, part int, odds binary").collect()
    tables = [np.zeros(1 << bits, dtype=np.int8) for _ in range(PREDICTORS)]
    for r in found:
        tables[r["k"]][r["part"] << part_bits : (r["part"] + 1) << part_bits] = np.frombuffer(r["odds"], dtype=np.int8)
    return tables


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), n_bytes, bits_per_byte for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, parts, part).alias("held"), F.col(text_col).alias("t")).withColumn("train", ~F.col("held"))
    chunks = C.checkpoint(C.pack(rows, "t", prepare=_normal))
    size = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    bits = min(TABLE_BITS, max(LEAST_TABLE_BITS, math.ceil(math.log2(max(1, size[0]))) - 6))

    def tokens(table: pa.Table):
        words = find_words(raw_texts(table.column("t").combine_chunks()))
        keys, number = np.unique(words.hashes, return_inverse=True)
        train = np.array(table.column("train").combine_chunks())
        owner = words.owner()
        return words, keys, number, owner, np.bincount(number[train[owner]], minlength=len(keys)) if len(owner) else np.empty(0, dtype=np.int64)

    def keys_of(table: pa.Table):
        _, keys, _, _, count = tokens(table)
        return keys, count

    def judge(count, starts):
        return np.repeat(np.add.reduceat(count, starts), np.diff(np.append(starts, len(count))))

    answers = C.checkpoint(C.answer(C.scatter(chunks, keys_of, C.bucket_bits(size[0])), judge, tally=lambda count, starts: (int((np.add.reduceat(count, starts) > 0).sum()), int(count.sum()))))
    distinct, running = answers.agg(F.coalesce(F.sum("tally.a"), F.lit(0)), F.coalesce(F.sum("tally.b"), F.lit(0))).first()
    ends = rows.agg(F.count_if("train")).first()[0]
    total, vocabulary = running + ends, distinct + (1 if ends else 0)
    tree = CodeTree(byte_counts(chunks))
    model = docs.sparkSession.sparkContext.broadcast((tree, train_tables(chunks, tree, bits)))

    def finish(table: pa.Table, counts: np.ndarray) -> pa.Table:
        words, _, number, owner, _ = tokens(table)
        c = counts.astype(np.float64)[number]
        n_tokens = np.diff(words.offsets) + 1
        n_known = np.bincount(owner, weights=c > 0, minlength=len(n_tokens)).astype(np.int64) + (1 if ends else 0)
        base = np.bincount(owner, weights=np.log10(c + 1), minlength=len(n_tokens)) + math.log10(ends + 1) - n_tokens * math.log10(total + vocabulary + 1)
        own_tree, tables = model.value
        texts = raw_texts(table.column("t").combine_chunks())
        length = np.array([len(t) for t in texts])
        coded = np.concatenate([code_bits(part, own_tree, tables, bits) for part in _sliced(texts)])
        return pa.table({
            id_col: table.column("id"), "held_out": table.column("held"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(len(texts), total), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(-coded * math.log10(2)), "n_bytes": pa.array(length, pa.int64()), "bits_per_byte": pa.array(coded / length),
        })

    return C.gather(chunks, answers.select("chunk_id", "bucket", "n", "answer"), finish, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
