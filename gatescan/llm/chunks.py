"""Key exchange between blocks of documents, for operators that must compare every word window of a corpus with all others.

A row for each of a corpus' windows would be far larger than the corpus. Here documents are packed into chunks of a few
megabytes (a checkpointed table, so that every later pass sees the same chunks, whatever executor is lost). From each chunk
the distinct 64-bit keys travel sorted and packed, cut into buckets by their highest bits; a bucket's task sees all chunks'
keys of its range, and answers each chunk with one value a key in the same order. A key that stands in every chunk costs one
entry a chunk, however often it occurs, so no key makes a large group.

    chunks  = pack(docs, "text")              # (chunk_id, n_rows, n_bytes, payload)
    sent    = scatter(chunks, keys_of, ...)   # (bucket, chunk_id, n, keys, extra)
    answers = answer(sent, ...)               # (chunk_id, bucket, n, answer)
    result  = gather(chunks, answers, ...)    # rows again
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gatescan.llm.arrays import pack_ints, pack_sorted, unpack_ints, unpack_sorted

#: Bytes of text in a chunk, and about as many bytes of text to a bucket.
CHUNK_BYTES = 3 << 20
BUCKET_BYTES = 12 << 20
#: Buckets are at least so many, so that a small corpus also spreads over a cluster.
LEAST_BUCKETS = 64


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one if Spark runs on this
    machine alone; on a cluster that is an error, as executors would not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and read from there from now on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: The tables stored in each open scope of temporary_tables().
_scopes: list[list[str]] = []


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within go at its end. What is used afterwards must be checkpointed, or computed anew, by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """checkpoint() as a Parquet table in the same folder: later reads take only the columns they need, and plans of many
    rounds don't inherit each other's constraints, which makes planning slow."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """stored(), and aggregates of its rows taken on the way. A repeated task may count twice: use them as zero or not."""
    seen = Observation()
    return stored(df.observe(seen, *[c.alias(k) for k, c in measures.items()])), seen.get


def checkpoint_with(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """checkpoint(), and aggregates of its rows as for stored_with()."""
    seen = Observation()
    return checkpoint(df.observe(seen, *[c.alias(k) for k, c in measures.items()])), seen.get


def give_back() -> None:
    """Returns what a worker has freed to the system. Workers live on through later stages, several to an executor, and would
    else each keep the most that any of their groups has needed."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C_LIBRARY := ctypes.CDLL(None), "malloc_trim"):
        _C_LIBRARY.malloc_trim(0)


def to_ipc(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(table)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as r:
        return r.read_all()


def pack(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES, *, prepare: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """(chunk_id long, n_rows long, n_bytes long, payload binary): all rows and columns of docs in compressed blocks, as prepare()
    makes them of docs' own."""
    n_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([t.num_rows]), pa.array([size]), pa.array([to_ipc(t)], pa.binary())], ["chunk_id", "n_rows", "n_bytes", "payload"])

        for b in batches:
            if not b.num_rows:
                continue
            b = prepare(b) if prepare else b
            lengths = np.array(pc.fill_null(pc.binary_length(b.column(n_text)), 0), dtype=np.int64) + 16
            part = (np.cumsum(lengths) + size) // chunk_bytes
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for a, e in zip(cuts, cuts[1:], strict=False):
                held.append(b.slice(a, e - a))
                size += int(lengths[a:e].sum())
                if e < b.num_rows:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return docs.mapInArrow(run, "chunk_id long, n_rows long, n_bytes long, payload binary")


def total_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def bucket_bits(total: int) -> int:
    """Bits of a key that choose its bucket, from the corpus' size in bytes."""
    return max(int(math.log2(LEAST_BUCKETS)), math.ceil(math.log2(max(1, total / BUCKET_BYTES))))


def scatter(chunks: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """keys_of(rows of a chunk) gives distinct ascending keys and a 64-bit integer for each, sent as its excess over the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for b in batches:
            for chunk_id, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys, values = keys_of(from_ipc(payload.as_py()))
                values = values.astype(np.int64)
                base = values.min() if len(values) else np.int64(0)
                extra = values.view(np.uint64) - base.view(np.uint64)
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [(k, a, e) for k, (a, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > a]
                low = np.uint64((1 << (64 - bits)) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _, _ in rows], pa.int32()), pa.array([chunk_id] * len(rows), pa.int64()), pa.array([int(base)] * len(rows), pa.int64()), pa.array([e - a for _, a, e in rows], pa.int32()),
                        pa.array([pack_sorted(keys[a:e] & low) for _, a, e in rows], pa.binary()), pa.array([pack_ints(extra[a:e]) for _, a, e in rows], pa.binary()),
                    ],
                    ["bucket", "chunk_id", "base", "n", "keys", "extra"],
                )
                del keys, values, extra, rows
                give_back()

    return chunks.select("chunk_id", "payload").mapInArrow(run, "bucket int, chunk_id long, base long, n int, keys binary, extra binary")


def each_payload(read: Callable[[pa.Table], dict], schema: pa.Schema):
    """For mapInArrow over payloads: the rows that read() makes of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0):
                yield pa.RecordBatch.from_pydict(read(from_ipc(payload.as_py())), schema=schema)

    return run


def answer(sent: DataFrame, judge: Callable[[np.ndarray, np.ndarray], np.ndarray], tally: Callable[[np.ndarray, np.ndarray], tuple[int, int]] | None = None) -> DataFrame:
    """(chunk_id, bucket, n, answer, tally): tally is a pair of numbers about the bucket, in one of its rows (null if not asked for).

    judge(values, starts) sees the integers of a bucket's entries in the order of their keys and where each key's run starts;
    it returns a non-negative integer for each entry.
    """

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        keys = np.concatenate([unpack_sorted(d.as_py(), k) for d, k in zip(table.column("keys"), n.tolist(), strict=True)])
        extra = np.concatenate([unpack_ints(d.as_py(), k) for d, k in zip(table.column("extra"), n.tolist(), strict=True)])
        sent_values = (extra + np.repeat(table.column("base").to_numpy().view(np.uint64), n)).view(np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        values = np.empty(len(keys), dtype=np.uint64)
        values[order] = judge(sent_values[order], starts)
        ends = np.cumsum(n)
        packed = [pack_ints(values[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        about = [None] * len(packed)
        if tally:
            about[0] = dict(zip("ab", tally(sent_values[order], starts), strict=True))
        del keys, extra, sent_values, order, values
        give_back()
        return pa.table({"chunk_id": table.column("chunk_id"), "bucket": table.column("bucket"), "n": table.column("n"), "answer": pa.array(packed, pa.binary()), "tally": pa.array(about, pa.struct([("a", pa.int64()), ("b", pa.int64())]))})

    return sent.groupBy("bucket").applyInArrow(run, "chunk_id long, bucket int, n int, answer binary, tally struct<a:bigint,b:bigint>")


def gather(chunks: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, np.ndarray], Iterator[pa.Table] | pa.Table], schema: str) -> DataFrame:
    """finish(rows of a chunk, the answers to its keys in their order) gives the rows of the result. Each chunk is one group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("answer").to_pylist(), strict=True))
        values = np.concatenate([unpack_ints(d, k) for _, k, d in rows]) if rows else np.empty(0, dtype=np.uint64)
        out = finish(from_ipc(left.column("payload")[0].as_py()), values)
        give_back()
        return out

    return chunks.select("chunk_id", "payload").groupBy("chunk_id").cogroup(answers.select("chunk_id", "bucket", "n", "answer").groupBy("chunk_id")).applyInArrow(run, schema)
