"""Operator 3: near-duplicate vectors by random-hyperplane sign hashing, exact verification and connected components.

Vectors of one label and length are compared. Each of several tables hashes a vector by the signs of its products with random
hyperplanes; vectors of the same bucket are compared by exact cosine in double precision, and a pair is counted in the first
table that brings it together. Equal vectors are collapsed beforehand and counted by their multiplicity. A bucket larger than
BLOCK is cut into blocks and every pair of blocks is a group of its own, so nothing is left out and no group grows without
bound. A group returns one count per vector and links that only keep its components together, never all pairs.

Bits grow with the largest label and tables with the bits, so that a pair at the threshold is missed with probability MISS.
The random planes come from a fixed seed and the dimension.

Defined cases: a null label, a null vector, null or non-finite components or a zero vector links with nothing; rows with the
same id are counted as separate vectors of one node; a null id never links; ties don't occur. Entries other than float are taken as
double. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatescan.llm.arrays import group_starts
from gatescan.llm.chunks import checkpoint, checkpoint_with
from gatescan.llm.components import connected_components

THRESHOLD, MISS, SEED = 0.93, 0.002, 20
#: Vectors that two sides of a block pair have at most, about, and rows of a group of small buckets.
BLOCK, GROUP_ROWS = 1024, 8192


def plan_tables(largest: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for labels of at most so many vectors."""
    bits = min(20, max(6, math.ceil(math.log2(max(1, largest) / 16))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - together))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column without nulls, in double precision, and where each list begins (n + 1 offsets)."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(whole.value_lengths().to_numpy(zero_copy_only=False))))


def _take(flat: tuple[np.ndarray, np.ndarray], at: np.ndarray, dim: int) -> np.ndarray:
    """The lists at these places, all of length dim, as a matrix, each scaled by a power of two to entries below 1: directions stay
    exactly the same, and squares neither overflow nor vanish."""
    v = flat[0][flat[1][at][:, None] + np.arange(dim)]
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None])


def _signatures(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """One row per vector and table: (id, copies, label, dim, tab, sig, sigs array<int>, vector)."""

    def run(batches):
        for b in batches:
            flat = _flat(b.column(3))
            lengths = np.diff(flat[1])
            for dim in np.unique(lengths).tolist():
                pick = np.flatnonzero(lengths == dim)
                signs = _take(flat, pick, dim) @ _planes(dim, bits, tables) > 0
                sigs = signs.reshape(len(pick), tables, bits) @ (1 << np.arange(bits))
                part = b.take(pa.array(pick))
                for at in range(0, len(pick), 512):
                    n = min(512, len(pick) - at)
                    rep = np.repeat(np.arange(at, at + n), tables)
                    own = part.take(pa.array(rep))
                    own_sigs = sigs[at : at + n].astype(np.int32).reshape(-1)
                    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * tables, own_sigs).take(pa.array(rep - at))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(np.full(n * tables, dim, dtype=np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(own_sigs), lists, own.column(3)], ["id", "copies", "label", "dim", "tab", "sig", "sigs", "vector"])

    return vectors.select("id", "copies", "label", "vector").mapInArrow(run, f"id long, copies long, label {vectors.schema['label'].dataType.simpleString()}, dim int, tab int, sig int, sigs array<int>, vector {vectors.schema['vector'].dataType.simpleString()}")


def _compare(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, sigs: np.ndarray, unit: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """New links of each vector, by multiplicity, and the smallest number reachable within the group by any links."""
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    if side.any():  # a pair of blocks: only pairs across it
        close &= side[:, None] != side[None, :]
    count = np.zeros(len(ids), dtype=np.int64)
    i, j = np.nonzero(np.triu(close))
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        new = ~(sigs[x, :table] == sigs[y, :table]).any(axis=1)
        np.add.at(count, x[new], copies[y[new]])
        np.add.at(count, y[new], copies[x[new]])
    low = np.arange(len(ids))
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        low = low[low]
        if (low == before).all():
            break
    return count, low


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, links, other): per bucket and vector the new links, and a vector it is connected with."""

    def run(table: pa.Table) -> pa.Table:
        key = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")])
        order = np.lexsort(key[::-1])
        starts = np.unique(np.concatenate((group_starts(key[0][order]), group_starts(key[1][order]))))
        ids, copies, side, tab = (table.column(c).to_numpy() for c in ("id", "copies", "side", "tab"))
        sigs = table.column("sigs").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        dims, flat = table.column("dim").to_numpy(), _flat(table.column("vector"))
        out: list[list[np.ndarray]] = [[], [], []]
        for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            if e - a < 2:
                continue
            at = order[a:e]
            v = _take(flat, at, int(dims[at[0]]))
            count, low = _compare(ids[at], copies[at], side[at], sigs[at], v / np.linalg.norm(v, axis=1, keepdims=True), int(tab[at[0]]), threshold)
            use = (count > 0) | (low != np.arange(len(low)))
            out[0].append(ids[at][use])
            out[1].append(count[use])
            out[2].append(ids[at][low[use]])
        joined = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out]
        return pa.table(dict(zip(("id", "links", "other"), joined, strict=True)))

    return rows.groupBy("part").applyInArrow(run, "id long, links long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, n_links long, component_id long, kept boolean for each row of vectors."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    own = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(own if own == "array<float>" else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("vector"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0)
    x_type = rows.schema["vector"].dataType.elementType
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    keys = [F.when(F.col("ok"), F.xxhash64(F.lit(k), "label", F.transform("vector", lambda x: x + F.lit(0).cast(x_type)))).alias(f"g{k}") for k in (1, 2)]
    rows = checkpoint(rows.select("*", *keys))
    distinct = checkpoint(rows.where("ok").groupBy("g1", "g2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    sizes = distinct.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    bits, tables = plan_tables(sizes[0], threshold)
    signed = _signatures(distinct, bits, tables)
    bucket = ["label", "dim", "tab", "sig"]
    large = signed.groupBy(bucket).count().where(F.col("count") > BLOCK).withColumn("cuts", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    large, seen = checkpoint_with(large, n=F.count(F.lit(1)))
    cut = signed.join(large, bucket, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))) if seen["n"] else signed.withColumn("cuts", F.lit(1))
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("cuts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    cut = cut.withColumn("own", own).withColumn("pair", F.explode(pairs)).withColumn("side", ((F.col("pair.x") != F.col("pair.y")) & (F.col("own") == F.col("pair.y"))).cast("int"))
    parts = max(64, -(-sizes[1] * tables // GROUP_ROWS))
    keyed = cut.withColumn("h1", F.xxhash64(*bucket, "pair")).withColumn("h2", F.xxhash64(F.lit(3), *bucket, "pair"))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("h1", "h2"), F.lit(parts))).select("part", "h1", "h2", "id", "copies", "side", "dim", "tab", "sigs", "vector")
    found = checkpoint(_links(keyed, threshold))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found, "id", "other")
    reps = distinct.select("g1", "g2", "id", "copies").join(counts, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    reps = reps.select("g1", "g2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "g1", "g2").join(checkpoint(reps), ["g1", "g2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
