"""Connected components of a graph given as a table of links, by repeated hooking and contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatescan.llm.chunks import stored, stored_with


def _shorten(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by the root of its chain, by pointer doubling, two doublings a table."""

    def double(old: DataFrame) -> DataFrame:
        up = old.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        return old.select("node", "parent").join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))

    while True:
        parents, seen = stored_with(double(double(parents)), moved=F.count_if("moved"))
        if not seen["moved"]:
            return parents.select("node", "parent")


def _edges(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("node"), F.least(a, b).alias("low")]


def connected_components(links: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link and is not itself the smallest.

    In each round every node hooks onto its smallest smaller neighbour, chains are shortened to their roots, and the links are
    carried over to the roots. Only nodes smaller than all their neighbours remain, at most half; links within one root are
    dropped. Each round's tables are written to the shared folder. `known` is an earlier result, to which the links are added. Self-links and
    repeated links do no harm; empty tables give no rows.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    found = None
    if known is not None:
        found = known.select("node", F.col("component").alias("parent"))
        for end in ("x", "y"):
            up = found.select(F.col("node").alias(end), F.col("parent").alias("root"))
            ends = ends.join(up, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    edges, seen = stored_with(ends.where("x <> y").select(*_edges("x", "y")).distinct(), n=F.count(F.lit(1)))
    while seen["n"]:
        roots = _shorten(stored(edges.groupBy("node").agg(F.min("low").alias("parent"))))  # stored, so that Spark can split the join at a hot root
        if found is None:
            found = roots
        else:
            up = roots.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            found = stored(found.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")).unionByName(roots))
        low = roots.select(F.col("node").alias("low"), F.col("parent").alias("low_root"))
        carried = edges.join(roots, "node").where(F.col("low") != F.col("parent")).join(low, "low", "left").select("parent", F.coalesce("low_root", "low").alias("other"))
        edges, seen = stored_with(carried.where("parent <> other").select(*_edges("parent", "other")).distinct(), n=F.count(F.lit(1)))
    if found is None:
        return edges.select("node", F.col("low").alias("component"))
    return found.select("node", F.col("parent").alias("component"))
