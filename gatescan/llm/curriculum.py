"""Operator 12 [native]: mixing sources to target weights by a curriculum that varies over time.

Each source has a schedule, a weight at each moment of training (0 to 1) that runs straight between its knots. The integral of
a source's weight is its share of the words that training takes; a share stops at PASSES times the source's size, and the excess
goes to the other sources by weight until none is above. A source's documents lie behind one another in the order of a hash, pass
after pass, so each pass of a document begins at some number of words that the source has given before. A source's demand up to
a moment is its target times the part of its schedule's area before it; this function is inverted (a square root on each straight
piece) to give the moment at which that pass is wanted, and documents are sorted by it over ranges.

The last pass is cut within one document, so a source gives its target rounded down, to the word.

The running sums of a source go through three levels: sums of 256 parts by the hash's first digits, of 4,096 parts of each, and
the documents of one part. Sums of a level are joined to the next under its own finer key, so a source with any share of all rows
makes no hot group.

Defined cases: null text has size 0; a null source is a source; a source without a schedule, or with weights of 0, gives nothing; a
source without words has target 0; null ids and repeated rows are documents like others (equal rows are interchangeable); a document
that isn't taken has no passes and a null position, and is sorted last; an empty table gives an empty result. Weights below 0 count
as 0; before its first knot and after its last a schedule is level. Columns asked for by keep stay; result columns get underscores
until no kept column has such a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatescan.llm.chunks import stored

PASSES = 3
_EARLIER = (Window.unboundedPreceding, -1)


def size_of(text: Column) -> Column:
    """The number of words `[^ \\t-\\r]+`."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def _key(source: str) -> Column:
    """A source as text that tells null from the empty name."""
    return F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def integrate(schedule: DataFrame) -> DataFrame:
    """(key, weight, pieces) of a schedule (source, at, weight): the whole area, and the straight pieces by their starts."""
    knots = schedule.select(_key("source").alias("key"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("at").cast("double"))).alias("at"), F.greatest(F.lit(0.0), F.col("weight").cast("double")).alias("w"))
    ends = knots.groupBy("key").agg(F.min_by("w", "at").alias("first"), F.max_by("w", "at").alias("last"))
    ends = ends.select("key", F.inline(F.array(F.struct(F.lit(0.0).alias("at"), F.col("first").alias("w")), F.struct(F.lit(1.0).alias("at"), F.col("last").alias("w")))))
    knots = knots.unionByName(ends).groupBy("key", "at").agg(F.max("w").alias("w"))
    w = Window.partitionBy("key").orderBy("at")
    pieces = knots.withColumn("to", F.lead("at").over(w)).withColumn("next", F.lead("w").over(w)).where(F.col("to").isNotNull())
    pieces = pieces.withColumn("area", (F.col("to") - F.col("at")) * (F.col("w") + F.col("next")) / 2)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("area").over(w.rowsBetween(*_EARLIER)), F.lit(0.0)))
    piece = F.struct("before", "at", "w", ((F.col("next") - F.col("w")) / (F.col("to") - F.col("at"))).alias("slope"))
    return pieces.groupBy("key").agg(F.sum("area").alias("weight"), F.array_sort(F.collect_list(piece)).alias("pieces"))


def share_out(sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """sources (size, weight) with target: all sizes shared by weight; what lies above passes times a size is shared again."""
    cap, weight = F.lit(float(passes)) * F.col("size"), F.coalesce("weight", F.lit(0.0))
    total, weights = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double"), F.coalesce(F.sum(weight), F.lit(0.0))).first()
    rest, share = total, lambda rest, weights: F.lit(rest) * weight / F.lit(weights)
    while weights:
        above = share(rest, weights) > cap
        capped, left = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0.0))).first()
        if left == weights:
            break
        rest, weights = total - capped, left
    target = F.when(weight > 0, F.least(cap, share(rest, weights)) if weights else cap).otherwise(0.0)
    return sources.withColumn("target", target)


def _moment(pieces: Column, area: Column) -> Column:
    """The moment at which a schedule's area has grown to so much."""
    piece = F.element_at(F.filter(pieces, lambda p: p["before"] <= area), -1)
    d, w, slope = area - piece["before"], piece["w"], piece["slope"]
    root = F.sqrt(F.greatest(F.lit(0.0), w * w + 2 * slope * d))
    return piece["at"] + F.when(d > 0, 2 * d / (w + root)).otherwise(0.0)


def curriculum(docs: DataFrame, schedule: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), passes: int = PASSES) -> DataFrame:
    """One row per document, sorted by position over ranges: id_col and the kept columns, size, source_size, target (its source's,
    in words), taken (its words, repeats counted), position (the moment of its first pass) and passes, array<struct<position, words>>.
    """
    own = {}
    for name in ("size", "source_size", "target", "taken", "position", "passes"):
        own[name] = name
        while own[name] in (id_col, *keep):
            own[name] += "_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate([id_col, *keep])]
    rows = stored(docs.select(*kept, F.col(id_col).cast("string").alias("id"), _key(source_col).alias("key"), hashed.alias("h"), size_of(F.col(text_col)).alias("size")))
    rows = rows.withColumn("b1", F.substring("h", 1, 2)).withColumn("b2", F.substring("h", 3, 3))
    fine = stored(rows.groupBy("key", "b1", "b2").agg(F.sum("size").alias("n")))
    coarse = fine.groupBy("key", "b1").agg(F.sum("n").alias("n"))
    sources = stored(coarse.groupBy("key").agg(F.sum("n").alias("size")).join(integrate(schedule), "key", "left"))
    sources = share_out(sources, passes).select("key", F.col("size").alias("source_size"), "target", "weight", "pieces")
    before = lambda of, n, *by: F.coalesce(F.sum(n).over(Window.partitionBy(*of).orderBy(*by).rowsBetween(*_EARLIER)), F.lit(0)).cast("long")
    coarse = coarse.withColumn("start", before(["key"], "n", "b1")).drop("n").join(sources, "key")
    fine = fine.withColumn("more", before(["key", "b1"], "n", "b2")).drop("n").join(coarse, ["key", "b1"])
    fine = fine.withColumn("start", F.col("start") + F.col("more")).drop("more")
    placed = rows.withColumn("more", before(["key", "b1", "b2"], "size", "h", "id", "size")).join(fine, ["key", "b1", "b2"])

    whole = F.floor("target").cast("long")
    one = F.greatest(F.col("source_size"), F.lit(1))
    placed = placed.withColumn("begin", F.col("start") + F.col("more")).withColumn("full", F.floor(whole / one).cast("long"))
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("full") * F.col("source_size") - F.col("begin"))))
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.col("full")), lambda k: F.struct((k * F.col("source_size") + F.col("begin")).alias("demand"), F.when(k < F.col("full"), F.col("size")).otherwise(F.col("part")).alias("words")))
    real = F.filter(numbers, lambda p: p["words"] > 0)
    timed = F.transform(real, lambda p: F.struct(_moment(F.col("pieces"), p["demand"] * F.col("weight") / F.col("target")).alias("position"), p["words"].alias("words")))
    placed = placed.withColumn("passes", timed)
    out = placed.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate([id_col, *keep])], F.col("size").alias(own["size"]), F.col("source_size").alias(own["source_size"]), F.col("target").alias(own["target"]),
        (F.col("full") * F.col("size") + F.col("part")).alias(own["taken"]), F.get("passes", F.lit(0))["position"].alias(own["position"]), F.col("passes").alias(own["passes"]), F.col("h").alias("__h"),
    )
    return out.orderBy(F.col(own["position"]).asc_nulls_last(), "__h").drop("__h")


def training_order(placed: DataFrame, passes_col: str = "passes") -> DataFrame:
    """The passes of curriculum()'s documents as rows (its other columns, at, words), sorted by their moments over ranges."""
    others = [c for c in placed.columns if c != passes_col]
    return placed.select(*others, F.inline(passes_col).alias("at", "words")).orderBy("at", *others[:1])
