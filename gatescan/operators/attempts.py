"""Attempts of a frame: one row per (frame, stage) with items and score. Union, fallback gate, best of all, and profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatescan.functions.text import rounded

NO_ATTEMPT = "no_ocr_attempts"
#: Least area of a region as a share of the image, least solidity, and range of width to height. Fixed values.
LEAST_AREA, LEAST_SOLIDITY, ASPECTS = 0.01, 0.7, (0.5, 5.0)
#: Stages from this one on are fallback passes.
FALLBACK_STAGE = 2


def union_attempts(*stages: DataFrame) -> DataFrame:
    """All stages' attempts, stage_index being the place in the call if a table has none. A failed attempt has no items, but its error."""
    indexed = [d if "stage_index" in d.columns else d.withColumn("stage_index", F.lit(k)) for k, d in enumerate(stages)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), indexed)
    empty = F.array().cast(whole.schema["items"].dataType)
    return whole.withColumn("items", F.when(F.col("error").isNull(), F.coalesce("items", empty)).otherwise(empty))


def needs_fallback(attempts: DataFrame, frames: DataFrame, key: str = "frame_id") -> DataFrame:
    """The frames none of whose primary attempts is complete."""
    done = attempts.where("is_complete").select(key).distinct()
    return frames.select(key).join(done, key, "left_anti")


def apply_fallback(primary: DataFrame, fallback: DataFrame, frames: DataFrame, key: str = "frame_id") -> DataFrame:
    """The primary attempts, and the fallback attempts of the frames that need one."""
    return primary.unionByName(fallback.join(needs_fallback(primary, frames, key), key, "left_semi"), allowMissingColumns=True)


def gate_fallback(attempts: DataFrame, fallback_stage: int = FALLBACK_STAGE, key: str = "frame_id") -> DataFrame:
    """apply_fallback() where all stages are in one table: fallback attempts of frames with a complete primary attempt go. One shuffle."""
    primary = F.col("stage_index") < fallback_stage
    done = F.coalesce(F.bool_or(primary & F.col("is_complete")).over(Window.partitionBy(key)), F.lit(False))
    return attempts.withColumn("__done", done).where(primary | ~F.col("__done")).drop("__done")


def _best(columns: list[str]):
    """Of a group the attempt of highest score, the earliest stage on ties."""
    return F.max_by(F.struct(*columns), F.struct(F.col("score"), -F.col("stage_index")))


def _failure(attempts: DataFrame, fallback_stage: int) -> Column:
    """The error of a frame's failed fallback, or null; an aggregate."""
    error = F.col("error") if "error" in attempts.columns else F.lit(None)
    return F.max(F.when(F.col("stage_index") >= fallback_stage, error.cast("string")))


def select_best_attempt(attempts: DataFrame, frames: DataFrame, fallback_stage: int = FALLBACK_STAGE, key: str = "frame_id") -> DataFrame:
    """One row per frame with the columns of its best attempt and path, the stage's name. A frame whose fallback has failed fails
    as a whole: its error, and null elsewhere. One without attempts has path `no_ocr_attempts`."""
    columns = [c for c in attempts.columns if c != key]
    best = attempts.groupBy(key).agg(_best(columns).alias("b"), _failure(attempts, fallback_stage).alias("f"))
    found = frames.select(key).join(best, key, "left")
    own = lambda x: F.when(F.col("f").isNull(), x)
    picked = [F.coalesce("f", "b.error").alias(c) if c == "error" else own(F.col(f"b.{c}")).alias(c) for c in columns]
    return found.select(key, *picked, own(F.coalesce("b.stage", F.lit(NO_ATTEMPT))).alias("path"))


def profile_frames(attempts: DataFrame, frames: DataFrame, fallback_stage: int, key: str = "frame_id") -> DataFrame:
    """Sums of OCR times, the chosen path and score, and the numbers of attempts and accepted ones, rounded for reports. A frame
    whose fallback has failed has its error and the two numbers, and null elsewhere."""
    ms = lambda fallback: F.coalesce(F.sum(F.when((F.col("stage_index") >= fallback_stage) == fallback, F.col("ocr_ms"))), F.lit(0.0))
    sums = attempts.groupBy(key).agg(ms(False).alias("mobile_ocr_ms"), ms(True).alias("fallback_ocr_ms"), F.count("*").alias("n_attempts"), F.count_if("is_complete").alias("n_accepted"), _best(["stage", "score", "output_count"]).alias("b"), _failure(attempts, fallback_stage).alias("f"))
    found = frames.select(key).join(sums, key, "left")
    own = lambda x: F.when(F.col("f").isNull(), x)
    zero = lambda c: own(F.coalesce(F.col(c), F.lit(0.0)))
    return found.select(
        key, rounded(zero("mobile_ocr_ms") + zero("fallback_ocr_ms"), 2).alias("ocr_ms"), rounded(zero("mobile_ocr_ms"), 2).alias("mobile_ocr_ms"), rounded(zero("fallback_ocr_ms"), 2).alias("fallback_ocr_ms"),
        F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"), F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"),
        own(F.coalesce("b.stage", F.lit(NO_ATTEMPT))).alias("path"), rounded(zero("b.score"), 4).alias("selected_score"), own(F.coalesce("b.output_count", F.lit(0))).alias("output_count"), F.col("f").alias("error"),
    )


def fused_best(attempts: DataFrame, frames: DataFrame, fallback_stage: int, columns: list[str], key: str = "frame_id") -> DataFrame:
    """Gate, choice and profile in one aggregation by frame: attempts hold the fallback outputs of all frames, and those of frames
    with a complete primary attempt are ignored. A frame whose fallback has failed has its error and null elsewhere. Rows are narrowed before the only shuffle, and no items are collected."""
    primary = F.col("stage_index") < fallback_stage
    order = F.struct(F.col("score"), -F.col("stage_index"))
    picked = F.struct("stage", "stage_index", "score", *columns)
    both = attempts.groupBy(key).agg(
        F.coalesce(F.bool_or(primary & F.col("is_complete")), F.lit(False)).alias("done"),
        F.max_by(F.when(primary, picked), F.when(primary, order)).alias("p"), F.max_by(picked, order).alias("a"),
        F.count_if(primary).alias("n_primary"), F.count("*").alias("n_all"), F.count_if(primary & F.col("is_complete")).alias("accepted_primary"), F.count_if(F.col("is_complete")).alias("accepted_all"),
        F.coalesce(F.sum(F.when(primary, F.col("ocr_ms"))), F.lit(0.0)).alias("mobile_ocr_ms"), F.coalesce(F.sum(F.when(~primary, F.col("ocr_ms"))), F.lit(0.0)).alias("all_fallback_ms"), _failure(attempts, fallback_stage).alias("f"),
    )
    both = both.select(key, F.when(F.col("done"), F.col("p")).otherwise(F.col("a")).alias("b"), "mobile_ocr_ms", F.when(F.col("done"), 0.0).otherwise(F.col("all_fallback_ms")).alias("fallback_ocr_ms"), F.when(~F.col("done"), F.col("f")).alias("error"), *[F.when(F.col("done"), F.col(f"{a}_primary")).otherwise(F.col(f"{a}_all")).alias(f"n_{b}") for a, b in (("n", "attempts"), ("accepted", "accepted"))])
    found = frames.select(key).join(both, key, "left")
    own = lambda x: F.when(F.col("error").isNull(), x)
    zero = lambda c: own(F.coalesce(c, F.lit(0.0)))
    return found.select(key, own(F.coalesce("b.stage", F.lit(NO_ATTEMPT))).alias("path"), zero("b.score").alias("score"), *[own(F.col(f"b.{c}")).alias(c) for c in columns], zero("mobile_ocr_ms").alias("mobile_ocr_ms"), zero("fallback_ocr_ms").alias("fallback_ocr_ms"), "error", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_attempts", "n_accepted")])


def select_label_region(regions: DataFrame, frames: DataFrame, key: str = "frame_id") -> DataFrame:
    """For each frame the largest acceptable region (contour_index, x, y, w, h, area), the earliest on ties, or nulls. The size of
    the image is joined to regions that pass on their own shape."""
    rect = F.col("w") * F.col("h")
    shaped = regions.where((rect > 0) & (F.col("area") > 0)).where((F.col("area") / rect >= LEAST_SOLIDITY) & (F.col("w") / F.col("h")).between(*ASPECTS))
    sized = shaped.join(frames.select(key, F.col("width").alias("image_w"), F.col("height").alias("image_h")), key)
    large = sized.where(F.col("area") >= F.col("image_w").cast("double") * F.col("image_h") * LEAST_AREA)
    best = large.groupBy(key).agg(F.max_by(F.struct("contour_index", "x", "y", "w", "h", "area"), F.struct(F.col("area"), -F.col("contour_index"))).alias("r"))
    return frames.select(key).join(best.select(key, "r.*"), key, "left")


def explode_attempts(diagnostics: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per validation attempt of a diagnostic record: key, attempt_index, stage, engine, accepted, reason, score, ocr_ms, error."""
    rows = diagnostics.select(key, F.posexplode_outer("label_detection.validation_attempts").alias("attempt_index", "a"))
    return rows.select(key, "attempt_index", "a.stage", "a.engine", "a.accepted", F.col("a.parse_reason").alias("reason"), "a.score", "a.ocr_ms", "a.error")
