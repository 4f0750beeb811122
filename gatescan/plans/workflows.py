"""The three whole workflows: recognising frames, evaluating labelled images, and the continuous scan in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatescan.operators.attempts import FALLBACK_STAGE, fused_best
from gatescan.operators.directory import resolve_audio, resolve_seats, with_audio
from gatescan.operators.evaluation import evaluate, summarize
from gatescan.operators.scoring import score_ocr_items
from gatescan.operators.sequences import classify_scan, state_requests, suppress_repeats, validate_transitions


def recognise(attempts: DataFrame, frames: DataFrame, fallback_stage: int = FALLBACK_STAGE, key: str = "frame_id") -> DataFrame:
    """One answer per frame: path, score, seat and name of the best attempt, and OCR times. Scoring needs no shuffle; gate,
    choice and profile share one, of narrow rows."""
    s = F.col("scored")
    rows = score_ocr_items(attempts).select(
        key, "stage", "stage_index", "ocr_ms", "error", s["is_complete"].alias("is_complete"), s["score"].alias("score"), s["failure_reason"].alias("failure_reason"),
        s["selected_seat"]["text"].alias("seat"), s["selected_name"]["text"].alias("name"), F.size("items").alias("output_count"),
    )
    return fused_best(rows, frames, fallback_stage, ["failure_reason", "seat", "name", "output_count"], key).drop("n_attempts", "n_accepted")


def evaluate_cases(cases: DataFrame, responses: DataFrame, images: DataFrame, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(summary, records)."""
    records = evaluate(cases, responses, images, exact)
    return summarize(records), records


def continuous_scan(scans: DataFrame, directory: DataFrame, audio: DataFrame, session: str = "session_id", order: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Parsed frames of sessions (lookup_name, complete, confidences, continuous, failed) with the announcement and the outcome."""
    known = with_audio(resolve_seats(scans, directory, exact=exact), audio)
    known = known.withColumn("resolved_seat", F.when(~F.col("failed"), F.col("resolved_seat"))).withColumn("has_audio", F.col("has_audio") & ~F.col("failed"))
    return classify_scan(resolve_audio(suppress_repeats(known, session, order)))


def scan_states(scans: DataFrame, session: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """The state changes that classified frames ask for: two requests each, validated in order."""
    return validate_transitions(state_requests(scans), session, [*(order or ["ts"]), "step"])
