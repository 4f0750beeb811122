"""Evaluation of recognised frames against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatescan.functions import text as X
from gatescan.operators.prefilter import bloom_filter, might_contain
from gatescan.operators.scoring import score_ocr_items
from gatescan.schemas import RAW_ITEM

#: Names that a manifest may give its columns. Fixed values.
ALIASES = {"image": ("image", "image_path", "path", "file"), "expected_name": ("expected_name", "name", "holder_name"), "expected_seat": ("expected_seat", "seat", "seat_number")}


def coalesce_aliases(rows: DataFrame, first_present: bool = False) -> DataFrame:
    """image, expected_name and expected_seat from whatever aliases there are, and the other columns left out but row_number.

    first_present takes the first alias that is a column, nulls as '' (for CSV, whose empty cells read as null); else each row
    takes its first alias that isn't null.
    """
    def pick(names: tuple[str, ...]) -> Column:
        there = [F.col(n).cast("string") for n in names if n in rows.columns]
        return F.coalesce(*(there[:1] if first_present else there), F.lit(""))

    kept = ["row_number"] if "row_number" in rows.columns else []
    return rows.select(*kept, *[pick(names).alias(c) for c, names in ALIASES.items()])


def require_image(cases: DataFrame) -> DataFrame:
    """Fails on a case without an image, naming its row."""
    # the message is a fixed value
    message = F.concat(F.lit("Manifest row "), F.col("row_number").cast("string"), F.lit(" is missing image/image_path/path"))
    return cases.where(F.when(F.col("image") == "", F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def attach_responses(cases: DataFrame, responses: DataFrame, images: DataFrame) -> DataFrame:
    """Every case, duplicates too, with the response of its image. found tells whether the image exists.

    responses: image, results (JSON text or item array), latency_ms, error and more; one response is kept per image (the smallest
    by latency). Responses of other images are left out where they are read, by a Bloom filter of the cases' images, before their
    results are parsed or moved. Images are found by their paths without scheme and host. A case without an image gets the error `image not found: <path>`; results that are no list are empty.
    """
    items = f"array<{RAW_ITEM}>"
    responses = responses.where(might_contain(bloom_filter(cases, "image"), F.col("image")))
    parsed = responses
    if responses.schema["results"].dataType.typeName() == "string":
        parsed = responses.withColumn("results", F.when(F.ltrim("results").startswith("["), F.from_json("results", items)))
    others = [c for c in parsed.columns if c != "image"]
    wanted = parsed.join(cases.select("image").distinct(), "image", "left_semi")  # before results go through the aggregate
    one = wanted.groupBy("image").agg(F.min_by(F.struct(*others), F.struct("latency_ms", F.col("error").isNotNull())).alias("r"))
    known = images.select(X.plain_path(F.col("image")).alias("__plain")).distinct().withColumn("found", F.lit(True))
    joined = cases.withColumn("__plain", X.plain_path(F.col("image"))).join(one, "image", "left").join(known, "__plain", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    empty = F.array().cast(parsed.schema["results"].dataType)
    missing = F.concat(F.lit("image not found: "), F.col("image"))  # a fixed value
    error = F.when(~F.col("found"), missing).when(F.col("r").isNull(), F.lit("no response")).otherwise(F.col("r.error"))
    rest = [F.when(F.col("found"), F.col(f"r.{c}")).alias(c) for c in others if c not in ("results", "error")]
    return joined.select(*cases.columns, "found", F.when(error.isNull(), F.coalesce("r.results", empty)).otherwise(empty).alias("items"), error.alias("error"), *rest)


def compare_expected(df: DataFrame, actual_name: Column, actual_seat: Column, exact: bool = True) -> DataFrame:
    """df with actual_name, actual_seat, name_match, seat_match and passed. A match needs a non-empty expected value."""
    def match(expected: Column, actual: Column) -> Column:
        return (expected != "") & (expected == actual)

    empty = lambda c: F.coalesce(c, F.lit(""))
    df = df.withColumn("actual_name", actual_name).withColumn("actual_seat", actual_seat)
    df = df.withColumn("name_match", match(X.expected_name_key(F.col("expected_name"), exact), X.expected_name_key(F.col("actual_name"), exact)))
    df = df.withColumn("seat_match", match(X.sanitize_seat(empty(F.col("expected_seat"))), X.sanitize_seat(empty(F.col("actual_seat")))))
    return df.withColumn("passed", F.col("name_match") & F.col("seat_match"))


def evaluate(cases: DataFrame, responses: DataFrame, images: DataFrame, exact: bool = True) -> DataFrame:
    """One record per case. Failed and missing cases have passed = false, their error, and nulls for what wasn't compared."""
    scored = score_ocr_items(attach_responses(cases, responses, images))
    s, ok = F.col("scored"), F.col("error").isNull()
    found = compare_expected(scored, F.when(ok, s["selected_name"]["text"]), F.when(ok, s["selected_seat"]["text"]), exact)
    only = lambda c, name: F.when(ok, c).alias(name)
    extra = [only(F.col(c), c) for c in ("backend_total_ms", "backend_path", "selected_pass") if c in found.columns]
    return found.select(
        *cases.columns, "actual_name", "actual_seat", only(F.col("name_match"), "name_match"), only(F.col("seat_match"), "seat_match"), (ok & F.col("passed")).alias("passed"),
        only(X.rounded(F.col("latency_ms"), 2), "latency_ms"), *extra, only(s["failure_reason"], "parse_reason"), only(X.rounded(s["score"], 4), "score"), only(s["confidence"], "confidence"),
        only(F.size("items"), "ocr_count"), "error",
    )


def summarize(records: DataFrame) -> DataFrame:
    """One row: total, passed, failed, success_rate (0.0 of nothing), avg_latency_ms (null without latencies) and gate_failed."""
    n = records.agg(F.count("*").alias("total"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"), F.avg("latency_ms").alias("avg"))
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.col("passed") / F.col("total"))
    return n.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), X.rounded(rate, 4).alias("success_rate"), X.rounded(F.col("avg"), 2).alias("avg_latency_ms"), (F.col("passed") < F.col("total")).alias("gate_failed"))
