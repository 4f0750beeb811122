"""The seat directory, recordings of seats, and what to announce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatescan.functions import text as X


def parse_directory_row(line: Column) -> Column:
    """struct<seat, name> of a line: the first comma splits. Null if there is none, or at either end, or a side is blank."""
    line = X.strip(line)
    at = F.instr(line, ",")
    seat, name = X.strip(F.substr(line, F.lit(1), at - 1)), X.strip(F.substr(line, at + 1))
    ok = (at > 1) & (at < F.length(line)) & (seat != "") & (name != "")
    return F.when(ok, F.struct(seat.alias("seat"), name.alias("name")))


def build_directory(rows: DataFrame, exact: bool = True) -> DataFrame:
    """name_key and seat, unique on name_key: of rows (line_no, seat, name) with the same key the last line wins."""
    # a test of the key itself would be pushed below the Python helper and run it twice; only blank names have empty keys
    named = rows.where((X.strip(F.col("name")) != "") & (F.col("seat") != ""))
    keyed = named.select("line_no", "seat", X.lookup_key(F.col("name"), exact).alias("name_key"))
    return keyed.groupBy("name_key").agg(F.max_by("seat", "line_no").alias("seat"))


def resolve_seats(parsed: DataFrame, directory: DataFrame, name_col: str = "lookup_name", exact: bool = True) -> DataFrame:
    """parsed with resolved_seat, null without a match. Rows without a name take no part in the join."""
    keyed = parsed.withColumn("__key", F.nullif(X.lookup_key(F.col(name_col), exact), F.lit("")))
    seats = directory.select(F.col("name_key").alias("__key"), F.col("seat").alias("resolved_seat"))
    return keyed.join(seats, "__key", "left").drop("__key")


def audio_coverage(directory: DataFrame, audio: DataFrame) -> DataFrame:
    """seat, in_directory, has_audio over all seats of either side."""
    d = directory.select("seat").distinct().withColumn("in_directory", F.lit(True))
    a = audio.select("seat").distinct().withColumn("has_audio", F.lit(True))
    return d.join(a, "seat", "full").select("seat", F.coalesce("in_directory", F.lit(False)).alias("in_directory"), F.coalesce("has_audio", F.lit(False)).alias("has_audio"))


def with_audio(resolved: DataFrame, audio: DataFrame) -> DataFrame:
    """resolved with has_audio: whether its resolved_seat has a recording."""
    a = audio.select(F.col("seat").alias("resolved_seat")).distinct().withColumn("has_audio", F.lit(True))
    return resolved.join(a, "resolved_seat", "left").withColumn("has_audio", F.coalesce("has_audio", F.lit(False)))


def resolve_audio(df: DataFrame, directory_available: bool = True, directory_error: str = "Unable to load names.csv", play_error: str = "Audio playback failed") -> DataFrame:
    """df with status, message and source_url. It has failed, lookup_name, resolved_seat, has_audio and suppressed."""
    name, seat = F.nullif(F.col("lookup_name"), F.lit("")), F.col("resolved_seat")
    failed = F.coalesce(F.col("failed"), F.lit(False))
    cases = [
        (failed, "error", F.lit("error (OCR request failed before audio lookup)"), None),
        (name.isNull(), "skipped", F.lit("skipped (no parsed name)"), None),
        (F.lit(not directory_available), "error", F.lit(f"error ({directory_error})"), None),
        (seat.isNull(), "skipped", F.concat(F.lit("skipped (no CSV match for "), name, F.lit(")")), None),
        (F.coalesce(F.col("suppressed"), F.lit(False)), "skipped", F.concat(F.lit("skipped (already played "), seat, F.lit(".wav in continuous mode)")), X.audio_url(seat)),
        (F.col("has_audio"), "playing", F.concat(F.lit("playing "), seat, F.lit(".wav")), X.audio_url(seat)),
    ]
    status, message, url = F.lit("error"), F.lit(f"error ({play_error})"), F.lit(None).cast("string")
    for test, s, m, u in reversed(cases):
        status = F.when(test, F.lit(s)).otherwise(status)
        message = F.when(test, m).otherwise(message)
        url = F.when(test, u if u is not None else F.lit(None).cast("string")).otherwise(url)
    return df.withColumn("status", status).withColumn("message", message).withColumn("source_url", url)
