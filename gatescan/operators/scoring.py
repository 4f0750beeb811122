"""Seat and name candidates of a frame, the selection among them, and the frame's score.

The nested form works on an array of items without a shuffle: each item is prepared once, all else selects from that. The
exploded form takes an item a row and aggregates with max_by, without collecting the items of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatescan.functions import text as X

_PREPARED = "__prepared"


def _prepare(items: Column, collapse: bool) -> Column:
    """Each item's text, confidence, place, seat code and name ('' if it has none). One transform after the other, so that what
    several tests read is computed once."""
    texts = F.transform(items, lambda x, i: F.struct(X.item_text(x["text"]).alias("raw_text"), X.strip(x["confidence"].cast("string")).alias("number"), i.cast("int").alias("index")))
    parts = F.transform(texts, lambda x: F.struct(x["raw_text"].alias("raw_text"), X.confidence_of(x["number"]).alias("confidence"), x["index"].alias("index"), X.find_seat(x["raw_text"]).alias("seat"), (X.normalize_name(x["raw_text"]) if collapse else x["raw_text"]).alias("name")))
    found = F.transform(parts, lambda x: F.struct(x["confidence"].alias("confidence"), x["index"].alias("index"), x["raw_text"].alias("raw_text"), x["seat"].alias("seat"), F.when(X.name_like(x["name"], collapse), x["name"]).otherwise("").alias("name")))
    none = F.array().cast("array<struct<confidence:double,index:int,raw_text:string,seat:string,name:string>>")
    return F.coalesce(found, none)


def _candidates(prepared: Column, kind: str) -> Column:
    found = F.transform(F.filter(prepared, lambda x: x[kind] != ""), lambda x: F.struct(x[kind].alias("text"), x["confidence"].alias("confidence"), x["index"].alias("index"), x["raw_text"].alias("raw_text")))
    # the best first; equal confidences keep the order of lines
    ordered = F.array_sort(F.transform(found, lambda x: F.struct((-x["confidence"]).alias("k"), x["index"].alias("i"), x.alias("c"))))
    return F.transform(ordered, lambda x: x["c"])


def seat_candidates(items: Column) -> Column:
    return _candidates(_prepare(items, True), "seat")


def name_candidates(items: Column) -> Column:
    return _candidates(_prepare(items, True), "name")


def _verdict(n_items: Column, seat: Column, name: Column, any_name: Column) -> dict[str, Column]:
    """All scored fields from the two selected candidates."""
    has_seat, complete = seat.isNotNull(), seat.isNotNull() & name.isNotNull()
    seat_c, name_c = F.coalesce(seat["confidence"], F.lit(0.0)), F.coalesce(name["confidence"], F.lit(0.0))
    combined = F.when(complete, F.least(seat_c, name_c)).otherwise(F.greatest(seat_c, name_c))
    reason = (
        F.when(n_items == 0, "no_ocr_items")
        .when(~has_seat, "no_seat_candidate")
        .when(name.isNull(), F.when(any_name, "name_candidates_only_on_seat_line").otherwise("no_name_candidate"))
    )
    score = F.when(has_seat, 200.0).otherwise(0.0) + F.when(name.isNotNull(), 100.0).otherwise(0.0) + combined
    return {"is_complete": complete, "failure_reason": reason, "score": score, "seat_confidence": seat_c, "name_confidence": name_c, "combined": combined}


def score_ocr_items(df: DataFrame, items_col: str = "items", out: str = "scored", collapse: bool = True) -> DataFrame:
    """df with a struct column of candidates, selections, confidences, score, completeness and failure reason."""
    df = df.withColumn(_PREPARED, _prepare(F.col(items_col), collapse))
    df = df.withColumn("__seats", _candidates(F.col(_PREPARED), "seat")).withColumn("__names", _candidates(F.col(_PREPARED), "name")).drop(_PREPARED)
    df = df.withColumn("__seat", F.get("__seats", F.lit(0)))
    other = F.filter("__names", lambda x: F.col("__seat").isNull() | (x["index"] != F.col("__seat")["index"]))
    df = df.withColumn("__name", F.get(other, F.lit(0)))
    n = F.coalesce(F.size(items_col), F.lit(0))
    v = _verdict(F.greatest(n, F.lit(0)), F.col("__seat"), F.col("__name"), F.size("__names") > 0)
    scored = F.struct(
        v["is_complete"].alias("is_complete"), v["failure_reason"].alias("failure_reason"), v["score"].alias("score"),
        F.col("__seats").alias("seat_candidates"), F.col("__names").alias("name_candidates"), F.col("__seat").alias("selected_seat"), F.col("__name").alias("selected_name"),
        F.struct(v["seat_confidence"].alias("seat"), v["name_confidence"].alias("name"), v["combined"].alias("combined")).alias("confidence"),
    )
    return df.withColumn(out, scored).drop("__seats", "__names", "__seat", "__name")


def score_exploded(df: DataFrame, keys: list[str], index_col: str = "item_index", text_col: str = "text", confidence_col: str = "confidence") -> DataFrame:
    """keys, the selected candidates and the scored fields, from an item a row. Both steps share one shuffle by the keys: the
    seat comes from an unordered window, the best name off its line from the aggregation after it."""
    raw = X.item_text(F.col(text_col))
    rows = df.select(*keys, F.col(index_col).cast("int").alias("index"), X.item_confidence(F.col(confidence_col)).alias("confidence"), raw.alias("raw_text"))
    rows = rows.withColumn("seat", F.when(F.col("raw_text") != "", X.extract_seat(F.col("raw_text")))).withColumn("name", F.when(X.looks_like_name(F.col("raw_text")), X.normalize_name(F.col("raw_text"))))
    order = F.struct(F.col("confidence"), -F.col("index"))
    candidate = lambda kind: F.struct(F.col(kind).alias("text"), "confidence", "index", "raw_text")
    seat = F.max_by(F.when(F.col("seat").isNotNull(), candidate("seat")), F.when(F.col("seat").isNotNull(), order))
    rows = rows.withColumn("selected_seat", seat.over(Window.partitionBy(*keys)))
    off_line = F.col("name").isNotNull() & (F.col("selected_seat").isNull() | (F.col("index") != F.col("selected_seat.index")))
    top = rows.groupBy(*keys).agg(
        F.count("*").alias("n_items"), F.first("selected_seat").alias("selected_seat"), F.count("name").alias("n_names"), F.count("seat").alias("n_seats"),
        F.max_by(F.when(off_line, candidate("name")), F.when(off_line, order)).alias("selected_name"),
    )
    v = _verdict(F.col("n_items"), F.col("selected_seat"), F.col("selected_name"), F.col("n_names") > 0)
    return top.select(*keys, "n_items", "n_seats", "n_names", "selected_seat", "selected_name", *[c.alias(k) for k, c in v.items()])


def compact_scored(scored: Column) -> Column:
    """Selections, the score to four places and the numbers of candidates."""
    kept = ("is_complete", "failure_reason", "selected_seat", "selected_name", "confidence")
    return F.struct(*[scored[k].alias(k) for k in kept], X.rounded(scored["score"], 4).alias("score"), F.size(scored["seat_candidates"]).alias("seat_candidate_count"), F.size(scored["name_candidates"]).alias("name_candidate_count"))


def parse_result(df: DataFrame, items_col: str = "items", out: str = "parsed") -> DataFrame:
    """df with the browser's reading of a frame: holder and seat only if both were found; partial_name and partial_seat always.
    Names keep their inner white space."""
    df = score_ocr_items(df, items_col, "__scored", collapse=False)
    s = F.col("__scored")
    whole = lambda c: F.when(s["is_complete"], c)
    seat, name = s["selected_seat"], s["selected_name"]
    parsed = F.struct(
        whole(name["text"]).alias("holder_name"), whole(seat["text"]).alias("seat_number"), whole(name["confidence"]).alias("name_confidence"), whole(seat["confidence"]).alias("seat_confidence"),
        whole(F.least(name["confidence"], seat["confidence"])).alias("combined"), s["is_complete"].alias("complete"), s["failure_reason"].alias("failure_reason"),
        name["text"].alias("partial_name"), seat["text"].alias("partial_seat"), X.strip(name["text"]).alias("lookup_name"),
    )
    return df.withColumn(out, parsed).drop("__scored")
