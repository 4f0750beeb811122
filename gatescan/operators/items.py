"""From stored OCR pages to item lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatescan.functions.geometry import normalize_quad
from gatescan.functions.text import item_text
from gatescan.schemas import ITEM, POINTS

_NONE = f"array<{ITEM}>"


def _item(box: Column, text: Column, score: Column, inv_scale: Column, dx: Column, dy: Column) -> Column:
    return F.struct(normalize_quad(box, inv_scale, dx, dy).alias("box"), text.alias("text"), score.alias("confidence"))


def dict_page_items(page: Column, inv_scale: Column, dx: Column, dy: Column) -> Column:
    """Items of a page of parallel arrays: texts and scores to the shorter length, missing boxes empty, blank texts dropped."""
    texts, scores = page["rec_texts"], page["rec_scores"]
    n = F.least(F.coalesce(F.size(texts), F.lit(0)), F.coalesce(F.size(scores), F.lit(0)))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    items = F.transform(places, lambda i: _item(F.get(page["dt_polys"], i), item_text(F.get(texts, i)), F.get(scores, i), inv_scale, dx, dy))
    return F.filter(items, lambda x: x["text"] != "")


def list_page_items(page: Column, inv_scale: Column, dx: Column, dy: Column) -> Column:
    """Items of a page given as JSON text `[[box, [text, score]], ...]`; lines with fewer than two parts are skipped."""
    lines = F.filter(F.transform(F.from_json(page, "array<string>"), lambda x: F.from_json(x, "array<string>")), lambda x: F.size(x) >= 2)
    parts = F.transform(lines, lambda x: F.struct(F.from_json(x[0], POINTS).alias("box"), F.from_json(x[1], "array<string>").alias("read")))
    items = F.transform(parts, lambda x: _item(x["box"], item_text(F.get(x["read"], F.lit(0))), F.get(x["read"], F.lit(1)).try_cast("double"), inv_scale, dx, dy))
    return F.coalesce(F.filter(items, lambda x: x["text"] != ""), F.array().cast(_NONE))


def variant_page_items(page: Column, inv_scale: Column, dx: Column, dy: Column) -> Column:
    """Items of a page that is a variant of either shape: an object of parallel arrays, or a list of `[box, [text, score]]`. Nothing
    is parsed again; values of another kind count as missing."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    parallel = F.struct(
        F.transform(get(page, "$.dt_polys", "array<variant>"), lambda b: get(b, "$", POINTS)).alias("dt_polys"), F.transform(get(page, "$.rec_texts", "array<variant>"), lambda t: get(t, "$", "string")).alias("rec_texts"),
        F.transform(get(page, "$.rec_scores", "array<variant>"), lambda s: get(s, "$", "double")).alias("rec_scores"),
    )
    lines = F.filter(get(page, "$", "array<variant>"), lambda x: F.size(get(x, "$", "array<variant>")) >= 2)
    listed = F.transform(lines, lambda x: _item(get(x, "$[0]", POINTS), item_text(get(x, "$[1][0]", "string")), get(x, "$[1][1]", "double"), inv_scale, dx, dy))
    return F.coalesce(F.filter(listed, lambda i: i["text"] != ""), dict_page_items(parallel, inv_scale, dx, dy))


def pages_to_items(df: DataFrame, pages_col: str = "pages", inv_scale: Column | None = None, dx: Column | None = None, dy: Column | None = None) -> DataFrame:
    """df with a column items: all pages' items in order. pages_col is an array of page structs, or of variants or JSON texts of either shape."""
    inv_scale, dx, dy = F.lit(1.0) if inv_scale is None else inv_scale, F.lit(0.0) if dx is None else dx, F.lit(0.0) if dy is None else dy
    kind = df.schema[pages_col].dataType.elementType.typeName()
    if kind == "variant":
        one = lambda p: variant_page_items(p, inv_scale, dx, dy)
    elif kind == "string":
        from gatescan.schemas import PAGE

        one = lambda p: F.when(F.ltrim(p).startswith("["), list_page_items(p, inv_scale, dx, dy)).otherwise(dict_page_items(F.from_json(p, PAGE), inv_scale, dx, dy))
    else:
        one = lambda p: dict_page_items(p, inv_scale, dx, dy)
    return df.withColumn("items", F.coalesce(F.flatten(F.transform(pages_col, one)), F.array().cast(_NONE)))
