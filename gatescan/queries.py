"""The registered queries, one per operation, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatescan.fixtures import seat, sql, view
from gatescan.functions import geometry as G
from gatescan.functions import text as X
from gatescan.operators import attempts as A
from gatescan.operators import directory as D
from gatescan.operators import evaluation as E
from gatescan.operators import items as I
from gatescan.operators import scans as SC
from gatescan.operators import scoring as S
from gatescan.operators import sequences as T
from gatescan.plans import workflows as P
from gatescan.sources import files as FILES
from gatescan.sources import readers as IO
from gatescan.sources import writers as OUT
from gatescan.storage import shared_folder
from gatescan.streaming import streams as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ITEM_KEY = ["frame_id", "stage_index", "item_index"]
#: DuckDB's wording of the text rules.
_RAW = r"regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_NAME = r"trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g'))"
_CODE = "regexp_replace(upper(coalesce(text, '')), '[^A-Z0-9]', '', 'g')"
_SEAT = f"nullif(regexp_extract({_CODE}, '([0-9]{{2}}[A-Z]{{2}}[0-9]{{2}})', 1), '')"
_IS_NAME = f"(length({_NAME}) >= 2 and regexp_matches({_NAME}, '[A-Za-z一-鿿]') and not regexp_matches({_NAME}, '(?i)(seat|座位|姓名|name)') and lower({_NAME}) not in ('sample', 'graduate'))"


def _wide(df: DataFrame) -> DataFrame:
    """Integers as longs, as DuckDB counts."""
    return df.withColumns({k: c(k).cast("long") for k, t in df.dtypes if t == "int"})


def _register(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _wide(f(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _scalar(query: str, fixture: str, keys: list[str], columns: Callable[[], dict[str, Column]], oracle: dict[str, str]) -> None:
    """A query of key columns and one or more expressions over a view."""
    chosen = ", ".join([*keys, *[f"{text.replace(' as int)', ' as bigint)')} as {k}" for k, text in oracle.items()]])
    _register(query, f"select {chosen} from ({sql(fixture)}) v")(lambda spark, sf_dir: view(spark, sf_dir, fixture).select(*keys, *[x.alias(k) for k, x in columns().items()]))


c = F.col
_N = ["frame_id", "n"]
_scalar("f1_sanitize_seat", "fx_items", ITEM_KEY, lambda: {"code": X.sanitize_seat(c("text"))}, {"code": _CODE})
_scalar("f2_extract_seat", "fx_items", ITEM_KEY, lambda: {"seat": X.extract_seat(c("text"))}, {"seat": _SEAT})
_scalar("f3_normalize_name", "fx_items", ITEM_KEY, lambda: {"name": X.normalize_name(c("text"))}, {"name": _NAME})
_scalar("f5_looks_like_name", "fx_items", ITEM_KEY, lambda: {"is_name": X.looks_like_name(c("text"))}, {"is_name": _IS_NAME})
_scalar("f7_item_text", "fx_items", ITEM_KEY, lambda: {"raw": X.item_text(F.when(c("item_index") % 4 > 0, c("text")))}, {"raw": f"case when item_index % 4 > 0 then {_RAW} else '' end"})
_scalar("f8_item_confidence", "fx_text", _N, lambda: {"confidence": X.item_confidence(c("conf_text"))}, {"confidence": "coalesce(try_cast(trim(conf_text) as double), 0.0::double)"})
_scalar("f9_rounded", "fx_text", _N, lambda: {"four": X.rounded(c("k") / 7.0, 4), "two": X.rounded(c("k") / 3.0, 2)}, {"four": "round(k / 7.0::double, 4)", "two": "round(k / 3.0::double, 2)"})
_scalar("f10_utc_timestamp", "fx_frames", ["frame_id"], lambda: {"at": X.utc_timestamp(c("frame_id") * 86413 + 0.7)}, {"at": "strftime(timestamp '1970-01-01' + to_seconds(frame_id * 86413), '%Y-%m-%dT%H:%M:%SZ')"})

_L = "greatest(width, height)"


def _plan(plan: Callable[[Column, Column], Column], *fields: tuple[str, str]) -> Callable[[], dict[str, Column]]:
    return lambda: {k: plan(c("width"), c("height"))[f] for k, f in fields}


_scalar("f11_resize_plan", "fx_frames", ["frame_id"], _plan(G.resize_plan, ("scale", "scale"), ("out_w", "width"), ("out_h", "height")), {
    "scale": f"case when {_L} > 1920 then 1920.0::double / {_L} else 1.0::double end",
    "out_w": f"cast(case when {_L} > 1920 then greatest(1, trunc(width * (1920.0::double / {_L}))) else width end as int)",
    "out_h": f"cast(case when {_L} > 1920 then greatest(1, trunc(height * (1920.0::double / {_L}))) else height end as int)",
})
_scalar("f12_capture_plan", "fx_frames", ["frame_id"], _plan(G.capture_plan, ("out_w", "width"), ("out_h", "height")), {
    "out_w": f"cast(greatest(1, floor(width * least(1.0, 1280.0::double / {_L}) + 0.5)) as int)",
    "out_h": f"cast(greatest(1, floor(height * least(1.0, 1280.0::double / {_L}) + 0.5)) as int)",
})


@_register("f13_roi_bbox", f"""
select frame_id, stage, 0::bigint as x, cast(greatest(0, least(height - 1, trunc(height * (1.0::double - b)))) as bigint) as y,
  cast(greatest(1, least(width, trunc(width * l))) as bigint) as w,
  cast(greatest(1, height - greatest(0, least(height - 1, trunc(height * (1.0::double - b))))) as bigint) as h
from ({sql("fx_frames")}) f, (values ('bottom50_left60_mobile', 0.5::double, 0.6::double), ('bottom60_fullwidth_mobile', 0.6::double, 1.0::double)) p(stage, b, l)""")
def f13_roi_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    presets = F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(b).alias("b"), F.lit(w).alias("l")) for s, b, w in G.PRESETS]))
    rows = view(spark, sf_dir, "fx_frames").select("frame_id", "width", "height", presets)
    return rows.withColumn("r", G.roi_bbox(c("width"), c("height"), c("b"), c("l"))).select("frame_id", "stage", "r.*")


def _padded() -> dict[str, Column]:
    whole = lambda k, m: (c(k) % m).cast("int")
    box = F.when(c("frame_id") % 9 > 0, F.struct(whole("frame_id", 700).alias("x"), whole("width", 500).alias("y"), whole("height", 900).alias("w"), whole("width", 300).alias("h")))
    return {k: G.padded_bbox(box, c("width"), c("height"))[k] for k in "xywh"}


_PX, _PY = "trunc((height % 900) * 0.02::double)", "trunc((width % 300) * 0.02::double)"
_X1, _Y1 = f"greatest(0, frame_id % 700 - {_PX})", f"greatest(0, width % 500 - {_PY})"
_scalar("f14_padded_bbox", "fx_frames", ["frame_id"], _padded, {
    k: f"cast(case when frame_id % 9 > 0 then {v} end as int)" for k, v in {
        "x": _X1, "y": _Y1, "w": f"greatest(1, least(width, frame_id % 700 + height % 900 + {_PX}) - {_X1})", "h": f"greatest(1, least(height, width % 500 + width % 300 + {_PY}) - {_Y1})",
    }.items()
})


def _quad() -> dict[str, Column]:
    d = lambda k: c(k).cast("double")
    box = F.when(c("frame_id") % 8 > 0, F.array(F.array(d("width"), d("height")), F.array(F.lit(1.0)), F.array(d("height"), d("width"), F.lit(5.0))))
    quad = G.normalize_quad(box, F.lit(1.25), F.lit(10.0), F.lit(20.0))
    at = lambda i, j: F.get(F.get(quad, F.lit(i)), F.lit(j))
    return {"n": F.size(quad), "x1": at(0, 0), "y2": at(1, 1)}


_scalar("f15_normalize_quad", "fx_frames", ["frame_id"], _quad, {
    "n": "cast(case when frame_id % 8 > 0 then 2 else 0 end as int)", "x1": "case when frame_id % 8 > 0 then width * 1.25::double + 10 end", "y2": "case when frame_id % 8 > 0 then width * 1.25::double + 20 end",
})
_scalar("f16_audio_url", "fx_directory", ["line_no"], lambda: {"url": X.audio_url(c("seat")), "named": X.audio_url(c("name"))}, {"url": "'/audio/' || url_encode(seat) || '.wav'", "named": "'/audio/' || url_encode(name) || '.wav'"})
_scalar("f17_clean_threshold", "fx_text", _N, lambda: {"threshold": X.clean_threshold(c("setting"), 0.8)}, {"threshold": "greatest(0.0::double, least(1.0::double, coalesce(try_cast(nullif(setting, '') as double), 0.8::double)))"})


def _paths() -> dict[str, Column]:
    path = F.when(c("k") % 2 == 0, F.lit("/data/a.jpg")).otherwise(F.concat(F.lit("img/"), c("k").cast("string")))
    return {"path": X.resolve_path(path, "/m/x")}


_scalar("f19_resolve_path", "fx_text", _N, _paths, {"path": "case when k % 2 = 0 then '/data/a.jpg' else '/m/x/img/' || cast(k as string) end"})
_scalar("f22_attempt_label", "fx_text", _N, lambda: {"label": X.attempt_label(c("k")), "number": X.attempt_number(F.concat(F.lit("/r/"), X.attempt_label(c("k")), F.lit("/diag.json")))}, {
    "label": "'try_' || lpad(cast(k as string), greatest(4, length(cast(k as string)))::int, '0')", "number": "cast(k as int)",
})


def _failures() -> dict[str, Column]:
    status, error = F.when(c("k") % 13 == 0, 503).otherwise(200), F.when(c("k") % 17 == 0, " busy ").when(c("k") % 5 == 0, "  ")
    return {"failed": X.request_failed(status, c("k") % 7 > 0, error, c("k") % 1500, F.lit(900)), "message": X.request_failure_message(status, error)}


_scalar("f23_request_failure", "fx_text", _N, _failures, {
    "failed": "(k % 13 = 0 or k % 7 = 0 or k % 17 = 0 or k % 1500 > 900)",
    "message": "case when k % 17 = 0 then 'busy' else 'OCR backend returned ' || case when k % 13 = 0 then '503' else '200' end end",
})


def _distinct_text(key: str, value: Callable[[Column], Column], oracle: str) -> tuple[Query, str]:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, "fx_items").select("text").distinct().select("text", value(c("text")).alias(key))

    return f, f"select distinct text, {oracle} as {key} from ({sql('fx_items')}) v"


for _n, _v, _o in (("f4_expected_name_key", X.expected_name_key, f"lower({_NAME})"), ("f6_lookup_key", X.lookup_key, f"lower({_NAME})")):
    _f, _s = _distinct_text("name_key", _v, _o)
    _register(_n, _s)(_f)


@_register("f18_coalesce_aliases", """
select o_orderkey as row_number, coalesce(case when o_orderkey % 3 = 0 then 'a' || cast(o_orderkey as string) end, 'b' || cast(o_custkey as string)) as image,
  coalesce(case when o_orderkey % 5 = 0 then 'n' end, '') as expected_name, 's' || cast(o_custkey as string) as expected_seat from orders""")
def f18_coalesce_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, k: F.concat(F.lit(p), c(k).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        c("o_orderkey").alias("row_number"), F.when(c("o_orderkey") % 3 == 0, text("a", "o_orderkey")).alias("image"), text("b", "o_custkey").alias("path"), F.when(c("o_orderkey") % 5 == 0, "n").alias("holder_name"), text("s", "o_custkey").alias("seat_number")
    )
    return E.require_image(E.coalesce_aliases(rows))


@_register("f20_parse_directory_row", f"""
select line_no, case when line_no % 7 > 2 then seat end as seat, case when line_no % 7 > 2 then name || ', x' end as name from ({sql("fx_directory")}) v""")
def f20_parse_directory_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    seat, name, k = c("seat"), c("name"), c("line_no") % 7
    line = F.when(k == 0, seat).when(k == 1, F.concat(F.lit(","), name)).when(k == 2, F.concat(seat, F.lit(","))).otherwise(F.concat(F.lit(" "), seat, F.lit(" , "), name, F.lit(", x ")))
    return view(spark, sf_dir, "fx_directory").select("line_no", D.parse_directory_row(line).alias("r")).select("line_no", "r.seat", "r.name")


# -- items, attempts and scoring ---------------------------------------------------------------------------------------

_STAGES = ("bottom50_left60_mobile", "bottom60_fullwidth_mobile", "server_full_frame_fallback")


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_items as one row per frame and stage."""
    lists = F.array_sort(F.collect_list(F.struct("item_index", "text", "confidence")))
    rows = view(spark, sf_dir, "fx_items").groupBy("frame_id", "stage_index").agg(lists.alias("x"))
    box = F.array().cast("array<array<double>>")
    return rows.select("frame_id", "stage_index", F.transform("x", lambda i: F.struct(box.alias("box"), i["text"].alias("text"), i["confidence"].alias("confidence"))).alias("items"))


def attempts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_attempts, all stages."""
    rows = items_of(spark, sf_dir).withColumn("ocr_ms", (20 + (c("frame_id") * 7 + c("stage_index") * 13) % 500).cast("double"))
    rows = rows.withColumn("error", F.when((c("stage_index") < 2) & ((c("frame_id") + c("stage_index")) % 50 == 0), "engine failed").when((c("stage_index") == 2) & (c("frame_id") % 37 == 0), "fallback failed"))
    return rows.withColumn("stage", F.get(F.array(*map(F.lit, _STAGES)), c("stage_index").cast("int")))


def scored_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c("scored")
    rows = S.score_ocr_items(A.union_attempts(attempts_of(spark, sf_dir)))
    return rows.select("frame_id", "stage_index", "stage", "ocr_ms", "error", s["is_complete"].alias("is_complete"), s["score"].alias("score"), s["failure_reason"].alias("failure_reason"), s["selected_seat"]["text"].alias("seat"), s["selected_name"]["text"].alias("name"), F.size("items").alias("output_count"))


def _scoring_sql(failures: bool, stages: str = "frame_id, stage_index") -> str:
    """CTEs ending in `scored`: one row per frame and stage of fx_items; failures empties the failed attempts."""
    bad = "(stage_index < 2 and (frame_id + stage_index) % 50 = 0 or stage_index = 2 and frame_id % 37 = 0)" if failures else "false"
    return f"""
with it as (select *, {bad} as bad from ({sql("fx_items")}) v),
p as (select frame_id, stage_index, item_index, confidence, {_RAW} as raw, {_SEAT} as seat, case when {_IS_NAME} then {_NAME} end as name from it where not bad),
s as (select *, row_number() over (partition by frame_id, stage_index order by confidence desc, item_index) as r from p where seat is not null),
n as (select *, row_number() over (partition by frame_id, stage_index order by confidence desc, item_index) as r from p where name is not null),
s1 as (select * from s where r = 1),
n1 as (select n.frame_id, n.stage_index, min_by(n, n.r) as b from n left join s1 using (frame_id, stage_index) where s1.item_index is null or s1.item_index <> n.item_index group by n.frame_id, n.stage_index),
nn as (select frame_id, stage_index, count(*) as n_names from n group by all),
ns as (select frame_id, stage_index, count(*) as n_seats from s group by all),
g as (select frame_id, stage_index, count(*) filter (where not bad) as n_items, bool_or(bad) as bad from it group by all),
q as (select g.*, s1.seat, s1.confidence as sc, s1.item_index as si, n1.b.name as name, n1.b.confidence as nc, n1.b.item_index as ni, coalesce(n_names, 0) as n_names, coalesce(n_seats, 0) as n_seats
  from g left join s1 using (frame_id, stage_index) left join n1 using (frame_id, stage_index) left join nn using (frame_id, stage_index) left join ns using (frame_id, stage_index)),
scored as (select *, seat is not null and name is not null as is_complete,
  case when n_items = 0 then 'no_ocr_items' when seat is null then 'no_seat_candidate' when name is null and n_names > 0 then 'name_candidates_only_on_seat_line' when name is null then 'no_name_candidate' end as failure_reason,
  coalesce(sc, 0.0) as seat_confidence, coalesce(nc, 0.0) as name_confidence,
  case when seat is not null and name is not null then least(sc, nc) else greatest(coalesce(sc, 0.0), coalesce(nc, 0.0)) end as combined,
  case when seat is not null then 200.0 else 0.0 end + case when name is not null then 100.0 else 0.0 end
    + case when seat is not null and name is not null then least(sc, nc) else greatest(coalesce(sc, 0.0), coalesce(nc, 0.0)) end as score from q)"""


_PLAIN, _ATTEMPTS = _scoring_sql(False), _scoring_sql(True)
_ERROR_SQL = "case when bad and stage_index < 2 then 'engine failed' when bad then 'fallback failed' end"
_STAGE_SQL = "case stage_index when 0 then 'bottom50_left60_mobile' when 1 then 'bottom60_fullwidth_mobile' else 'server_full_frame_fallback' end"


@_register("a1_pages_to_items", f"""
with v as ({sql("fx_items")}), n as (select frame_id, stage_index, count(*) as n from v group by all)
select frame_id, stage_index, row_number() over (partition by frame_id, stage_index order by item_index) - 1 as pos, {_RAW} as text, confidence
from v join n using (frame_id, stage_index) where {_RAW} <> '' and (frame_id % 10 <> 0 or item_index < n - 1)""")
def a1_pages_to_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items_of(spark, sf_dir)
    n = F.size("items") - F.when(c("frame_id") % 10 == 0, 1).otherwise(0)
    page = F.struct(F.transform("items", lambda x: x["box"]).alias("dt_polys"), F.transform("items", lambda x: x["text"]).alias("rec_texts"), F.slice(F.transform("items", lambda x: x["confidence"]), F.lit(1), n).alias("rec_scores"))
    found = I.pages_to_items(rows.select("frame_id", "stage_index", F.array(page).alias("pages")))
    return found.select("frame_id", "stage_index", F.posexplode("items").alias("pos", "i")).select("frame_id", "stage_index", "pos", "i.text", "i.confidence")


def _ranked(kind: str, candidates: Callable[[Column], Column]) -> None:
    @_register(f"a{2 + (kind == 'name')}_{kind}_candidates", _PLAIN + f" select frame_id, stage_index, r - 1 as rank, {kind} as text, confidence, item_index as line, raw as raw_text from {kind[0]}")
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = items_of(spark, sf_dir).select("frame_id", "stage_index", F.posexplode(candidates(c("items"))).alias("rank", "x"))
        return rows.select("frame_id", "stage_index", "rank", "x.text", "x.confidence", c("x.index").alias("line"), "x.raw_text")


_ranked("seat", S.seat_candidates)
_ranked("name", S.name_candidates)


def _scored_view(query: str, oracle: str, columns: Callable[[], list[Column]]) -> None:
    _register(query, _PLAIN + f" select frame_id, stage_index, {oracle} from scored")(lambda spark, sf_dir: S.score_ocr_items(items_of(spark, sf_dir)).select("frame_id", "stage_index", *columns()))


def _selected(kind: str, with_line: bool = True) -> list[Column]:
    x = c("scored")[f"selected_{kind}"]
    return [x["text"].alias(kind), *([x["confidence"].alias("confidence"), x["index"].alias("line")] if with_line else [])]


def _fields(*names: str) -> list[Column]:
    return [c("scored")[k].alias(k) for k in names]


def _confidences(**names: str) -> list[Column]:
    return [c("scored")["confidence"][k].alias(a) for k, a in names.items()]


_FULL = "is_complete, failure_reason, score, seat, name, seat_confidence, name_confidence, combined, n_seats, n_names"
_scored_view("a4_select_seat", "seat, sc as confidence, si as line", lambda: _selected("seat"))
_scored_view("a5_select_name", "name, nc as confidence, ni as line", lambda: _selected("name"))
_scored_view("a6_score_frame", "score, is_complete, combined", lambda: _fields("score", "is_complete") + _confidences(combined="combined"))
_scored_view("a7_failure_reason", "failure_reason", lambda: _fields("failure_reason"))
_scored_view("a8_score_ocr_items", _FULL, lambda: [
    *_fields("is_complete", "failure_reason", "score"), *_selected("seat", False), *_selected("name", False), *_confidences(seat="seat_confidence", name="name_confidence", combined="combined"),
    F.size(c("scored")["seat_candidates"]).alias("n_seats"), F.size(c("scored")["name_candidates"]).alias("n_names"),
])


@_register("a8_score_exploded", _PLAIN + f" select frame_id, stage_index, {_FULL} from scored")
def a8_score_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.score_exploded(view(spark, sf_dir, "fx_items"), ["frame_id", "stage_index"])
    return found.select("frame_id", "stage_index", "is_complete", "failure_reason", "score", c("selected_seat.text").alias("seat"), c("selected_name.text").alias("name"), "seat_confidence", "name_confidence", "combined", "n_seats", "n_names")


@_register("a9_compact_scored", _PLAIN + " select frame_id, stage_index, is_complete, failure_reason, seat, name, round(score, 4) as score, n_seats as seat_candidate_count, n_names as name_candidate_count from scored")
def a9_compact_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.score_ocr_items(items_of(spark, sf_dir)).select("frame_id", "stage_index", S.compact_scored(c("scored")).alias("x"))
    return rows.select("frame_id", "stage_index", "x.is_complete", "x.failure_reason", c("x.selected_seat.text").alias("seat"), c("x.selected_name.text").alias("name"), "x.score", "x.seat_candidate_count", "x.name_candidate_count")


@_register("a10_parse_result", _PLAIN.replace(f"then {_NAME} end as name", f"then {_RAW} end as name") + """
 select frame_id, stage_index, case when is_complete then name end as holder_name, case when is_complete then seat end as seat_number, case when is_complete then least(nc, sc) end as combined,
   failure_reason, name as partial_name, seat as partial_seat from scored""")
def a10_parse_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.parse_result(items_of(spark, sf_dir))
    return rows.select("frame_id", "stage_index", *[c(f"parsed.{k}").alias(k) for k in ("holder_name", "seat_number", "combined", "failure_reason", "partial_name", "partial_seat")])


@_register("f21_preview", f"select frame_id, stage_index, least(count(*), 2) as n, max(case when item_index < 2 then item_index end) as last_index from ({sql('fx_items')}) v group by all")
def f21_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_items").groupBy("frame_id", "stage_index").agg(F.array_sort(F.collect_list("item_index")).alias("x"))
    return rows.select("frame_id", "stage_index", F.size(X.preview(c("x"), 2)).alias("n"), F.array_max(X.preview(c("x"), 2)).alias("last_index"))


@_register("a11_union_attempts", _ATTEMPTS + f" select frame_id, stage_index, {_STAGE_SQL} as stage, n_items, {_ERROR_SQL} as error from scored")
def a11_union_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts_of(spark, sf_dir)
    stages = [rows.where(c("stage_index") == k).drop("stage_index") for k in range(len(_STAGES))]
    return A.union_attempts(*stages).select("frame_id", "stage_index", "stage", F.size("items").alias("n_items"), "error")


_GATED = _ATTEMPTS + f""",
done as (select distinct frame_id from scored where stage_index < 2 and is_complete),
a as (select *, {_STAGE_SQL} as stage, cast(20 + (frame_id * 7 + stage_index * 13) % 500 as double) as ocr_ms from scored where stage_index < 2 or frame_id not in (select frame_id from done)),
best as (select *, row_number() over (partition by frame_id order by score desc, stage_index) as k from a),
fail as (select frame_id, 'fallback failed' as failed from a where bad and stage_index = 2)"""


@_register("a12_needs_fallback", _GATED + " select o_orderkey as frame_id from orders where o_orderkey not in (select frame_id from done)")
def a12_needs_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.needs_fallback(scored_attempts(spark, sf_dir).where("stage_index < 2"), view(spark, sf_dir, "fx_frames"))


@_register("a12_apply_fallback", _GATED + " select frame_id, stage_index, is_complete from a")
def a12_apply_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gate_fallback(scored_attempts(spark, sf_dir)).select("frame_id", "stage_index", "is_complete")


@_register("a13_select_best_attempt", _GATED + " select o_orderkey as frame_id, case when failed is null then coalesce(stage, 'no_ocr_attempts') end as path, case when failed is null then score end as score, case when failed is null then seat end as seat, case when failed is null then name end as name, case when failed is null then failure_reason end as failure_reason, coalesce(failed, case when bad then 'engine failed' end) as error from orders left join (select * from best where k = 1) b on b.frame_id = o_orderkey left join fail on fail.frame_id = o_orderkey")
def a13_select_best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_attempts(spark, sf_dir).withColumn("own_error", c("error"))
    best = A.fused_best(rows, view(spark, sf_dir, "fx_frames"), A.FALLBACK_STAGE, ["seat", "name", "failure_reason", "own_error"])
    score = F.when(c("path") != A.NO_ATTEMPT, c("score"))  # a frame without attempts has no score here
    return best.select("frame_id", "path", score.alias("score"), "seat", "name", "failure_reason", F.coalesce("error", "own_error").alias("error"))


@_register("a14_profile_frames", _GATED + """,
t as (select frame_id, sum(case when stage_index < 2 then ocr_ms else 0 end) as m, sum(case when stage_index = 2 then ocr_ms else 0 end) as f, count(*) as n_attempts, count(*) filter (where is_complete) as n_accepted from a group by frame_id)
select o_orderkey as frame_id, case when failed is null then coalesce(m + f, 0.0) end as ocr_ms, case when failed is null then coalesce(m, 0.0) end as mobile_ocr_ms, case when failed is null then coalesce(f, 0.0) end as fallback_ocr_ms, coalesce(n_attempts, 0) as n_attempts, coalesce(n_accepted, 0) as n_accepted,
  case when failed is null then coalesce(stage, 'no_ocr_attempts') end as path, case when failed is null then coalesce(round(score, 4), 0.0) end as selected_score, case when failed is null then coalesce(n_items, 0) end as output_count, failed as error
from orders left join t on t.frame_id = o_orderkey left join (select * from best where k = 1) b on b.frame_id = o_orderkey left join fail on fail.frame_id = o_orderkey""")
def a14_profile_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = A.fused_best(scored_attempts(spark, sf_dir), view(spark, sf_dir, "fx_frames"), A.FALLBACK_STAGE, ["output_count"])
    two = lambda x: X.rounded(x, 2)
    ms = [two(c("mobile_ocr_ms") + c("fallback_ocr_ms")).alias("ocr_ms"), two(c("mobile_ocr_ms")).alias("mobile_ocr_ms"), two(c("fallback_ocr_ms")).alias("fallback_ocr_ms")]
    count = F.when(c("error").isNull(), F.coalesce("output_count", F.lit(0))).alias("output_count")
    return best.select("frame_id", *ms, "n_attempts", "n_accepted", "path", X.rounded(c("score"), 4).alias("selected_score"), count, "error")


@_register("w1_recognise", _GATED + """,
t as (select frame_id, sum(case when stage_index < 2 then ocr_ms else 0 end) as m, sum(case when stage_index = 2 then ocr_ms else 0 end) as f from a group by frame_id)
select o_orderkey as frame_id, case when failed is null then coalesce(stage, 'no_ocr_attempts') end as path, case when failed is null then coalesce(score, 0.0) end as score, case when failed is null then failure_reason end as failure_reason, case when failed is null then seat end as seat, case when failed is null then name end as name,
  case when failed is null then n_items end as output_count, case when failed is null then coalesce(m, 0.0) end as mobile_ocr_ms, case when failed is null then coalesce(f, 0.0) end as fallback_ocr_ms, failed as error
from orders left join t on t.frame_id = o_orderkey left join (select * from best where k = 1) b on b.frame_id = o_orderkey left join fail on fail.frame_id = o_orderkey""")
def w1_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recognise(A.union_attempts(attempts_of(spark, sf_dir)), view(spark, sf_dir, "fx_frames"))


_REGIONS = f"""
with r as ({sql("fx_regions")}), f as ({sql("fx_frames")}),
ok as (select r.*, row_number() over (partition by r.frame_id order by area desc, contour_index) as k from r join f using (frame_id)
  where area >= width * height * 0.01 and area / (w * h) >= 0.7 and w / h between 0.5 and 5.0)
select f.frame_id, contour_index, x, y, w, h, area from f left join (select * from ok where k = 1) b on b.frame_id = f.frame_id"""


@_register("a19_select_label_region", _REGIONS)
def a19_select_label_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.select_label_region(view(spark, sf_dir, "fx_regions"), view(spark, sf_dir, "fx_frames"))


@_register("a20_explode_attempts", _ATTEMPTS + f"""
 select frame_id as request_id, row_number() over (partition by frame_id order by stage_index) - 1 as attempt_index, {_STAGE_SQL} as stage, is_complete as accepted, failure_reason as reason, score, cast(20 + (frame_id * 7 + stage_index * 13) % 500 as double) as ocr_ms, {_ERROR_SQL} as error from scored""")
def a20_explode_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct("stage_index", "stage", F.lit("e").alias("engine"), c("is_complete").alias("accepted"), c("failure_reason").alias("parse_reason"), "score", "ocr_ms", "error")
    nested = scored_attempts(spark, sf_dir).groupBy(c("frame_id").alias("request_id")).agg(F.struct(F.array_sort(F.collect_list(entry)).alias("validation_attempts")).alias("label_detection"))
    return A.explode_attempts(nested).drop("engine")


# -- evaluation --------------------------------------------------------------------------------------------------------


def evaluation_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """fx_cases, fx_responses (of stage 0; every 20th is missing, every 33rd failed) and the images that exist."""
    image = F.concat(F.lit("/data/"), c("frame_id").cast("string"), F.lit(".jpg"))
    frames = view(spark, sf_dir, "fx_frames").select("frame_id").where("frame_id % 20 <> 0")
    first = items_of(spark, sf_dir).where("stage_index = 0").select("frame_id", "items")
    responses = frames.join(first, "frame_id", "left").select(image.alias("image"), c("items").alias("results"), F.when(c("frame_id") % 33 == 0, "HTTP 503: busy").alias("error"), (100 + c("frame_id") % 900).cast("double").alias("latency_ms"))
    return view(spark, sf_dir, "fx_cases"), responses, frames.select(image.alias("image"))


_EVALUATED = _PLAIN + f""",
c as (select cast(regexp_extract(image, '([0-9]+)', 1) as bigint) as frame_id, * from ({sql("fx_cases")}) v),
e as (select c.*, case when c.frame_id % 20 = 0 then 'image not found: ' || image when c.frame_id % 33 = 0 then 'HTTP 503: busy' end as error,
  c.frame_id % 20 <> 0 as found, coalesce(s.n_items, 0) as n, s.seat, s.name, coalesce(s.failure_reason, case when s.frame_id is null then 'no_ocr_items' end) as reason, coalesce(s.score, 0.0) as sc2
  from c left join (select * from scored where stage_index = 0) s on s.frame_id = c.frame_id),
m as (select *, expected_name <> '' and lower(expected_name) = lower(coalesce(name, '')) as nm, expected_seat <> '' and expected_seat = coalesce(seat, '') as sm from e),
rec as (select image, expected_name, expected_seat, case when error is null then name end as actual_name, case when error is null then seat end as actual_seat, case when error is null then nm end as name_match,
  case when error is null then sm end as seat_match, error is null and nm and sm as passed, case when error is null then cast(100 + frame_id % 900 as double) end as latency_ms,
  case when error is null then reason end as parse_reason, case when error is null then round(sc2, 4) end as score, case when error is null then n end as ocr_count, error from m)"""


@_register("a15_attach_responses", _EVALUATED + " select image, found, error, case when error is null then n else 0 end as n_items, case when found then cast(100 + frame_id % 900 as double) end as latency_ms from m")
def a15_attach_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.attach_responses(*evaluation_inputs(spark, sf_dir)).select("image", "found", "error", F.size("items").alias("n_items"), "latency_ms")


@_register("a16_compare_expected", f"""
with s as (select line_no, seat, name, case line_no % 4 when 0 then '' when 1 then upper(name) when 2 then ' ' || name || '  ' else 'other' end as expected_name, case line_no % 3 when 0 then '' when 1 then lower(seat) else 'x' end as expected_seat from ({sql("fx_directory")}) v)
select line_no, name as actual_name, seat as actual_seat, line_no % 4 in (1, 2) as name_match, line_no % 3 = 1 as seat_match, line_no % 4 in (1, 2) and line_no % 3 = 1 as passed from s""")
def a16_compare_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, seat, k = c("name"), c("seat"), c("line_no")
    rows = view(spark, sf_dir, "fx_directory").withColumn("expected_name", F.when(k % 4 == 0, "").when(k % 4 == 1, F.upper(name)).when(k % 4 == 2, F.concat(F.lit(" "), name, F.lit("  "))).otherwise("other"))
    rows = rows.withColumn("expected_seat", F.when(k % 3 == 0, "").when(k % 3 == 1, F.lower(seat)).otherwise("x"))
    return E.compare_expected(rows, name, seat).select("line_no", "actual_name", "actual_seat", "name_match", "seat_match", "passed")


@_register("a17_evaluate", _EVALUATED + " select * from rec")
def a17_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evaluate(*evaluation_inputs(spark, sf_dir)).drop("confidence")


@_register("a18_summarize", _EVALUATED + " select count(*) as total, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed, round(count(*) filter (where passed) / count(*), 4) as success_rate, round(avg(latency_ms), 2) as avg_latency_ms, count(*) filter (where passed) < count(*) as gate_failed from rec")
def a18_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.evaluate_cases(*evaluation_inputs(spark, sf_dir))[0]


# -- directory, announcements and sequences ----------------------------------------------------------------------------

_DIRECTORY = f"select lower({_NAME.replace('text', 'name')}) as name_key, max_by(seat, line_no) as seat from ({sql('fx_directory')}) v group by 1"


def directory_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.build_directory(view(spark, sf_dir, "fx_directory"))


@_register("j1_build_directory", _DIRECTORY)
def j1_build_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory_of(spark, sf_dir)


_KNOWN = f"""
with dir as ({_DIRECTORY}), audio as ({sql("fx_audio")}), k as ({sql("fx_scans")}),
known as (select k.*, case when not failed then dir.seat end as resolved_seat, audio.seat is not null and not failed as has_audio
  from k left join dir on dir.name_key = lower(k.lookup_name) left join audio on audio.seat = dir.seat),
own as (select *, case when continuous and has_audio then resolved_seat end as own from known),
mem as (select *, (last_value(case when not failed then struct_pack(s := own) end ignore nulls) over (partition by session_id order by ts rows between unbounded preceding and 1 preceding)).s as memory from own),
sup as (select *, coalesce(not failed and continuous and memory = resolved_seat, false) as suppressed,
  case when failed then 'RetryNeeded' when not complete then 'Scanning' when name_confidence >= 0.8 and seat_confidence >= 0.9 then 'Recognized' else 'RetryNeeded' end as outcome from mem)"""


def known_scans(spark: SparkSession, sf_dir: str, scans: DataFrame | None = None) -> DataFrame:
    rows = view(spark, sf_dir, "fx_scans") if scans is None else scans
    found = D.with_audio(D.resolve_seats(rows, directory_of(spark, sf_dir), exact=False), view(spark, sf_dir, "fx_audio"))
    return found.withColumn("resolved_seat", F.when(~c("failed"), c("resolved_seat"))).withColumn("has_audio", c("has_audio") & ~c("failed"))


@_register("j2_resolve_seats", _KNOWN + " select k.event_id, k.lookup_name, dir.seat as resolved_seat from k left join dir on dir.name_key = lower(k.lookup_name)")
def j2_resolve_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.resolve_seats(view(spark, sf_dir, "fx_scans"), directory_of(spark, sf_dir), exact=False).select("event_id", "lookup_name", "resolved_seat")


@_register("j3_audio_coverage", _KNOWN + " select coalesce(d.seat, a.seat) as seat, d.seat is not null as in_directory, a.seat is not null as has_audio from (select distinct seat from dir) d full join (select distinct seat from audio) a on a.seat = d.seat")
def j3_audio_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.audio_coverage(directory_of(spark, sf_dir), view(spark, sf_dir, "fx_audio"))


_DECISION = """case when failed then 'error' when lookup_name is null then 'skipped' when resolved_seat is null then 'skipped' when suppressed then 'skipped' when has_audio then 'playing' else 'error' end as status,
  case when failed then 'error (OCR request failed before audio lookup)' when lookup_name is null then 'skipped (no parsed name)' when resolved_seat is null then 'skipped (no CSV match for ' || lookup_name || ')'
    when suppressed then 'skipped (already played ' || resolved_seat || '.wav in continuous mode)' when has_audio then 'playing ' || resolved_seat || '.wav' else 'error (Audio playback failed)' end as message,
  case when not failed and lookup_name is not null and (suppressed or has_audio) then '/audio/' || resolved_seat || '.wav' end as source_url"""


@_register("j4_resolve_audio", _KNOWN + f" select event_id, resolved_seat, {_DECISION} from sup")
def j4_resolve_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.resolve_audio(T.suppress_repeats(known_scans(spark, sf_dir))).select("event_id", "resolved_seat", "status", "message", "source_url")


@_register("t1_suppress_repeats", _KNOWN + " select event_id, resolved_seat, suppressed from sup")
def t1_suppress_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.suppress_repeats(known_scans(spark, sf_dir)).select("event_id", "resolved_seat", "suppressed")


@_register("t2_classify_scan", _KNOWN + " select event_id, outcome from sup")
def t2_classify_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.classify_scan(view(spark, sf_dir, "fx_scans")).select("event_id", "outcome")


def _fold_sql(requests: str, order: str) -> str:
    """The transition table folded over each session as a running composition: a recursive CTE, one request a step."""
    return f"""
with recursive q as (select *, row_number() over (partition by session_id order by {order}) as k from ({requests}) v),
f as (
  select session_id, event_id, k, requested, requested in ('Ready', 'Scanning', 'RetryNeeded') as accepted, case when requested in ('Ready', 'Scanning', 'RetryNeeded') then requested else 'Ready' end as state from q where k = 1
  union all
  select q.session_id, q.event_id, q.k, q.requested, ok, case when ok then q.requested else f.state end from f join q on q.session_id = f.session_id and q.k = f.k + 1,
    lateral (select q.requested = f.state or (f.state || '>' || q.requested) in ('Ready>Scanning', 'Ready>RetryNeeded', 'Scanning>Recognized', 'Scanning>RetryNeeded', 'Scanning>Ready', 'Recognized>Scanning', 'Recognized>Ready', 'RetryNeeded>Scanning', 'RetryNeeded>Ready') as ok) x
)"""


@_register("t3_validate_transitions", _fold_sql(sql("fx_requests"), "ts") + " select event_id, requested, accepted, state from f")
def t3_validate_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.validate_transitions(view(spark, sf_dir, "fx_requests")).select("event_id", "requested", "accepted", "state")


#: Three sessions hold all events, in blocks of this many frames; times are whole hours, so that many are equal.
LONG_BLOCK = 1000
_HOURLY = "date_trunc('hour', ts)"


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("session_id", c("session_id") % 3).withColumn("ts", F.date_trunc("hour", "ts"))


_LONG_KNOWN = _KNOWN.replace("partition by session_id order by ts rows", f"partition by session_id % 3 order by {_HOURLY}, event_id rows")


@_register("t1_long_sessions", _LONG_KNOWN + " select event_id, resolved_seat, suppressed from sup")
def t1_long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.suppress_repeats(_long(known_scans(spark, sf_dir)), order=["ts", "event_id"], block_rows=LONG_BLOCK).select("event_id", "resolved_seat", "suppressed")


_LONG_REQUESTS = f"select session_id % 3 as session_id, event_id, {_HOURLY} as ts, requested from ({sql('fx_requests')}) r"


@_register("t3_long_sessions", _fold_sql(_LONG_REQUESTS, "ts, event_id") + " select event_id, requested, accepted, state from f")
def t3_long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.validate_transitions(_long(view(spark, sf_dir, "fx_requests")), order=["ts", "event_id"], block_rows=LONG_BLOCK).select("event_id", "requested", "accepted", "state")


@_register("w3_continuous_scan", _KNOWN + f" select event_id, resolved_seat, outcome, {_DECISION} from sup")
def w3_continuous_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.continuous_scan(view(spark, sf_dir, "fx_scans"), directory_of(spark, sf_dir), view(spark, sf_dir, "fx_audio"), exact=False)
    return out.select("event_id", "resolved_seat", "outcome", "status", "message", "source_url")


@_register("w3_scan_states", _KNOWN + ", f0 as (" + _fold_sql("select session_id, event_id * 2 + o as event_id, ts, o, case o when 0 then 'Scanning' else outcome end as requested from sup, (values (0), (1)) t(o)", "ts, o") + " select * from f) select event_id, requested, accepted, state from f0")
def w3_scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.scan_states(T.classify_scan(view(spark, sf_dir, "fx_scans")))
    return rows.select((c("event_id") * 2 + c("step")).alias("event_id"), "requested", "accepted", "state")


# -- streams: read as a stream with availableNow, into files in the shared folder ---------------------------------------


def run_stream(spark: SparkSession, out: DataFrame) -> DataFrame:
    """Runs a stream over what there is and returns the rows it wrote."""
    folder = shared_folder(spark, "stream")
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """fx_scans or fx_requests over events read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(sql(name).replace("from events", "from {events}"), events=events)


def _plain_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", c("ts").cast("timestamp_ntz"))


#: The queries compare with whole sessions, which no pause ends.
_NO_PAUSE = "36500 days"


def _frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """known_scans as a stream."""
    R.use_state_store(spark)
    return known_scans(spark, sf_dir, stream_of(spark, sf_dir, "fx_scans")).withColumn("ts", c("ts").cast("timestamp"))


def _requests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.use_state_store(spark)
    return stream_of(spark, sf_dir, "fx_requests").withColumn("ts", c("ts").cast("timestamp"))


@_register("r2_stream_resolve", _KNOWN + " select event_id, lookup_name, case when not failed then resolved_seat end as resolved_seat from known")
def r2_stream_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stream(spark, known_scans(spark, sf_dir, stream_of(spark, sf_dir, "fx_scans")).select("event_id", "lookup_name", "resolved_seat"))


@_register("r3_stream_suppress", _KNOWN + " select session_id, ts, resolved_seat, suppressed from sup")
def r3_stream_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_time(run_stream(spark, R.stream_suppress(_frames_of(spark, sf_dir), idle=_NO_PAUSE)))


@_register("r3_stream_ties", _LONG_KNOWN + f" select session_id % 3 as session_id, {_HOURLY} as ts, event_id, resolved_seat, suppressed from sup")
def r3_stream_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_time(run_stream(spark, R.stream_suppress(_long(_frames_of(spark, sf_dir)), idle=_NO_PAUSE, tie="event_id")))


@_register("r4_stream_states", _fold_sql(sql("fx_requests"), "ts") + " select f.session_id, q.ts, f.requested, f.accepted, f.state from f join q using (event_id)")
def r4_stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_time(run_stream(spark, R.stream_states(_requests_of(spark, sf_dir), idle=_NO_PAUSE)))


@_register("r4_stream_ties", _fold_sql(_LONG_REQUESTS, "ts, event_id") + " select f.session_id, q.ts, f.event_id, f.requested, f.accepted, f.state from f join q using (event_id)")
def r4_stream_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_time(run_stream(spark, R.stream_states(_long(_requests_of(spark, sf_dir)), idle=_NO_PAUSE, tie="event_id")))


@_register("r1_stream_parse", _PLAIN + """
 select frame_id, stage_index, case when is_complete then seat end as seat_number, case when not is_complete then 'Scanning' when nc >= 0.8 and sc >= 0.9 then 'Recognized' else 'RetryNeeded' end as outcome from scored""")
def r1_stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "responses")
    key = F.struct(F.concat_ws(":", "frame_id", "stage_index").alias("request_id"))
    items_of(spark, sf_dir).select(c("items").alias("results"), key.alias("debug")).repartition(4).write.json(folder)
    keyed = IO.read_responses(spark, folder, stream=True, files_per_batch=2).withColumn("key", F.split("debug.request_id", ":"))
    keyed = keyed.withColumn("frame_id", F.get("key", F.lit(0)).cast("long")).withColumn("stage_index", F.get("key", F.lit(1)).cast("long")).drop("key")
    return run_stream(spark, R.stream_parse(keyed).select("frame_id", "stage_index", "seat_number", "outcome"))


# -- sources and sinks: files written from the tables into the shared folder, and read back -------------------------------


#: A manifest of the customers, with quotes, commas and letters outside ASCII. Manifests and directories are single files.
_CASES_SQL = "select row_number() over (order by c_custkey) as row_number, '/data/' || cast(c_custkey as string) || '.jpg' as image, 'Gäst \"' || c_name || '\", 陳' as expected_name, cast(c_custkey % 90 as string) as expected_seat from customer"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CASES_SQL.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


@_register("s1_read_json_manifest", _CASES_SQL)
def s1_read_json_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "manifest") + ".json"
    case = F.to_json(F.struct(c("image").alias("image_path"), c("expected_name").alias("holder_name"), c("expected_seat").alias("seat")))
    lines = _cases(spark, sf_dir).select(c("row_number").alias("k"), F.concat(F.when(c("row_number") > 1, ", ").otherwise(""), case).alias("value"))
    ends = spark.createDataFrame([(0, '{"cases": [], "images": ['), (2**62, "]}")], "k long, value string")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return IO.read_manifest(spark, path).select("row_number", "image", "expected_name", "expected_seat")


@_register("s2_read_csv_manifest", _CASES_SQL)
def s2_read_csv_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "manifest") + ".csv"
    rows = _cases(spark, sf_dir).repartition(1).sortWithinPartitions("row_number")
    rows.select(c("image").alias("file"), c("expected_name").alias("name"), c("expected_seat").alias("seat_number")).write.csv(path, header=True, escape='"')
    return IO.read_manifest(spark, path).select("row_number", "image", "expected_name", "expected_seat")


@_register("s3_read_directory", f"select row_number() over (order by line_no) + 1 as line_no, seat, name from ({sql('fx_directory')}) v")
def s3_read_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "directory")
    rows = view(spark, sf_dir, "fx_directory").select(c("line_no").cast("long").alias("k"), F.concat_ws(",", "seat", "name").alias("value"))
    rows.unionByName(spark.createDataFrame([(-1, "Seat No,Name")], "k long, value string")).repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return IO.read_directory(spark, path).select("line_no", "seat", "name")


@_register("s2_read_manifest_files", _CASES_SQL)
def s2_read_manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "manifest") + ".tsv"
    rows = _cases(spark, sf_dir).repartitionByRange(5, "row_number").sortWithinPartitions("row_number")
    rows.select(c("image").alias("file"), c("expected_name").alias("name"), c("expected_seat").alias("seat_number")).write.csv(path, header=True, sep="\t", escape='"')
    return IO.read_manifest(spark, path, multiline=False).select("row_number", "image", "expected_name", "expected_seat")


#: Directory files have a header each, which takes a line number.
@_register("s3_read_directory_files", f"select row_number() over (order by line_no) as place, seat, name from ({sql('fx_directory')}) v")
def s3_read_directory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "directory")
    rows = view(spark, sf_dir, "fx_directory").repartitionByRange(5, "line_no").sortWithinPartitions("line_no")
    rows.select(c("seat").alias("Seat No"), c("name").alias("Name")).write.csv(path, header=True)
    found = SC.number_rows(IO.read_directory(spark, path), ["line_no"], "place", 4)
    return found.select("place", "seat", "name")


def _page_text() -> Column:
    """Stored OCR output of a frame and stage: an object, or for odd frames a list of pages of lines, with a line of one part."""
    box = F.lit("[[1.5, 2]]")
    line = lambda i: F.concat(F.lit("["), box, F.lit(", "), F.regexp_replace(F.to_json(F.array(i["text"])), r"\]$", ""), F.lit(", "), i["confidence"].cast("string"), F.lit("]]"))
    listed = F.concat(F.lit("[[[[]], "), F.array_join(F.transform("items", line), ", "), F.lit("]]"))
    parallel = F.struct(F.transform("items", lambda i: i["box"]).alias("dt_polys"), F.transform("items", lambda i: i["text"]).alias("rec_texts"), F.transform("items", lambda i: i["confidence"]).alias("rec_scores"))
    return F.when(c("frame_id") % 2 == 1, listed).otherwise(F.to_json(parallel))


@_register("s5_read_pages", f"""
with v as ({sql("fx_items")}), n as (select frame_id, stage_index, row_number() over (order by frame_id, stage_index) as document from (select distinct frame_id, stage_index from v) d)
select document, row_number() over (partition by document order by item_index) - 1 as pos, {_RAW} as text, confidence, case when frame_id % 2 = 1 then 1.5::double end as x
from v join n using (frame_id, stage_index) where {_RAW} <> ''""")
def s5_read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "pages")
    items_of(spark, sf_dir).repartitionByRange(6, "frame_id", "stage_index").sortWithinPartitions("frame_id", "stage_index").select(_page_text().alias("value")).write.text(path)
    found = I.pages_to_items(IO.read_pages(spark, path, lines=True)).select(c("row_number").alias("document"), F.posexplode("items").alias("pos", "i"))
    return found.select("document", "pos", "i.text", "i.confidence", F.get(F.get("i.box", F.lit(0)), F.lit(0)).alias("x"))


@_register("s6_read_diagnostics", "select c_custkey + 1 as attempt_no, 'r' || cast(c_custkey as string) as request_id, '2024-05-06T07:08:09Z' as timestamp_utc, case when c_custkey % 5 = 0 then 'engine failed' end as error, 3 as n_artifacts from customer")
def s6_read_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, k = shared_folder(spark, "attempts"), c("c_custkey")
    artifacts = F.map_from_arrays(F.array(*map(F.lit, "abc")), F.array(*[F.struct(F.lit(f"{x}.png").alias("filename")) for x in "abc"]))
    record = F.struct(F.concat(F.lit("r"), k.cast("string")).alias("request_id"), F.lit("2024-05-06T07:08:09Z").alias("timestamp_utc"), artifacts.alias("artifacts"), F.when(k % 5 == 0, "engine failed").alias("error"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(X.attempt_label(k + 1), F.lit("/diag.json")).alias("name"), F.to_json(record).alias("content"))
    FILES.write_named(rows.repartition(8), root)
    OUT.compact_diagnostics(spark, root, root + "-compact", bin_bytes=1 << 16)
    return IO.read_compacted(spark, root + "-compact").select(c("attempt_no").cast("long").alias("attempt_no"), "request_id", "timestamp_utc", "error", F.size("artifacts").alias("n_artifacts"))


def _listed(spark: SparkSession, sf_dir: str, name: Column) -> str:
    """A folder of files, one a seat, with c_custkey % 3 bytes (of the largest key)."""
    root = shared_folder(spark, "files")
    seats = spark.sql(_SEATS_SQL.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    FILES.write_named(seats.select(name.alias("name"), F.substring(F.lit("xx"), 1, c("length").cast("int")).alias("content")).repartition(8), root)
    return root


_SEATS_SQL = f"select {seat('c_custkey')} as seat, max(c_custkey) % 3 as length from customer group by 1"


@_register("s7_list_audio", f"select * from ({_SEATS_SQL}) s where length < 2")
def s7_list_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.list_audio(spark, _listed(spark, sf_dir, F.concat(F.substring("seat", 1, 1), F.lit("/"), c("seat"), F.when(c("length") == 2, ".txt").otherwise(".wav")))).select("seat", "length")


@_register("s8_list_images", f"select substr(seat, 1, 1) || '/' || seat || case length when 0 then '.JPG' when 1 then '' else '.tif' end as image, length from ({_SEATS_SQL}) s")
def s8_list_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _listed(spark, sf_dir, F.concat(F.substring("seat", 1, 1), F.lit("/"), c("seat"), F.when(c("length") == 0, ".JPG").when(c("length") == 1, "").otherwise(".tif")))
    return IO.list_images(spark, root).select(F.regexp_extract("image", r"([^/]+/[^/]+)$", 1).alias("image"), "length")


@_register("s4_read_responses", f"select frame_id, count(*) as n_items, case when frame_id % 33 = 0 then 'HTTP 503: busy' end as error from ({sql('fx_items')}) v where stage_index = 0 group by frame_id")
def s4_read_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "responses")
    rows = items_of(spark, sf_dir).where("stage_index = 0").select(c("items").alias("results"), F.when(c("frame_id") % 33 == 0, "HTTP 503: busy").alias("error"), F.struct(c("frame_id").cast("string").alias("request_id")).alias("debug"))
    rows.write.json(path)
    found = IO.read_responses(spark, path)
    return found.select(c("debug.request_id").cast("long").alias("frame_id"), F.size(F.from_json("results", "array<struct<text:string>>")).alias("n_items"), "error")


@_register("s9_write_report", _EVALUATED + " select image, passed, error from rec")
def s9_write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "report")
    summary, records = P.evaluate_cases(*evaluation_inputs(spark, sf_dir))
    OUT.write_report(summary, records, path)
    return spark.read.schema("image string, passed boolean, error string").json(f"{path}/records")


def _diagnostics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.union_attempts(attempts_of(spark, sf_dir))
    number = (c("frame_id") * 3 + c("stage_index")).cast("string")
    at = F.regexp_replace(X.utc_timestamp(c("frame_id") * 86413), "-[0-9]{2}T.*$", "-01T00:00:00Z")  # a folder a month
    return rows.select(number.alias("request_id"), at.alias("timestamp_utc"), F.struct(F.size("items").alias("output_count")).alias("ocr"), "error")


def _written_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    found = IO.read_written(spark, path, "request_id string, ocr struct<output_count:int>, error string")
    return found.select(c("request_id").cast("long").alias("request_id"), F.regexp_replace("date", "-[0-9]{2}$", "").alias("month"), c("ocr.output_count").alias("n_items"), "error")


@_register("s10_write_diagnostics", _ATTEMPTS + f" select frame_id * 3 + stage_index as request_id, strftime(timestamp '1970-01-01' + to_seconds(frame_id * 86413), '%Y-%m') as month, n_items, {_ERROR_SQL} as error from scored")
def s10_write_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "diagnostics")
    OUT.write_diagnostics(_diagnostics_of(spark, sf_dir), path)
    return _written_diagnostics(spark, path)


@_register("s10_stream_diagnostics", ORACLES["s10_write_diagnostics"])
def s10_stream_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "diagnostics")
    rows = _diagnostics_of(spark, sf_dir)
    rows.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    OUT.write_diagnostics(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return _written_diagnostics(spark, f"{folder}/out")
