"""Test views over the driver's tables: one SQL text per view, the same for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "events", "lineitem", "orders")


def seat(k: str) -> str:
    """SQL of a seat code made from an integer."""
    return f"(lpad(cast(10 + {k} % 90 as string), 2, '0') || chr(cast(65 + {k} % 26 as int)) || chr(cast(65 + ({k} * 7) % 26 as int)) || lpad(cast({k} % 100 as string), 2, '0'))"


_P = seat("l_partkey")
VIEWS = {
    "fx_items": f"""
select l_orderkey as frame_id, l_suppkey % 3 as stage_index,
  row_number() over (partition by l_orderkey, l_suppkey % 3 order by l_linenumber, l_partkey, l_suppkey) - 1 as item_index,
  case (l_partkey * 7 + l_linenumber) % 8
    when 0 then {_P}
    when 1 then 'Seat: ' || substr({_P}, 1, 2) || ' ' || lower(substr({_P}, 3, 2)) || ' ' || substr({_P}, 5, 2)
    when 2 then ' Guest   ' || cast(l_partkey % 200 as string)
    when 3 then '姓名' when 4 then 'Sample' when 5 then '   '
    when 6 then 'VIP ' || {_P} || ' hall'
    else '陳大文' end as text,
  cast((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 100 as double) / 100 as confidence
from lineitem""",
    "fx_text": """
select l_orderkey as frame_id, l_suppkey % 3 as stage_index, l_linenumber as line_no, l_partkey as k,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n,
  case l_partkey % 6 when 0 then null when 1 then '' when 2 then 'abc' when 3 then '1.7' when 4 then '-0.2' else '0.35' end as setting,
  case l_partkey % 6 when 0 then null when 1 then ' 0.5 ' when 2 then 'n/a' when 3 then '.25' when 4 then '1e-1' else '0.93' end as conf_text
from lineitem""",
    "fx_frames": "select o_orderkey as frame_id, 640 + o_custkey % 2000 as width, 480 + o_orderkey % 1500 as height from orders",
    "fx_directory": f"select c_custkey + 1 as line_no, {seat('c_custkey')} as seat, 'guest ' || cast(c_custkey % 100 as string) as name from customer",
    "fx_audio": f"""
select distinct seat from (select c_custkey + 1 as line_no, {seat('c_custkey')} as seat from customer) d where line_no % 5 <> 0
union all select '99ZZ99' as seat""",
    "fx_scans": """
select user_id as session_id, event_id, ts, event_type <> 'signup' as continuous, event_type = 'error' as failed,
  case when event_id % 11 = 0 then null else 'Guest ' || cast(cast(floor(value / 100) as int) as string) end as lookup_name,
  event_id % 7 <> 0 as complete, cast(60 + (event_id * 13) % 40 as double) / 100 as name_confidence,
  cast(80 + (event_id * 29) % 20 as double) / 100 as seat_confidence
from events""",
    "fx_requests": """
select user_id as session_id, event_id, ts, case event_type when 'click' then 'Ready' when 'view' then 'Scanning'
  when 'purchase' then 'Recognized' else 'RetryNeeded' end as requested from events""",
    "fx_regions": """
select l_orderkey as frame_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as contour_index,
  l_partkey % 300 as x, l_suppkey % 200 as y, 20 + (l_partkey * 3) % 400 as w, 20 + (l_suppkey * 5) % 300 as h,
  cast((20 + (l_partkey * 3) % 400) * (20 + (l_suppkey * 5) % 300) * (50 + l_linenumber * 7) as double) / 100.0 as area
from lineitem""",
    "fx_cases": f"""
select '/data/' || cast(o_orderkey as string) || '.jpg' as image, coalesce(s.expected_name, '') as expected_name, coalesce(s.expected_seat, '') as expected_seat
from orders left join (
  select l_orderkey, min(case when (l_partkey * 7 + l_linenumber) % 8 in (0, 1, 6) then l_partkey end) as k,
    {seat('min(case when (l_partkey * 7 + l_linenumber) % 8 in (0, 1, 6) then l_partkey end)')} as expected_seat,
    'guest ' || cast(min(case when (l_partkey * 7 + l_linenumber) % 8 = 2 then l_partkey % 200 end) as string) as expected_name
  from lineitem group by l_orderkey) s on s.l_orderkey = o_orderkey""",
}


def sql(name: str) -> str:
    """A view's text for DuckDB."""
    return VIEWS[name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])}
    text = VIEWS[name]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)
