"""Golden cases of frame scoring, one test per rule that is easy to get wrong, and random frames against a plain fold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gatescan.functions import text as X
from gatescan.operators import attempts as A
from gatescan.operators import scoring as S
from gatescan.operators.evaluation import compare_expected
from gatescan.schemas import RAW_ITEM

SCHEMA = f"id int, items array<{RAW_ITEM}>"


def frames(spark, *lists):
    rows = [(k, None if x is None else [([], t, None if c is None else str(c)) for t, c in x]) for k, x in enumerate(lists)]
    return spark.createDataFrame(rows, SCHEMA)


def score(spark, *lists):
    got = S.score_ocr_items(frames(spark, *lists)).orderBy("id").select("scored.*").collect()
    return got if len(lists) > 1 else got[0]


@pytest.mark.parametrize("name", ["陳大文", "Jane Chan"])
def test_name_and_seat_are_complete(spark, name):
    s = score(spark, [(name, 0.91), ("10AC13", 0.95)])
    assert s.is_complete and s.failure_reason is None
    assert (s.selected_name.text, s.selected_seat.text) == (name, "10AC13")


def test_seat_only(spark):
    s = score(spark, [("10AC13", 0.99)])
    assert not s.is_complete and s.failure_reason == "name_candidates_only_on_seat_line"


def test_random_text(spark):
    s = score(spark, [("Welcome", 0.99)])
    assert s.failure_reason == "no_seat_candidate" and s.selected_seat is None and s.selected_name.text == "Welcome"


def test_confidence_breaks_ties_and_validity_comes_first(spark):
    low, high, name, seat = score(spark, [("Jane Chan", 0.55), ("10AC13", 0.58)], [("Jane Chan", 0.92), ("10AC13", 0.95)], [("Jane Chan", 0.99)], [("10AC13", 0.1)])
    assert high.score > low.score and seat.score > name.score


def test_normalised_comparison(spark):
    df = S.score_ocr_items(frames(spark, [("Jane   Chan", 0.91), ("Seat: 10 ac 13", 0.95)])).withColumn("expected_name", F.lit("jane chan")).withColumn("expected_seat", F.lit("10AC13"))
    r = compare_expected(df, F.col("scored.selected_name.text"), F.col("scored.selected_seat.text")).first()
    assert r.passed and r.actual_name == "Jane Chan"


def test_empty_expected_never_matches(spark):
    df = spark.createDataFrame([("", "")], "expected_name string, expected_seat string")
    r = compare_expected(df, F.lit(None).cast("string"), F.lit(None).cast("string")).first()
    assert not r.name_match and not r.seat_match


def test_blank_lists_null_lists_and_shifted_positions(spark):
    blank, none, empty, shifted = score(spark, [("  ", 0.5), (None, 0.5)], None, [], [("", 0.5), ("10AC13", 0.9)])
    assert blank.failure_reason == "no_seat_candidate"
    assert none.failure_reason == empty.failure_reason == "no_ocr_items"
    assert shifted.selected_seat["index"] == 1


def test_second_seat_line_becomes_the_name(spark):
    s = score(spark, [("10AC13", 0.9), ("11BD14", 0.8)])
    assert s.is_complete and s.selected_seat.text == "10AC13" and s.selected_name.text == "11BD14"


def test_ties_keep_the_order_of_lines(spark):
    s = score(spark, [("Ann", 0.5), ("Bob", 0.5), ("10AC13", 0.5), ("11AC13", 0.5)])
    assert (s.selected_name.text, s.selected_seat.text) == ("Ann", "10AC13")


@pytest.mark.parametrize(("given", "value"), [("0.9", 0.9), ("abc", 0.0), (None, 0.0), ("NaN", 0.0), ("5d", 0.0), ("1_0", 10.0), (" .5 ", 0.5), ("1e-1", 0.1), ("", 0.0), ("inf", float("inf"))])
def test_confidences(spark, given, value):
    assert spark.createDataFrame([(given,)], "c string").select(X.item_confidence(F.col("c"))).first()[0] == value


@pytest.mark.parametrize(("given", "name", "code"), [("ß10ac13", None, "SS10AC13"), ("ﬁ", None, "FI"), ("　Jane  Chan　", "Jane Chan", "JANECHAN")])
def test_unicode_rules(spark, given, name, code):
    r = spark.createDataFrame([(given,)], "t string").select(X.normalize_name(F.col("t")), X.sanitize_seat(F.col("t"))).first()
    assert r[1] == code and (name is None or r[0] == name)


def test_label_words_and_excluded_words_fold_case(spark):
    texts = ["ſeat row", "SEAT", "ſample", "Graduate", "sampler", "a", "12", "名前", "座位 A"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(X.looks_like_name(F.col("t"))).collect()] == [False, False, False, False, True, False, False, True, False]


def test_case_folding_and_compatibility_forms(spark):
    r = spark.createDataFrame([("Straße  Ⅷ",)], "t string").select(X.expected_name_key(F.col("t")), X.lookup_key(F.col("t"))).first()
    assert r[0] == "strasse ⅷ" and r[1] == "straße viii"


def fold(items):
    """The rules as a plain loop."""
    seats, names = [], []
    for k, (text, conf) in enumerate(items):
        raw = (text or "").strip()
        if not raw:
            continue
        code = re.search("[0-9]{2}[A-Z]{2}[0-9]{2}", re.sub("[^A-Z0-9]", "", raw.upper()))
        if code:
            seats.append((-conf, k, code[0]))
        name = " ".join(raw.split())
        if len(name) >= 2 and re.search("[A-Za-z一-鿿]", name) and not re.search("seat|座位|姓名|name", name, re.I) and name.casefold() not in ("sample", "graduate"):
            names.append((-conf, k, name))
    seat = min(seats, default=None)
    name = min((n for n in names if not seat or n[1] != seat[1]), default=None)
    both = [-x[0] for x in (seat, name) if x]
    combined = min(both) if len(both) == 2 else max(both, default=0.0)
    return seat and seat[2], name and name[2], 200.0 * bool(seat) + 100.0 * bool(name) + combined


def test_random_frames_nested_and_exploded(spark):
    rng = random.Random(5)
    words = ["10AC13", "Seat 11 bd 14", "Jane  Chan", "Sample", " ", "陳大文", "name: x", "22ZZ99 hall", "a", "Bob"]
    lists = [[(rng.choice(words), rng.randrange(5) / 4) for _ in range(rng.randrange(6))] for _ in range(300)]
    want = {k: fold(x) for k, x in enumerate(lists)}
    nested = {k: (s.selected_seat and s.selected_seat.text, s.selected_name and s.selected_name.text, s.score) for k, s in enumerate(score(spark, *lists))}
    assert nested == want
    flat = spark.createDataFrame([(k, i, t, c) for k, x in enumerate(lists) for i, (t, c) in enumerate(x)], "id int, item_index int, text string, confidence double")
    got = {r.id: (r.selected_seat and r.selected_seat.text, r.selected_name and r.selected_name.text, r.score) for r in S.score_exploded(flat, ["id"]).collect()}
    assert got == {k: v for k, v in want.items() if lists[k]}


def test_browser_reading_keeps_inner_space(spark):
    r = S.parse_result(frames(spark, [(" Jane   Chan ", 0.9), ("10AC13", 0.8)], [("Jane", 0.9)])).orderBy("id").select("parsed.*").collect()
    assert (r[0].holder_name, r[0].combined) == ("Jane   Chan", 0.8)
    assert r[1].holder_name is None and r[1].partial_name == "Jane"


def test_regexes_run_once_per_item(spark):
    df = S.score_ocr_items(frames(spark, [("Jane", 0.9)]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_a_failed_fallback_fails_the_frame(spark):
    """Frame 1: its fallback fails. Frame 2: complete, so its failed fallback never runs. Frame 3: only a primary pass fails."""
    rows = [(1, 0, "p0", 200.5, False, 5.0, None), (1, 2, "fb", 0.0, False, 7.0, "engine died"), (2, 0, "p0", 301.0, True, 5.0, None), (2, 2, "fb", 0.0, False, 7.0, "engine died"), (3, 0, "p0", 0.0, False, 5.0, "bad"), (3, 2, "fb", 100.0, False, 7.0, None)]
    attempts = spark.createDataFrame(rows, "frame_id int, stage_index int, stage string, score double, is_complete boolean, ocr_ms double, error string").withColumn("output_count", F.lit(4))
    frames = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "frame_id int")
    want = {1: (None, None, "engine died"), 2: ("p0", 301.0, None), 3: ("fb", 100.0, None), 4: ("no_ocr_attempts", 0.0, None)}
    fused = A.fused_best(attempts, frames, 2, ["output_count"])
    assert {r.frame_id: (r.path, r.score, r.error) for r in fused.collect()} == want
    gated = A.apply_fallback(attempts.where("stage_index < 2"), attempts.where("stage_index = 2"), frames)
    assert {r.frame_id: (r.path, r.score or (0.0 if r.frame_id == 4 else None), r.error) for r in A.select_best_attempt(gated, frames).collect()} == want
    assert {r.frame_id: (r.path, r.selected_score, r.error) for r in A.profile_frames(gated, frames, 2).collect()} == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_of_late_years_and_in_the_gap_of_a_zone(spark, zone):
    want = {253402300799.9: "9999-12-31T23:59:59Z", 253402300800.0: "10000-01-01T00:00:00Z", 777720000000.7: "26614-12-19T21:20:00Z", 9.2e12: "293506-05-25T11:33:20Z", 1710037800.0: "2024-03-10T02:30:00Z", -0.5: "1969-12-31T23:59:59Z"}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(k,) for k in want], "k double").select("k", X.utc_timestamp(F.col("k")).alias("at"))
        assert {r.k: r["at"] for r in rows.collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
