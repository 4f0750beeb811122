"""Readers and writers on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from gatescan.operators import attempts as A
from gatescan.operators import directory as D
from gatescan.operators import evaluation as E
from gatescan.operators import items as I
from gatescan.operators.prefilter import bloom_filter, might_contain
from gatescan.plans.workflows import evaluate_cases
from gatescan.sources import readers as R
from gatescan.sources import writers as W


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def cases(df):
    return [(r.image, r.expected_name, r.expected_seat) for r in df.orderBy("row_number").collect()]


@pytest.mark.parametrize("body", ['[{"image": "a.jpg", "name": "N", "seat": "S"}]', '{"cases": [{"path": "a.jpg", "holder_name": "N", "seat_number": "S"}]}', '{"cases": [], "images": [{"file": "a.jpg", "expected_name": "N", "expected_seat": "S"}]}'])
def test_json_manifests(spark, tmp_path, body):
    p = write(tmp_path / "m.json", body)
    assert cases(R.read_manifest(spark, p)) == [(f"{tmp_path}/a.jpg", "N", "S")]


def test_json_manifest_rules(spark, tmp_path):
    assert cases(R.read_manifest(spark, write(tmp_path / "e.json", '{"records": []}'))) == []
    p = write(tmp_path / "n.json", '[{"image": null, "path": "/x.jpg", "name": null}]')
    assert cases(R.read_manifest(spark, p)) == [("/x.jpg", "", "")]
    for body in ('{"other": []}', '{"cases": 5}'):
        with pytest.raises(Exception, match="must be a list"):
            R.read_manifest(spark, write(tmp_path / "bad.json", body)).collect()
    with pytest.raises(Exception, match="Manifest row 2 is missing"):
        R.read_manifest(spark, write(tmp_path / "no.json", '[{"image": "a"}, {"name": "b"}]')).collect()
    with pytest.raises(ValueError, match=r"\.json, \.csv, or \.tsv"):
        R.read_manifest(spark, "m.txt")


def test_delimited_manifests(spark, tmp_path):
    p = write(tmp_path / "m.CSV", '﻿image,name,seat\n"a ""b"", c.jpg",Jane,10AC13\n/abs.jpg,,\n')
    assert cases(R.read_manifest(spark, p)) == [(f'{tmp_path}/a "b", c.jpg', "Jane", "10AC13"), ("/abs.jpg", "", "")]
    p = write(tmp_path / "m.tsv", "image\texpected_name\nx.jpg\tA, B\n")
    assert cases(R.read_manifest(spark, p)) == [(f"{tmp_path}/x.jpg", "A, B", "")]


def test_directory(spark, tmp_path):
    p = write(tmp_path / "names.csv", '﻿Seat No,Name\r\n10AC13,"Jane", Chan\r\n\r\n,x\nnocomma\n11BD14,\n12CE15, Ann \n13DF16,ann\n')
    rows = R.read_directory(spark, p)
    assert [(r.seat, r.name) for r in rows.orderBy("line_no").collect()] == [("10AC13", '"Jane", Chan'), ("12CE15", "Ann"), ("13DF16", "ann")]
    assert {r.name_key: r.seat for r in D.build_directory(rows).collect()} == {'"jane", chan': "10AC13", "ann": "13DF16"}


@pytest.mark.parametrize(("text", "message"), [("", "is empty"), ("\n \n", "is empty"), ("Seat,Name\na,b", "Unexpected names.csv header: Seat,Name")])
def test_bad_directories(spark, tmp_path, text, message):
    with pytest.raises(Exception, match=message):
        R.read_directory(spark, write(tmp_path / "names.csv", text)).collect()


def test_pages_of_both_shapes(spark, tmp_path):
    write(tmp_path / "d.json", json.dumps([{"dt_polys": [[[1, 2], [3]], []], "rec_texts": [" A ", " ", "C", "D"], "rec_scores": [0.5, 0.6, 0.7]}]))
    write(tmp_path / "l.json", json.dumps([[[[[0, 1], [2, 3]], ["x", 0.25]], [[]], [None, ["", 1.0]]]]))
    df = I.pages_to_items(R.read_pages(spark, str(tmp_path)), inv_scale=F.lit(2.0), dx=F.lit(10.0), dy=F.lit(0.0))
    got = {r.source[-6:]: [(i.box, i.text, i.confidence) for i in r["items"]] for r in df.collect()}
    assert got == {"d.json": [([[12.0, 4.0]], "A", 0.5), ([], "C", 0.7)], "l.json": [([[10.0, 2.0], [14.0, 6.0]], "x", 0.25)]}


def test_evaluation_end_to_end(spark, tmp_path):
    manifest = write(tmp_path / "m.json", json.dumps([{"image": "a.jpg", "name": "jane chan", "seat": "10AC13"}, {"image": "b.jpg"}, {"image": "a.jpg", "name": "x", "seat": "y"}, {"image": "c.jpg", "name": "q"}, {"image": "d.jpg"}]))
    for n in "acd":
        write(tmp_path / f"{n}.jpg", "x")
    items = [{"box": [], "text": "Jane  Chan", "confidence": 0.9}, {"text": "10ac13", "confidence": "0.8"}]
    (tmp_path / "r").mkdir()
    write(tmp_path / "r/a.json", json.dumps({"results": items, "profiling": {"path": "p", "total_ms": 5}}))
    write(tmp_path / "r/c.json", json.dumps({"results": {"no": "list"}}))
    write(tmp_path / "r/d.json", json.dumps({"results": None, "error": "HTTP 500: x"}))
    responses = R.read_responses(spark, str(tmp_path / "r")).select(F.concat(F.lit(f"{tmp_path}/"), F.regexp_extract("source", "([a-z])\\.json", 1), F.lit(".jpg")).alias("image"), "results", "error", F.lit(12.345).alias("latency_ms"), F.col("profiling.path").alias("backend_path"))
    summary, records = evaluate_cases(R.read_manifest(spark, manifest), responses, R.list_images(spark, str(tmp_path)))
    by = [(r.image[-5:], r.passed, r.parse_reason, r.error and r.error[:15], r.backend_path) for r in records.orderBy("row_number").collect()]
    assert by == [("a.jpg", True, None, None, "p"), ("b.jpg", False, None, "image not found", None), ("a.jpg", False, None, None, "p"), ("c.jpg", False, "no_ocr_items", None, None), ("d.jpg", False, None, "HTTP 500: x", None)]
    s = summary.first()
    assert (s.total, s.passed, s.failed, s.success_rate, s.gate_failed) == (5, 1, 4, 0.2, True)
    W.write_report(summary, records, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/records")).count() == 5 and spark.read.json(str(tmp_path / "report/summary")).first().total == 5
    nothing = E.summarize(records.where("false")).first()
    assert (nothing.total, nothing.success_rate, nothing.avg_latency_ms, nothing.gate_failed) == (0, 0.0, None, False)


def test_diagnostics_and_listings(spark, tmp_path):
    for k in (1, 12):
        (tmp_path / f"try_{k:04d}").mkdir()
        attempts = [{"stage": "a", "accepted": False, "parse_reason": "no_ocr_items", "score": 0.0, "ocr_ms": 1.5}, {"stage": "b", "accepted": True, "score": 300.9}]
        write(tmp_path / f"try_{k:04d}/diag.json", json.dumps({"request_id": str(k), "timestamp_utc": "2024-05-06T07:08:09Z", "label_detection": {"validation_attempts": attempts if k == 1 else []}, "artifacts": {"m": {"filename": "f", "enabled": True}}}, indent=1))
    diag = R.read_diagnostics(spark, str(tmp_path))
    assert sorted(r.attempt_no for r in diag.collect()) == [1, 12] and str(diag.first().timestamp) == "2024-05-06 07:08:09"
    got = [(r.request_id, r.attempt_index, r.stage, r.accepted) for r in A.explode_attempts(diag).orderBy("request_id", "attempt_index").collect()]
    assert got == [("1", 0, "a", False), ("1", 1, "b", True), ("12", None, None, None)]
    W.write_diagnostics(diag.drop("attempt_no", "timestamp"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("date = '2024-05-06'").count() == 2
    (tmp_path / "audio/x").mkdir(parents=True)
    for n in ("10AC13.wav", "x/11BD14.wav", "x/readme.txt"):
        write(tmp_path / "audio" / n, "w")
    audio = R.list_audio(spark, str(tmp_path / "audio"))
    assert sorted(r.seat for r in audio.collect()) == ["10AC13", "11BD14"]


def test_announcements(spark):
    rows = [(1, False, None, None, False, False), (2, False, "A", None, False, False), (3, False, "A", "1 X", True, True), (4, False, "A", "S", True, False), (5, False, "A", "S", False, False), (6, True, None, None, False, False)]
    df = spark.createDataFrame(rows, "id int, failed boolean, lookup_name string, resolved_seat string, has_audio boolean, suppressed boolean")
    got = [(r.status, r.message, r.source_url) for r in D.resolve_audio(df).orderBy("id").collect()]
    assert got == [
        ("skipped", "skipped (no parsed name)", None), ("skipped", "skipped (no CSV match for A)", None), ("skipped", "skipped (already played 1 X.wav in continuous mode)", "/audio/1%20X.wav"),
        ("playing", "playing S.wav", "/audio/S.wav"), ("error", "error (Audio playback failed)", None), ("error", "error (OCR request failed before audio lookup)", None),
    ]
    assert D.resolve_audio(df, directory_available=False).where("id = 3").first().message == "error (Unable to load names.csv)"


def test_frames_without_attempts_and_failed_fallback(spark):
    frames = spark.createDataFrame([(1,), (2,), (3,)], "frame_id long")
    rows = [(1, 0, "p0", True, 301.0, 1.0, 2), (1, 2, "f", True, 302.0, 5.0, 2), (2, 0, "p0", False, 100.0, 1.0, 1), (2, 1, "p1", False, 100.0, 1.0, 1), (2, 2, "f", False, 50.0, 5.0, 1)]
    attempts = spark.createDataFrame(rows, "frame_id long, stage_index int, stage string, is_complete boolean, score double, ocr_ms double, output_count int")
    gated = A.apply_fallback(attempts.where("stage_index < 2"), attempts.where("stage_index = 2"), frames)
    best = {r.frame_id: (r.path, r.score) for r in A.select_best_attempt(gated, frames).collect()}
    assert best == {1: ("p0", 301.0), 2: ("p0", 100.0), 3: ("no_ocr_attempts", None)}
    fused = {r.frame_id: (r.path, r.fallback_ocr_ms) for r in A.fused_best(attempts, frames, 2, ["output_count"]).collect()}
    assert fused == {1: ("p0", 0.0), 2: ("p0", 5.0), 3: ("no_ocr_attempts", 0.0)}


def test_lines_and_single_documents(spark, tmp_path):
    write(tmp_path / "three.json", "".join(json.dumps({"error": str(k)}) + "\n" for k in range(3)))
    assert sorted(r.error for r in R.read_responses(spark, str(tmp_path / "three.json")).collect()) == ["0", "1", "2"]
    write(tmp_path / "one.json", json.dumps({"error": "x", "results": [1]}, indent=2))
    assert [r.error for r in R.read_responses(spark, str(tmp_path / "one.json"), lines=False).collect()] == ["x"]


def test_any_file_counts_as_an_image(spark, tmp_path):
    for n in ("A.JPG", "b.tif", "c.jpg"):
        write(tmp_path / n, "x")
    found = R.list_images(spark, str(tmp_path))
    assert sorted(r.image for r in found.collect()) == [f"{tmp_path}/{n}" for n in ("A.JPG", "b.tif", "c.jpg")]
    cases = spark.createDataFrame([(f"file:{tmp_path}/A.JPG",), (f"hdfs://host{tmp_path}/b.tif",), ("/no.jpg",)], "image string")
    responses = spark.createDataFrame([], "image string, results string, latency_ms double, error string")
    got = {r.image[-5:]: r.found for r in E.attach_responses(cases, responses, found).collect()}
    assert got == {"A.JPG": True, "b.tif": True, "o.jpg": False}


# -- listings, several and split files, compaction, sinks that write once ---------------------------------------------------


def test_empty_and_hidden_files_are_listed(spark, tmp_path):
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "none").mkdir()
    for name, text in (("x.jpg", ""), ("a/y.png", "12"), ("a/b/c/z", "123"), ("a/.hid", "1"), ("a/_u.wav", ""), ("a/b/10AC13.wav", "")):
        write(tmp_path / name, text)
    got = sorted((r.image.removeprefix(f"{tmp_path}/"), r.length) for r in R.list_images(spark, str(tmp_path)).collect())
    assert got == [("a/.hid", 1), ("a/_u.wav", 0), ("a/b/10AC13.wav", 0), ("a/b/c/z", 3), ("a/y.png", 2), ("x.jpg", 0)]
    assert sorted(r.seat for r in R.list_audio(spark, f"file://{tmp_path}").collect()) == ["10AC13", "_u"]
    assert R.list_images(spark, f"{tmp_path}/none").count() == 0 and R.list_images(spark, f"{tmp_path}/missing").count() == 0
    cases = spark.createDataFrame([(f"{tmp_path}/x.jpg",)], "image string")
    responses = spark.createDataFrame([(f"{tmp_path}/x.jpg", "[]", 1.0, None)], "image string, results string, latency_ms double, error string")
    assert E.attach_responses(cases, responses, R.list_images(spark, str(tmp_path))).first().found


def test_directory_of_several_files(spark, tmp_path):
    write(tmp_path / "a.csv", "Seat No,Name\n1A,Ann\n2B,Bob\n")
    write(tmp_path / "b.csv", "\n\ufeffSeat No,Chinese Name\n\n3C,ann\n")
    rows = R.read_directory(spark, str(tmp_path))
    assert [(r.line_no, r.seat, r.name) for r in rows.orderBy("line_no").collect()] == [(2, "1A", "Ann"), (3, "2B", "Bob"), (5, "3C", "ann")]
    assert {r.name_key: r.seat for r in D.build_directory(rows).collect()} == {"ann": "3C", "bob": "2B"}
    write(tmp_path / "c.csv", "4D,Dan\n")
    with pytest.raises(Exception, match="Unexpected names.csv header: 4D,Dan"):
        R.read_directory(spark, str(tmp_path)).collect()


def test_numbers_over_splits_and_files(spark, tmp_path):
    want, k = [], 0
    for name in ("m1", "m2", "m3"):
        lines = [f"/i{k + n}.jpg,N{'x' * (n % 50)},S" for n in range(700)]
        k += 700
        want += [x.split(",")[0] for x in lines]
        (tmp_path / "m.csv").mkdir(exist_ok=True)
        write(tmp_path / f"m.csv/{name}.csv", "image,name,seat\n" + "\n".join(lines) + "\n")
    write(tmp_path / "names.csv", "Seat No,Name\n" + "".join(f"S{n},name {n}\n\n" for n in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = R.read_manifest(spark, str(tmp_path / "m.csv"), multiline=False)
        assert got.rdd.getNumPartitions() > 5
        rows = R.read_directory(spark, str(tmp_path / "names.csv")).orderBy("line_no").collect()
        assert [(r.row_number, r.image) for r in got.orderBy("row_number").collect()] == [(n + 1, x) for n, x in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.line_no, r.seat) for r in rows] == [(n + 2, f"S{n}") for n in range(2000)]
    whole = R.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("row_number").collect()
    assert [(r.row_number, r.image) for r in whole] == [(n + 1, x) for n, x in enumerate(want)]


def test_pages_that_are_no_pages(spark, tmp_path):
    texts = ["", "no json", "null", "5", '{"rec_texts": 5, "rec_scores": [1]}', '{"rec_texts": ["a", null, 7, "b"], "rec_scores": ["0.5", 1, 2]}', '[{"rec_texts": ["p"], "rec_scores": [1]}, [[[[1, 2]], ["q", "0.5"]], [null, [8]]]]']
    write(tmp_path / "pages.txt", "\n".join(texts))
    df = I.pages_to_items(R.read_pages(spark, str(tmp_path), lines=True)).orderBy("row_number")
    assert [[(i.text, i.confidence) for i in r["items"]] for r in df.collect()] == [[], [], [], [], [], [("a", 0.5), ("7", 2.0)], [("p", 1.0), ("q", 0.5), ("8", None)]]


def test_compaction_of_small_files(spark, tmp_path):
    want = {}
    for k in range(1, 60):
        want[k] = "x" * (k * 37 % 400)
        (tmp_path / f"in/try_{k:04d}").mkdir(parents=True)
        write(tmp_path / f"in/try_{k:04d}/diag.json", json.dumps({"request_id": str(k), "timestamp_utc": "2024-05-06T07:08:09Z", "error": want[k]}, indent=1))
    write(tmp_path / "in/try_0001/mask.png", "x")
    size = sum(p.stat().st_size for p in (tmp_path / "in").rglob("diag.json"))
    n = W.compact_diagnostics(spark, str(tmp_path / "in"), str(tmp_path / "out"), bin_bytes=4000)
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    assert len(files) == n and size // 4000 <= n <= size // 4000 + 1
    back = R.read_compacted(spark, str(tmp_path / "out"))
    assert {r.attempt_no: r.error for r in back.collect()} == want
    assert sorted(map(str, back.collect())) == sorted(map(str, R.read_diagnostics(spark, str(tmp_path / "in")).select(*back.columns).collect()))
    (tmp_path / "empty").mkdir()
    assert W.compact_diagnostics(spark, str(tmp_path / "empty"), str(tmp_path / "out2")) == 1 and R.read_compacted(spark, str(tmp_path / "out2")).count() == 0


def test_a_batch_that_is_tried_again_is_written_once(spark, tmp_path):
    schema = "request_id string, timestamp_utc string"
    for k in range(3):
        spark.createDataFrame([(f"{k}-{n}", f"2024-05-{6 + n % 2:02d}T00:00:00Z") for n in range(5)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start = lambda: W.write_diagnostics(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    rows = lambda: sorted(r.request_id for r in spark.read.json(f"{tmp_path}/out").collect())
    start()
    want = sorted(f"{k}-{n}" for k in range(3) for n in range(5))
    assert rows() == want
    for name in ("2", ".2.crc"):  # as if the query had died after writing its last batch and before noting so
        (tmp_path / "state/commits" / name).unlink()
    start()
    assert rows() == want
    assert {p.parent.name for p in (tmp_path / "out").glob("date=*/batch=*")} == {"date=2024-05-06", "date=2024-05-07"}
    with pytest.raises(ValueError, match="checkpoint"):
        W.write_diagnostics(stream(), f"{tmp_path}/out")


def test_responses_as_a_stream_of_bounded_batches(spark, tmp_path):
    for k in range(4):
        write(tmp_path / f"r{k}.json", "".join(json.dumps({"results": [{"text": "10AC13", "confidence": 0.5}], "debug": {"request_id": f"{k}{n}"}}) + "\n" for n in range(3)))
    stream = R.read_responses(spark, str(tmp_path), stream=True, files_per_batch=1)
    q = stream.writeStream.format("memory").queryName("bounded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) == 4 and spark.table("bounded").count() == 12


def test_responses_are_filtered_below_the_shuffle(spark, tmp_path):
    images = [f"/d/{k}.jpg" for k in range(300)]
    cases = spark.createDataFrame([(i,) for i in images], "image string")
    keep = spark.createDataFrame([(f"/d/{k}.jpg", "[]", 1.0, None) for k in range(20_000)], "image string, results string, latency_ms double, error string")
    keep.write.parquet(str(tmp_path / "r"))
    responses = spark.read.parquet(str(tmp_path / "r"))
    passed = responses.where(might_contain(bloom_filter(cases, "image"), F.col("image")))
    assert passed.join(cases, "image").count() == 300 and passed.count() < 600
    plan = E.attach_responses(cases, responses, cases)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    at = next(k for k, x in enumerate(lines) if "getbit" in x.lower() or "bit_get" in x.lower())
    assert not any("Exchange" in x for x in lines[at:] if len(x) - len(x.lstrip(" :+-|*()0123456789")) > len(lines[at]) - len(lines[at].lstrip(" :+-|*()0123456789")))
    assert spark.range(0).select(F.col("id").cast("string")).select(might_contain(bloom_filter(cases.where("false"), "image"), F.col("id"))).count() == 0


def test_gate_in_one_shuffle(spark):
    rows = [(f, s, (f * 7 + s) % 3 == 0 if f % 5 else None) for f in range(40) for s in range(3) if (f + s) % 4]
    attempts = spark.createDataFrame(rows, "frame_id int, stage_index int, is_complete boolean")
    frames = attempts.select("frame_id").distinct()
    want = A.apply_fallback(attempts.where("stage_index < 2"), attempts.where("stage_index = 2"), frames)
    assert sorted(map(str, A.gate_fallback(attempts).collect())) == sorted(map(str, want.collect()))


def test_paths_of_a_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", "/home/me")
    want = {"~": "/home/me", "~/a.jpg": "/home/me/a.jpg", "./b//c/./d.jpg": f"{tmp_path}/b/c/d.jpg", "/x//y.jpg": "/x/y.jpg", "e/../f.jpg": f"{tmp_path}/e/../f.jpg", "~x/g": f"{tmp_path}/~x/g", "h/": f"{tmp_path}/h", ".hid": f"{tmp_path}/.hid"}
    p = write(tmp_path / "m.json", json.dumps([{"image": k} for k in want]))
    assert [r.image for r in R.read_manifest(spark, p).orderBy("row_number").collect()] == list(want.values())


def test_the_filter_stands_in_no_plan(spark):
    cases = spark.range(150_000).select(F.concat(F.lit("/d/"), F.col("id").cast("string")).alias("image"))
    responses = cases.select("image", F.lit("[]").alias("results"), F.lit(1.0).alias("latency_ms"), F.lit(None).cast("string").alias("error"))
    filtered = cases.where(might_contain(bloom_filter(cases, "image"), F.col("image")))
    assert filtered.count() == 150_000 and spark.range(150_000, 200_000).where(might_contain(bloom_filter(cases, "image"), F.concat(F.lit("/d/"), F.col("id").cast("string")))).count() < 1500
    assert len(E.attach_responses(cases, responses, cases)._jdf.queryExecution().toString()) < 200_000  # the filter's words alone had 600,000 letters


def _many_cases(spark):
    cases = spark.range(150_000).select(F.concat(F.lit("/d/"), F.col("id").cast("string")).alias("image"), F.lit("x").alias("expected_name"), F.lit("10AC13").alias("expected_seat"))
    return cases, cases.select("image", F.lit("[]").alias("results"), F.lit(1.0).alias("latency_ms"), F.lit(None).cast("string").alias("error")), cases


def _plan_text(df):
    return len(df._jdf.queryExecution().toString())


def test_the_plan_of_an_evaluation_does_not_grow_with_its_cases(spark):
    assert _plan_text(E.evaluate(*_many_cases(spark))) < 200_000


def test_the_plan_of_a_summary_does_not_grow_with_its_cases(spark):
    summary, _ = evaluate_cases(*_many_cases(spark))
    assert _plan_text(summary) < 200_000 and summary.first().total == 150_000


def test_a_report_of_many_cases(spark, tmp_path):
    summary, records = evaluate_cases(*_many_cases(spark))
    assert _plan_text(records) < 200_000
    W.write_report(summary, records, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/records").count() == 150_000


def test_records_of_late_years_have_a_timestamp(spark, tmp_path):
    (tmp_path / "try_0001").mkdir()
    write(tmp_path / "try_0001/diag.json", json.dumps({"timestamp_utc": "10000-01-02T03:04:05Z"}))
    row = R.read_diagnostics(spark, str(tmp_path)).select(F.unix_timestamp("timestamp").alias("s")).first()
    assert row.s == 253402300800 + 86400 + 3 * 3600 + 4 * 60 + 5


def test_late_years_keep_their_dates(spark, tmp_path):
    at = ["9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "10000-01-12T00:00:00Z", "26614-12-19T21:20:00Z", None]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(at)], "request_id string, timestamp_utc string")
    W.write_diagnostics(rows, str(tmp_path / "out"))
    got = spark.read.schema("request_id string, date string").json(str(tmp_path / "out")).orderBy("request_id").collect()
    assert [r.date for r in got] == [t and t.split("T")[0] for t in at]


def test_compaction_keeps_what_the_reader_reads(spark, tmp_path):
    texts = ['{"request_id": "a"}', '[{"request_id": "b"}, {"request_id": "c"}]', "", " \n", "null", "no json", '{"request_id": 5, "ocr": "x"}', "[]", '{"request_id": "d"} tail', '{"request_id": "ü陳"}']
    for k, text in enumerate(texts):
        (tmp_path / f"in/try_{k:04d}").mkdir(parents=True)
        write(tmp_path / f"in/try_{k:04d}/diag.json", text)
    for k, (name, code) in enumerate((("a/try_0020", "utf-8-sig"), ("try_0021", "utf-16-le"), ("try_0022", "utf-32-be"), ("_x/try_0023", "utf-8"), (".y/try_0024", "utf-8"))):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "diag.json").write_bytes(json.dumps({"request_id": f"e{k}"}).encode(code))
    W.compact_diagnostics(spark, str(tmp_path / "in"), str(tmp_path / "out"), bin_bytes=40)
    back = R.read_compacted(spark, str(tmp_path / "out"))
    plain = spark.read.schema(R.DIAGNOSTIC).option("multiLine", True).json(str(tmp_path / "in"), pathGlobFilter="diag.json", recursiveFileLookup=True)
    want = plain.withColumn("attempt_no", F.regexp_extract("_metadata.file_path", r"try_([0-9]+)/", 1).cast("int"))
    rows = lambda df: sorted((r.attempt_no, r.request_id or "") for r in df.select("attempt_no", "request_id").collect())
    assert rows(back) == rows(want) and (21, "e1") in rows(back)


def test_many_files_are_read_by_few_tasks(spark, tmp_path):
    from gatescan.sources import files

    paths = spark.range(100_000).select(F.concat(F.lit(f"{tmp_path}/"), F.col("id").cast("string")).alias("path"))
    assert files.read_texts(paths, 100_000, 0).rdd.getNumPartitions() <= max(files.TURNS * spark.sparkContext.defaultParallelism, 25)


def test_folders_are_written_as_by_spark(spark, tmp_path):
    at = ["2024-05-06T07:08:09Z", "2024-05-06T08:08:09Z", "a/b:c%d +", "", None, "26614-12-19T21:20:00Z"]
    rows = spark.createDataFrame([(str(k), t, f"ü\n{k}") for k, t in enumerate(at)], "request_id string, timestamp_utc string, error string")
    W.write_diagnostics(rows, str(tmp_path / "out"))
    W.write_diagnostics(rows, str(tmp_path / "out"))
    spark.read.schema("request_id string, timestamp_utc string, error string, date string").json(str(tmp_path / "out")).write.partitionBy("date").json(str(tmp_path / "spark"))
    names = lambda top: sorted(p.name for p in (tmp_path / top).iterdir() if "=" in p.name)
    assert names("out") == names("spark") and sorted(p.name for p in (tmp_path / "out").iterdir()) == names("out")
    dates = ["2024-05-06", "2024-05-06", "a/b:c%d +", None, None, "26614-12-19"]
    want = sorted([(str(k), f"ü\n{k}", t) for k, t in enumerate(dates)] * 2, key=str)
    for got in (spark.read.schema("request_id string, error string, date string").json(str(tmp_path / "out")), R.read_written(spark, str(tmp_path / "out"), "request_id string, error string")):
        assert sorted(((r.request_id, r.error, r.date) for r in got.collect()), key=str) == want
