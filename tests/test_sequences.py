"""Closed forms against plain folds on random sessions, and streams against the batch forms in several micro-batches."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatescan.operators import scans as SC
from gatescan.operators import sequences as T
from gatescan.streaming import streams as R

FOLLOW = {k: list(v) for k, v in T.FOLLOWERS.items()}
START = dt.datetime(2024, 1, 1)


def scans(rng, n_sessions=30, n=25):
    audio = {"A": True, "B": True, "C": False}
    out = []
    for s in range(n_sessions):
        for k in range(n):
            seat = rng.choice(["A", "B", "C", None])
            failed = rng.random() < 0.2
            out.append((s, START + dt.timedelta(seconds=s + 60 * k), rng.random() < 0.8, failed, None if failed else seat, bool(audio.get(seat)) and not failed, rng.choice(list(T.FOLLOWERS))))
    return out


SCHEMA = "session_id long, ts timestamp, continuous boolean, failed boolean, resolved_seat string, has_audio boolean, outcome string"


def fold_suppress(rows):
    memory, out = {}, {}
    for s, ts, continuous, failed, seat, audio, _ in sorted(rows, key=lambda r: r[:2]):
        last = memory.get(s)
        suppressed = played = False
        if not failed:
            if continuous and seat and seat == last:
                suppressed = True
            elif seat and audio:
                played = True
            memory[s] = seat if continuous and (played or suppressed) else None
        out[s, ts] = suppressed
    return out


def fold_states(rows):
    state, out = {}, {}
    for s, ts, wanted in rows:
        now = state.get(s, "Ready")
        ok = wanted == now or wanted in FOLLOW[now]
        state[s] = wanted if ok else now
        out[s, ts] = (ok, state[s])
    return out


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    R.use_state_store(spark)


@pytest.fixture(scope="module")
def rows():
    return scans(random.Random(3))


def test_suppression_equals_the_fold(spark, rows):
    got = T.suppress_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.session_id, r.ts): r.suppressed for r in got} == fold_suppress(rows)


def test_transitions_equal_the_fold(spark, rows):
    plain = [(r[0], r[1], r[6]) for r in rows]
    got = T.validate_transitions(spark.createDataFrame(plain, "session_id long, ts timestamp, requested string")).collect()
    assert {(r.session_id, r.ts): (r.accepted, r.state) for r in got} == fold_states(plain)


def test_every_single_step_follows_the_transition_table(spark):
    reach = {"Ready": [], "Scanning": ["Scanning"], "Recognized": ["Scanning", "Recognized"], "RetryNeeded": ["RetryNeeded"]}
    rows, want = [], {}
    for a in T.FOLLOWERS:
        for b in T.FOLLOWERS:
            session = len(want)
            for k, r in enumerate([*reach[a], b]):
                rows.append((session, k, r))
            want[session, len(reach[a])] = a == b or b in T.FOLLOWERS[a]
    got = T.validate_transitions(spark.createDataFrame(rows, "session_id long, ts long, requested string")).collect()
    assert {(r.session_id, r.ts): r.accepted for r in got if (r.session_id, r.ts) in want} == want


@pytest.mark.parametrize(("failed", "complete", "name", "seat", "want"), [(True, True, 1.0, 1.0, "RetryNeeded"), (False, False, 1.0, 1.0, "Scanning"), (False, True, 0.8, 0.9, "Recognized"), (False, True, 0.79, 0.9, "RetryNeeded"), (False, True, 0.8, 0.89, "RetryNeeded")])
def test_outcomes(spark, failed, complete, name, seat, want):
    df = spark.createDataFrame([(failed, complete, name, seat)], "failed boolean, complete boolean, name_confidence double, seat_confidence double")
    assert T.classify_scan(df).first().outcome == want


def run(spark, rows, schema, build, folder, batches=4):
    """Feeds the rows, by time, in several files of one micro-batch each."""
    rows = sorted(rows, key=lambda r: r[1])
    step = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = build(stream)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def test_stream_suppression_in_micro_batches(spark, rows, tmp_path):
    got = run(spark, rows, SCHEMA, lambda s: R.stream_suppress(s, delay="1 day"), str(tmp_path))
    assert {(r.session_id, r.ts): r.suppressed for r in got} == fold_suppress(rows)


def test_stream_states_in_micro_batches(spark, rows, tmp_path):
    plain = [(r[0], r[1], r[6]) for r in rows]
    got = run(spark, plain, "session_id long, ts timestamp, requested string", lambda s: R.stream_states(s, delay="1 day"), str(tmp_path))
    assert {(r.session_id, r.ts): (r.accepted, r.state) for r in got} == fold_states(plain)


def test_combined_stream_equals_both(spark, rows, tmp_path):
    rows = [r for r in rows if r[6] in ("Scanning", "Recognized", "RetryNeeded")]
    got = run(spark, rows, SCHEMA, lambda s: R.stream_scan(s, delay="1 day"), str(tmp_path))
    both = [(r[0], r[1], w) for r in sorted(rows, key=lambda r: r[:2]) for w in ("Scanning", r[6])]
    assert {(r.session_id, r.ts): r.suppressed for r in got} == fold_suppress(rows)
    assert {(r.session_id, r.ts): r.state for r in got} == {k: v[1] for k, v in fold_states(both).items()}


def test_late_frames_are_dropped(spark, tmp_path):
    a, b = START, START - dt.timedelta(seconds=5)
    plain = [(1, a, "Scanning")], [(1, b, "Recognized")]
    schema = "session_id long, ts timestamp, requested string"
    for k, x in enumerate(plain):
        spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = R.stream_states(stream, delay="1 day")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [r.ts for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()] == [a]


# -- sessions of any length --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def long_rows():
    """One session of most rows, with equal times that a number orders, a few short ones and rows without a session."""
    rng = random.Random(11)
    out = []
    for k, r in enumerate(scans(rng, 1, 700) + scans(rng, 6, 15)):
        s = 0 if k < 700 else None if r[0] == 5 else r[0] + 1
        out.append((s, START + dt.timedelta(seconds=k // 7), *r[2:], k))
    rng.shuffle(out)
    return out


LONG = SCHEMA + ", k long"


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[7]))


@pytest.mark.parametrize("block_rows", [1 << 20, 100, 9])
def test_long_sessions_equal_the_fold(spark, long_rows, block_rows):
    df = spark.createDataFrame(long_rows, LONG).repartition(5)
    want = fold_suppress([((r[0] is None, r[0] or 0), n, *r[2:7]) for n, r in enumerate(in_order(long_rows))])
    names = {n: r[7] for n, r in enumerate(in_order(long_rows))}
    got = T.suppress_repeats(df, order=["ts", "k"], block_rows=block_rows)
    assert got.columns == [*df.columns, "suppressed"]
    assert {r.k: r.suppressed for r in got.collect()} == {names[n]: v for (_, n), v in want.items()}
    want = fold_states([((r[0] is None, r[0] or 0), n, r[6]) for n, r in enumerate(in_order(long_rows))])
    got = T.validate_transitions(df, order=["ts", "k"], request="outcome", block_rows=block_rows)
    assert {r.k: (r.accepted, r.state) for r in got.collect()} == {names[n]: v for (_, n), v in want.items()}


@pytest.mark.parametrize("kind", ["Scanning", "Ready", "Recognized", "RetryNeeded", None])
def test_blocks_without_an_opening_request(spark, kind):
    """Whole blocks of Recognized and RetryNeeded pass on what the blocks before them have left."""
    rng = random.Random(str(kind))
    wanted = ([kind] if kind else []) + [rng.choice(["Recognized", "RetryNeeded"]) for _ in range(60)] + ["Ready"] + [rng.choice(["Recognized", "RetryNeeded", "x", None]) for _ in range(40)]
    rows = [(1, k, w) for k, w in enumerate(wanted)]
    got = T.validate_transitions(spark.createDataFrame(rows, "session_id int, ts int, requested string"), block_rows=7).collect()
    assert {(r.session_id, r.ts): (r.accepted, r.state) for r in got} == fold_states(rows)


def test_no_window_holds_a_long_session(spark, long_rows):
    df = spark.createDataFrame(long_rows, LONG)
    text = T.suppress_repeats(df, order=["ts", "k"], block_rows=100)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.split("\n") if "Window [" in line]
    assert len(windows) == 2
    for line in windows:  # over rows by session and block, or over the blocks' summaries
        assert re.search(r"windowspecdefinition\(session_id#\d+L, __block#\d+L, ts", line) or "last(last#" in line
    plain = T.suppress_repeats(df, order=["ts", "k"])._jdf.queryExecution().executedPlan().toString()
    assert plain.count("Exchange hashpartitioning") == 1 and "Join" not in plain


def test_numbers_of_rows(spark):
    rng = random.Random(1)
    values = [rng.randrange(50) for _ in range(400)] + [None]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k int")
    got = SC.number_rows(df, [F.col("v").asc_nulls_last(), "k"], parts=7).collect()
    want = sorted(range(401), key=lambda k: (values[k] is None, values[k] or 0, k))
    assert [r.k for r in sorted(got, key=lambda r: r.row_number)] == want and sorted(r.row_number for r in got) == list(range(1, 402))
    assert SC.number_rows(df.where("false"), ["v"]).count() == 0


# -- streams: order, equal times, late and idle sessions ------------------------------------------------------------------


def test_ordered_frames_by_arrays_equal_the_fold(long_rows):
    rng = random.Random(2)
    for _ in range(60):
        rows = [r for r in in_order(long_rows) if r[0] == 0][: rng.randrange(1, 80)]
        cut = rng.randrange(len(rows) + 1)
        seat, state, suppressed, accepted = None, "Ready", [], []
        for part in (rows[:cut], rows[cut:]):
            if part:
                column = lambda i, kind=object: np.array([r[i] for r in part], dtype=kind)  # noqa: E731, B023
                repeat, seat = R.remembered(column(4), column(2, bool), column(3, bool), column(5, bool), seat)
                ok, states, state = R.followed(column(6), state)
                suppressed += repeat.tolist()
                accepted += list(zip(ok.tolist(), states.tolist(), strict=True))
        plain = [(0, n, *r[2:7]) for n, r in enumerate(rows)]
        assert suppressed == list(fold_suppress(plain).values())
        assert accepted == list(fold_states([(r[0], r[1], r[6]) for r in plain]).values())


def stream_of_files(spark, folder, parts, schema):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def finish(spark, out, folder):
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def test_equal_times_in_and_across_micro_batches(spark, long_rows, tmp_path):
    rows = in_order([r for r in long_rows if r[0] is not None])
    by_time = sorted(rows, key=lambda r: (r[1], r[7]))
    parts = [by_time[k : k + 150] for k in range(0, len(by_time), 150)]  # a batch ends among rows of one time
    for p in parts:
        random.Random(3).shuffle(p)
    stream = stream_of_files(spark, tmp_path, parts, LONG)
    got = finish(spark, R.stream_scan(stream, delay="1 day", idle="365 days", tie="k"), tmp_path)
    batch = T.suppress_repeats(spark.createDataFrame(rows, LONG), order=["ts", "k"]).collect()
    assert {r.k: r.suppressed for r in got} == {r.k: r.suppressed for r in batch} and len(got) == len(rows)
    both = [(r[0], (r[1], r[7], n), w) for r in rows for n, w in enumerate(("Scanning", r[6]))]
    states = {place[1]: state for (_, place), (_, state) in fold_states(both).items() if place[2] == 1}
    assert {r.k: r.state for r in got} == states


def test_equal_times_without_a_tie_are_kept(spark, tmp_path):
    schema = "session_id long, ts timestamp, requested string"
    stream = stream_of_files(spark, tmp_path, [[(1, START, "Scanning"), (1, START, "Recognized")], [(1, START, "Scanning")]], schema)
    assert len(finish(spark, R.stream_states(stream), tmp_path)) == 3


def test_late_and_idle_sessions(spark, tmp_path):
    """A pause of more than idle ends the memory, within a batch and across; frames behind the watermark are dropped; state goes."""
    schema = "session_id long, ts timestamp, requested string"
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    parts = [
        [(1, at(0), "Scanning"), (1, at(1), "Recognized"), (2, at(0), "Scanning")],
        [(1, at(40), "Recognized"), (2, at(300), "Recognized"), (3, at(300), "Scanning"), (3, at(390), "Recognized")],
        [(2, at(100), "Scanning"), (1, at(400), "Recognized")],  # the first is later than the watermark of 390 - 10
        [(2, at(800), "RetryNeeded")],
    ]
    out = R.stream_states(stream_of_files(spark, tmp_path, parts, schema), delay="10 minutes", idle="1 hour")
    got = {(r.session_id, (r.ts - START).seconds // 60): (r.accepted, r.state) for r in finish(spark, out, tmp_path)}
    assert got == {
        (1, 0): (True, "Scanning"), (1, 1): (True, "Recognized"), (2, 0): (True, "Scanning"), (1, 40): (True, "Recognized"), (2, 300): (False, "Ready"), (3, 300): (True, "Scanning"),
        (3, 390): (False, "Ready"), (1, 400): (False, "Ready"), (2, 800): (True, "RetryNeeded"),
    }
    kept = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "memory").load()
    assert [r.key.session_id for r in kept.select("key").collect()] == [2]  # the timers have removed the others


def test_streams_ask_for_their_state_store(spark, tmp_path):
    stream = stream_of_files(spark, tmp_path, [[(1, START, "Scanning")]], "session_id long, ts timestamp, requested string")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="use_state_store"):
        R.stream_states(stream)
    R.use_state_store(spark)
