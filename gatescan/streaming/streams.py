"""The continuous scan as streams.

Parsing and the directory lookup are stateless. Suppression and states keep one small state per session in one operator, in the
state store of RocksDB (use_state_store). Rules of this library, as a stream needs them:

- In a micro-batch a session's frames go by (event time, tie). A frame that comes before the last one of an earlier batch in that
  order is dropped; frames of equal time are all kept, by tie. Without a tie column equal times go in the order of arrival.
- A gap of more than idle between two frames ends a session's memory, wherever batches begin; a timer of event time removes the
  state itself once the watermark has passed that gap, so memory is that of the sessions in use. Frames later than the watermark
  (delay) are dropped by Spark. Frames without a time are left out.
- Of a micro-batch a task holds one session at a time, as arrays of the few columns needed, and gives it out in slices; the size
  of a batch is bounded at its source (maxFilesPerTrigger or maxBytesPerTrigger, see read_responses).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatescan.operators.directory import resolve_seats, with_audio
from gatescan.operators.scoring import parse_result
from gatescan.operators.sequences import FOLLOWERS, classify_scan
from gatescan.schemas import RAW_ITEM

IDLE, DELAY = "1 hour", "10 minutes"
#: Rows of a piece that is given out.
SLICE = 10_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES = tuple(FOLLOWERS)
_READY, _SCANNING, _RETRY = (STATES.index(x) for x in ("Ready", "Scanning", "RetryNeeded"))


def use_state_store(spark: SparkSession) -> None:
    """Streams that are started in this session from now on keep their state in RocksDB, which the stateful operators here need."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def stream_parse(responses: DataFrame, name_threshold: float = 0.8, seat_threshold: float = 0.9) -> DataFrame:
    """Responses (results as JSON text or items, error, and session columns) with the parsed fields and the outcome; no shuffle."""
    df = responses
    if df.schema["results"].dataType.typeName() == "string":
        df = df.withColumn("results", F.when(F.ltrim("results").startswith("["), F.from_json("results", f"array<{RAW_ITEM}>")))
    failed = F.coalesce(F.trim("error") != "", F.lit(False))
    df = parse_result(df.withColumn("failed", failed), "results").select(*[c for c in df.columns if c != "results"], "failed", "parsed.*")
    return classify_scan(df, name_threshold, seat_threshold)


def stream_resolve(parsed: DataFrame, directory: DataFrame, audio: DataFrame, exact: bool = True) -> DataFrame:
    """parsed with resolved_seat and has_audio; the static sides are read once per query start."""
    return with_audio(resolve_seats(parsed, directory, exact=exact), audio)


def remembered(seat: np.ndarray, continuous: np.ndarray, failed: np.ndarray, audio: np.ndarray, memory: str | None) -> tuple[np.ndarray, str | None]:
    """(suppressed, memory afterwards) of ordered frames: each compares with the last frame before it that hasn't failed."""
    codes, names = pd.factorize(seat)
    known = {n: k for k, n in enumerate(names)}
    start = -1 if memory is None else known.get(memory, len(names))
    own = np.where(continuous & audio, codes, -1)
    last = np.maximum.accumulate(np.where(failed, -1, np.arange(len(codes))))
    before = np.concatenate(([-1], last[:-1]))
    had = np.where(before >= 0, own[before], start)
    suppressed = ~failed & continuous & (codes >= 0) & (had == codes)
    if last[-1] < 0:
        return suppressed, memory
    return suppressed, None if own[last[-1]] < 0 else str(names[own[last[-1]]])


def followed(requested: np.ndarray, state: str) -> tuple[np.ndarray, np.ndarray, str]:
    """(accepted, states after each, the last of them) of ordered requests, by segments that a Ready or Scanning opens."""
    codes = pd.Categorical(requested, categories=STATES).codes.astype(np.int64)
    n, at = len(codes), np.arange(len(codes))
    opens, follows = (codes == _READY) | (codes == _SCANNING), codes > _SCANNING
    begin = np.maximum.accumulate(np.where(opens, at, -1))
    opened = np.where(begin >= 0, codes[begin], STATES.index(state))
    upcoming = lambda x: np.append(np.minimum.accumulate(np.where(x, at, n)[::-1])[::-1], n)[begin + 1]  # noqa: E731  the first of its kind in the segment
    first, retry = upcoming(follows), upcoming(codes == _RETRY)
    found = codes[np.minimum(first, n - 1)]
    wanted = np.where(opened == _SCANNING, found, np.where(opened == _READY, _RETRY, opened))
    accepted = opens | (follows & (codes == wanted))
    after = np.where(opened == _SCANNING, np.where(first <= at, found, opened), np.where((opened == _READY) & (retry <= at), _RETRY, opened))
    states = np.array(STATES, dtype=object)[after]
    return accepted, states, str(states[-1])


class _Sessions(StatefulProcessor):
    """One value per session: the place of its last frame, its seat and state, and the time of its timer."""

    def __init__(self, apply, names: dict[str, str], columns: list[str], tie_type: str, idle: str):
        self.apply, self.names, self.columns, self.tie_type = apply, names, columns, tie_type
        self.idle = int(pd.Timedelta(idle).total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("memory", f"last long, tie {self.tie_type}, seat string, state string, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        session, ts, tie = (self.names.get(k) for k in ("session", "ts", "tie"))
        kept: dict[str, list[np.ndarray]] = {c: [] for c in self.columns}
        for chunk in rows:
            for c in self.columns:
                kept[c].append(chunk[c].to_numpy())
        data = {c: np.concatenate(v) for c, v in kept.items()}
        data[ts] = data[ts].astype("datetime64[us]")
        at = data[ts].astype(np.int64)
        order = np.lexsort((data[tie], at)) if tie else np.argsort(at, kind="stable")
        last, last_tie, seat, state, timer = self.value.get() if self.value.exists() else (None, None, None, "Ready", None)
        if last is not None:
            earlier = at[order] < last
            if tie:
                earlier |= (at[order] == last) & (data[tie][order] <= last_tie)
            order = order[~earlier]
        if not len(order):
            return
        data, at = {c: v[order] for c, v in data.items()}, at[order]
        gaps = np.flatnonzero(np.diff(at, prepend=at[0] if last is None else last) > self.idle)
        out = []
        for a, e in zip([0, *gaps.tolist()], [*gaps.tolist(), len(at)], strict=True):
            if a in gaps:
                seat, state = None, "Ready"
            if e > a:
                columns, seat, state = self.apply({c: v[a:e] for c, v in data.items()}, seat, state)
                out.append({session: np.full(e - a, key[0]), ts: data[ts][a:e]} | columns)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(timerValues.getCurrentWatermarkInMs() + 1, (int(at[-1]) + self.idle) // 1000 + 1)
        self.handle.registerTimer(timer)
        self.value.update((int(at[-1]), data[tie][-1].item() if tie else None, seat, state, timer))
        for part in out:
            for a in range(0, len(part[ts]), SLICE):
                yield pd.DataFrame({c: v[a : a + SLICE] for c, v in part.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _sessions(df: DataFrame, apply, inputs: list[str], output: str, session: str, ts: str, tie: str | None, delay: str, idle: str) -> DataFrame:
    """apply(columns of ordered frames, seat, state) gives the output columns, and seat and state afterwards."""
    spark = df.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        raise ValueError("stateful streams need the state store of RocksDB: call use_state_store(spark) first")
    columns = [ts, *([tie] if tie else []), *inputs]
    kind = df.schema[session].dataType.simpleString()
    timed = df.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(session, *columns)
    processor = _Sessions(apply, {"session": session, "ts": ts, "tie": tie}, columns, df.schema[tie].dataType.simpleString() if tie else "long", idle)
    return timed.groupBy(session).transformWithStateInPandas(processor, f"{session} {kind}, {ts} timestamp, {output}", "Append", "EventTime")


def _flag(x: np.ndarray) -> np.ndarray:
    """Booleans, null as false."""
    return x if x.dtype == bool else np.array([v is True or v is np.True_ for v in x], dtype=bool)


_FRAME = ["continuous", "failed", "resolved_seat", "has_audio"]


def _suppression(data: dict, seat: str | None) -> tuple[np.ndarray, str | None]:
    return remembered(data["resolved_seat"], *(_flag(data[c]) for c in ("continuous", "failed", "has_audio")), seat)


def stream_suppress(df: DataFrame, session: str = "session_id", ts: str = "ts", delay: str = DELAY, idle: str = IDLE, tie: str | None = None) -> DataFrame:
    """session, ts, (tie,) resolved_seat, suppressed for frames of (continuous, failed, resolved_seat, has_audio)."""

    def apply(data, seat, state):
        repeat, seat = _suppression(data, seat)
        return ({tie: data[tie]} if tie else {}) | {"resolved_seat": data["resolved_seat"], "suppressed": repeat}, seat, state

    return _sessions(df, apply, _FRAME, _tied(df, tie) + "resolved_seat string, suppressed boolean", session, ts, tie, delay, idle)


def _tied(df: DataFrame, tie: str | None) -> str:
    return f"{tie} {df.schema[tie].dataType.simpleString()}, " if tie else ""


def stream_states(df: DataFrame, session: str = "session_id", ts: str = "ts", delay: str = DELAY, idle: str = IDLE, tie: str | None = None) -> DataFrame:
    """session, ts, (tie,) requested, accepted, state for single requests (requested)."""

    def apply(data, seat, state):
        accepted, states, state = followed(data["requested"], state)
        return ({tie: data[tie]} if tie else {}) | {"requested": data["requested"], "accepted": accepted, "state": states}, seat, state

    return _sessions(df, apply, ["requested"], _tied(df, tie) + "requested string, accepted boolean, state string", session, ts, tie, delay, idle)


def stream_scan(df: DataFrame, session: str = "session_id", ts: str = "ts", delay: str = DELAY, idle: str = IDLE, tie: str | None = None) -> DataFrame:
    """Suppression and states of whole frames (with outcome) in one stateful operator: one shuffle and one state store."""

    def apply(data, seat, state):
        repeat, seat = _suppression(data, seat)
        both = np.empty(2 * len(repeat), dtype=object)
        both[0::2], both[1::2] = "Scanning", data["outcome"]
        accepted, states, state = followed(both, state)
        columns = {"resolved_seat": data["resolved_seat"], "suppressed": repeat, "outcome": data["outcome"], "accepted": accepted[0::2] & accepted[1::2], "state": states[1::2]}
        return ({tie: data[tie]} if tie else {}) | columns, seat, state

    return _sessions(df, apply, [*_FRAME, "outcome"], _tied(df, tie) + "resolved_seat string, suppressed boolean, outcome string, accepted boolean, state string", session, ts, tie, delay, idle)
