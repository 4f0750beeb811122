"""Frames of a session in order: repeat suppression, outcomes and state changes, with windows only.

Partition by session, not by device. A session may still be of any length: one of more than block_rows rows is cut into blocks
(operators/scans.py). A block's effect is short: for suppression the last remembered seat, for states a map of the four states
to four states. A scan over a session's blocks carries it, and each block's rows finish with what came before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatescan.operators.scans import BLOCK, BLOCK_ROWS, session_blocks

#: The states that each state may be followed by. Fixed values.
FOLLOWERS = {
    "Ready": ("Scanning", "RetryNeeded"),
    "Scanning": ("Recognized", "RetryNeeded", "Ready"),
    "Recognized": ("Scanning", "Ready"),
    "RetryNeeded": ("Scanning", "Ready"),
}


def _with_carried(rows: DataFrame, blocks: DataFrame, session: str) -> DataFrame:
    """rows with the column carried of their block (blocks: session, __block, carried), or null."""
    own = blocks.select(F.col(session).alias("__of"), F.col(BLOCK).alias("__at"), "carried")
    return rows.join(own, rows[session].eqNullSafe(own["__of"]) & (rows[BLOCK] == own["__at"]), "left").drop("__of", "__at")


def suppress_repeats(df: DataFrame, session: str = "session_id", order: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df (continuous, failed, resolved_seat, has_audio) with suppressed: a continuous frame whose seat equals the remembered one.

    After a frame the memory is its seat if it was played or suppressed, else nothing; one-click frames clear it and failed
    requests leave it. So it depends only on the last frame before that hasn't failed, given that a seat's recording exists or
    not throughout.
    """
    order = order or ["ts"]
    rows, cut = session_blocks(df, session, order, block_rows)
    own = F.when(F.col("continuous") & F.col("has_audio"), F.col("resolved_seat"))
    known = F.when(~F.col("failed"), F.struct(own.alias("seat")))
    earlier = (Window.unboundedPreceding, -1)
    memory = F.last(known, ignorenulls=True).over(Window.partitionBy(session, BLOCK).orderBy(*order).rowsBetween(*earlier))
    found = rows.withColumn("__memory", memory)
    if cut:
        blocks = rows.where(F.col(BLOCK) > 0).groupBy(session, BLOCK).agg(F.max_by(known, F.when(~F.col("failed"), F.struct(*order))).alias("last"))
        carried = F.last("last", ignorenulls=True).over(Window.partitionBy(session).orderBy(BLOCK).rowsBetween(*earlier))
        found = _with_carried(found, blocks.withColumn("carried", carried), session).withColumn("__memory", F.coalesce("__memory", "carried"))
    repeat = ~F.col("failed") & F.col("continuous") & F.col("resolved_seat").isNotNull() & (F.col("__memory.seat") == F.col("resolved_seat"))
    return found.withColumn("suppressed", F.coalesce(repeat, F.lit(False))).select(*[c for c in df.columns if c != "suppressed"], "suppressed")


def classify_scan(df: DataFrame, name_threshold: float = 0.8, seat_threshold: float = 0.9) -> DataFrame:
    """df (failed, complete, name_confidence, seat_confidence) with outcome, the state that the frame asks for."""
    good = (F.col("name_confidence") >= name_threshold) & (F.col("seat_confidence") >= seat_threshold)
    outcome = F.when(F.col("failed"), "RetryNeeded").when(~F.col("complete"), "Scanning").when(good, "Recognized").otherwise("RetryNeeded")
    return df.withColumn("outcome", outcome)


def state_requests(df: DataFrame, session: str = "session_id", order: str = "ts") -> DataFrame:
    """Two requests per frame: Scanning, then its outcome; step orders them."""
    both = F.array(F.struct(F.lit(0).alias("step"), F.lit("Scanning").alias("requested")), F.struct(F.lit(1).alias("step"), F.col("outcome").alias("requested")))
    return df.select("*", F.inline(both))


def _after(opened: Column, first: Column, retry: Column) -> Column:
    """The state at the end of a segment that opened in a state: first is its first Recognized or RetryNeeded, retry whether there
    was a RetryNeeded. From Scanning the first counts, from Ready only a RetryNeeded, and the two others stay."""
    return F.when(opened == "Scanning", F.coalesce(first, opened)).when(opened == "Ready", F.when(retry, "RetryNeeded").otherwise("Ready")).otherwise(opened)


def _carried_states(rows: DataFrame, session: str, order: list[str], retry: Column) -> DataFrame:
    """(session, __block, carried): the state in which each block of a long session begins.

    A block that holds a Scanning or Ready maps every state to one; any other maps them by its first Recognized or RetryNeeded and
    whether it holds a RetryNeeded, and so does a run of such blocks. So the scan is that of single requests, block by block.
    """
    ends = rows.where(F.col(BLOCK) > 0).groupBy(session, BLOCK).agg(F.max_by(F.struct("__opened", "__first", retry.alias("retry")), F.struct(*order)).alias("e")).select(session, BLOCK, "e.*")
    ends = ends.withColumn("fixed", F.when(F.col("__opened").isNotNull(), _after(F.col("__opened"), F.col("__first"), F.col("retry"))))
    w = Window.partitionBy(session).orderBy(BLOCK)
    ends = ends.withColumn("run", F.count("fixed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(session, "run").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    passing = F.col("fixed").isNull()
    state = _after(F.coalesce(F.first("fixed", ignorenulls=True).over(r), F.lit("Ready")), F.first(F.when(passing, F.col("__first")), ignorenulls=True).over(r), F.max(passing & F.col("retry")).over(r))
    return ends.withColumn("state", state).select(session, BLOCK, F.lag("state", 1, "Ready").over(w).alias("carried"))


def validate_transitions(df: DataFrame, session: str = "session_id", order: list[str] | None = None, request: str = "requested", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with accepted and state (after the request). Sessions start as Ready; a rejected request changes nothing, and one that is
    null or no state is rejected.

    Scanning and Ready are accepted from every state, so each such request starts a segment of known state. Within a segment
    after Scanning the first Recognized or RetryNeeded is accepted, and later only its like; after Ready, RetryNeeded only.
    """
    order = order or ["ts"]
    rows, cut = session_blocks(df, session, order, block_rows)
    r = F.col(request)
    opens, follows = F.coalesce(r.isin("Scanning", "Ready"), F.lit(False)), r.isin("Recognized", "RetryNeeded")
    until = (Window.unboundedPreceding, 0)
    rows = rows.withColumn("__segment", F.count_if(opens).over(Window.partitionBy(session, BLOCK).orderBy(*order).rowsBetween(*until)))
    s = Window.partitionBy(session, BLOCK, "__segment").orderBy(*order).rowsBetween(*until)
    rows = rows.withColumn("__opened", F.first(F.when(opens, r), ignorenulls=True).over(s)).withColumn("__first", F.first(F.when(follows, r), ignorenulls=True).over(s))
    if cut:
        retries = rows.withColumn("__retry", F.coalesce(F.max(r == "RetryNeeded").over(s), F.lit(False)))
        rows = _with_carried(rows, _carried_states(retries, session, order, F.col("__retry")), session)
    start = F.coalesce("carried", F.lit("Ready")) if cut else F.lit("Ready")
    rows = rows.withColumn("__opened", F.coalesce("__opened", start))
    opened = F.col("__opened")
    accepted = opens | F.coalesce(follows & (r == F.when(opened == "Scanning", F.col("__first")).when(opened == "Ready", "RetryNeeded").otherwise(opened)), F.lit(False))
    rows = rows.withColumn("accepted", accepted)
    state = F.coalesce(F.last(F.when(F.col("accepted"), r), ignorenulls=True).over(s), opened)
    return rows.withColumn("state", state).select(*[c for c in df.columns if c not in ("accepted", "state")], "accepted", "state")
