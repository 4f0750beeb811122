"""Sums of long integer vectors that tasks have gathered, in two steps, so that no task receives those of all others at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of the first step for each part.
SALTS = 256


def add_up(gathered: DataFrame) -> DataFrame:
    """(part int, total binary) of rows (part int, total binary) that hold int64 vectors of one length per part."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype="<i8") for x in table.column("total"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "total": pa.array([np.asarray(total, dtype="<i8").tobytes()], pa.binary())})

    salted = gathered.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = salted.groupBy("part", "salt").applyInArrow(lambda t: run(t.select(["part", "total"])), "part int, total binary")
    return first.groupBy("part").applyInArrow(run, "part int, total binary")


def collected(gathered: DataFrame) -> dict[int, np.ndarray]:
    """add_up() on the driver; only for vectors whose whole size is bounded."""
    return {r.part: np.frombuffer(r.total, dtype="<i8") for r in add_up(gathered).collect()}
