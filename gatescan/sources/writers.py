"""Writers of evaluation reports and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatescan.functions import text as X
from gatescan.operators.scans import BLOCK, in_range_partitions, starts_of
from gatescan.schemas import DIAGNOSTIC
from gatescan.sources.files import folder_of, list_files, opens, plain_names, read_texts, write_folders
from gatescan.storage import stored

#: Bytes of the small files that go to one file.
BIN_BYTES = 256 << 20


def write_report(summary: DataFrame, records: DataFrame, path: str) -> None:
    """The records as JSON lines in path/records and the summary's row in path/summary; text outside ASCII stays as it is."""
    records.write.mode("overwrite").json(f"{path}/records", ignoreNullFields=False)
    summary.write.mode("overwrite").json(f"{path}/summary", ignoreNullFields=False)


def _by_date(df: DataFrame) -> DataFrame:
    """Rows of a date in few files; where Spark may adapt the plan, a date of many rows is split again."""
    return df.hint("rebalance", F.col("date"))


def _lines(dated: DataFrame, below: str = "") -> DataFrame:
    """(folder of the date, JSON line) of records, by folder."""
    value = F.to_json(F.struct(*[c for c in dated.columns if c != "date"]))
    rows = _by_date(dated).select(F.concat(folder_of("date", F.col("date")), F.lit(below)).alias("folder"), value.alias("line"))
    return rows.sortWithinPartitions("folder")


def _write_batch(batch: DataFrame, number: int, root: str) -> None:
    """Writes a micro-batch to folders of its dates and its number, in place of what an earlier try of it has left."""
    if opens(root):
        return write_folders(_lines(batch, f"/batch={number}"), root, replace=True)
    _by_date(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").json(root)


def write_diagnostics(df: DataFrame, root: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Diagnostic records as JSON, partitioned by the date of timestamp_utc, all digits of its year included.

    A stream needs a checkpoint folder. Each of its micro-batches is written once, to date=.../batch=<its number>: a batch that
    is tried again, after a restart too, has the same rows and takes the place of its own folders. So any reader of the
    folder sees no row twice.
    """
    late = F.regexp_extract("timestamp_utc", "^([0-9]{5,}-[0-9]{2}-[0-9]{2})", 1)  # beyond the year 9999
    dated = df.withColumn("date", F.coalesce(F.nullif(late, F.lit("")), F.substring("timestamp_utc", 1, 10)))
    if df.isStreaming:
        if not checkpoint:
            raise ValueError("a stream needs a checkpoint folder")
        return dated.writeStream.foreachBatch(lambda batch, number: _write_batch(batch, number, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if opens(root):
        write_folders(_lines(dated), root)
    else:
        _by_date(dated).write.mode("append").partitionBy("date").json(root)
    return None


def pack_files(files: DataFrame, order: list[str], bin_bytes: int = BIN_BYTES) -> DataFrame:
    """files (length) with bin: files in their order fill bins of bin_bytes, the file that crosses a bin's end belonging to it. So a
    bin has at most bin_bytes and one file more, and there are at most the sum of lengths / bin_bytes bins and one more."""
    ranged = in_range_partitions(files, order, 64)
    starts = starts_of(ranged.groupBy(BLOCK).agg(F.sum("length").alias("n")), [BLOCK]).select(BLOCK, "before")
    own = F.coalesce(F.sum("length").over(Window.partitionBy(BLOCK).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("own", own).join(starts, BLOCK)
    return placed.select(*files.columns, F.floor((F.col("before") + F.col("own")) / bin_bytes).cast("int").alias("bin"))


def compact_diagnostics(spark: SparkSession, root: str, path: str, bin_bytes: int = BIN_BYTES) -> int:
    """Writes the records of root/try_NNNN/diag.json, however many small files there are, to Parquet files of about equal shares in
    path, in the order of their attempts, and returns how many. read_compacted() reads them.

    The files' sizes come from a listing and are packed into bins; records are read with their schema given, so no pass infers it,
    and many files by a task, which no driver lists once more.
    """
    listed = list_files(spark, root).where(F.col("path").rlike(r"/try_[0-9]+/diag\.json$") & plain_names(F.col("path"), root)).withColumn("attempt_no", X.attempt_number(F.regexp_extract("path", r"(try_[0-9]+)/diag\.json$", 1)))
    bins = stored(pack_files(listed, ["attempt_no"], bin_bytes), "bins")
    total = bins.agg((F.coalesce(F.max("bin"), F.lit(0)) + 1).alias("bins"), F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if opens(root):
        placed = records_of(read_texts(bins.withColumn("bin", F.min("bin").over(Window.partitionBy("attempt_no"))), total.files, total.bytes))
    else:
        records = spark.read.schema(DIAGNOSTIC).option("multiLine", True).json(root, pathGlobFilter="diag.json", recursiveFileLookup=True)
        found = records.withColumn("attempt_no", X.attempt_number(F.regexp_extract(F.col("_metadata.file_path"), r"(try_[0-9]+)/diag\.json$", 1))).where(F.col("attempt_no").isNotNull())
        placed = found.join(bins.groupBy("attempt_no").agg(F.min("bin").alias("bin")), "attempt_no")
    placed.repartitionById(total.bins, F.col("bin")).sortWithinPartitions("attempt_no").drop("bin").write.mode("overwrite").parquet(path)
    return total.bins


def records_of(texts: DataFrame) -> DataFrame:
    """The diagnostic records of whole files (text, bin, attempt_no), as Spark's reader gives them: an object or a list of them; what is no JSON is a row of nulls."""
    none = F.array(F.lit(None).cast(f"struct<{DIAGNOSTIC}>"))
    rows = texts.select("bin", "attempt_no", F.explode(F.coalesce(F.from_json("text", f"array<struct<{DIAGNOSTIC}>>"), none)).alias("r"))
    return rows.select("attempt_no", "bin", "r.*")
