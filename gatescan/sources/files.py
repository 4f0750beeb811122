"""Files as rows: listings of folders, files written under given names, and line numbers over split and several files."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatescan.operators.scans import starts_of
from gatescan.storage import stored

#: Folders that one task lists where there are few, and the most tasks of a level.
FOLDERS_A_TASK, MOST_TASKS = 64, 10_000
#: Of many folders or small files a task takes so many, in as many tasks at least as keep all cores busy TURNS times; and bytes of files.
MANY, TURNS, BYTES_A_TASK = 4096, 8, 64 << 20
#: Files of a listing that travel at once.
_BATCH = 10_000
#: Characters of contents that travel at once, about.
_TEXT = 4 << 20
#: Schemes that PyArrow can open in the tasks; a path without a scheme is a file.
SCHEMES = ("file", "hdfs", "s3", "gs")


def _scheme(path: str) -> str:
    return path.split(":", 1)[0] if "://" in path or path.startswith("file:") else "file"


def opens(path: str) -> bool:
    """Whether tasks can open a path themselves."""
    return _scheme(path) in SCHEMES


def _open(path: str):
    """(file system, its own path) of a path or URI."""
    from pyarrow import fs

    if _scheme(path) == "file":
        plain = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + plain.lstrip("/") if plain.startswith("/") else plain
    return fs.FileSystem.from_uri(path)


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, whether it is a folder) of what lies in a folder."""
    from pyarrow import fs

    store, own = _open(folder)
    for e in store.get_file_info(fs.FileSelector(own, recursive=False, allow_not_found=True)):
        yield folder.rstrip("/") + "/" + e.base_name, e.size or 0, e.type == fs.FileType.Directory


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below root, empty ones and hidden ones too. Folders are listed in tasks, level by level; the
    driver learns only how many folders a level has. Contents aren't read.

    In a store that PyArrow can't open (SCHEMES) Spark's own listing is used, which leaves out empty and hidden files. A root that
    doesn't exist has no files there.
    """
    if not opens(root):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for folder in b.column(0).to_pylist():
                for entry in _entries(folder):
                    held.append(entry)
                    if len(held) == _BATCH:
                        yield _rows(held)
                        held = []
        yield _rows(held)

    level, n, found = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), 1, None
    while n:
        listed = stored(level.repartition(min(MOST_TASKS, -(-n // FOLDERS_A_TASK), _tasks(spark, n))).mapInArrow(run, "path string, length long, folder boolean"), "listing")
        files = listed.where(~F.col("folder")).select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = listed.where("folder").select("path")
        n = level.count()
    return found


def _tasks(spark: SparkSession, n: int, size: int = 0) -> int:
    """Tasks for n folders or small files of size bytes."""
    return max(TURNS * spark.sparkContext.defaultParallelism, -(-n // MANY), -(-size // BYTES_A_TASK))


def plain_names(path: Column, root: str) -> Column:
    """Whether Spark's readers would read a file below root: no part of its name begins with a dot, or with _ and has no =."""
    below = F.substring(path, len(root.rstrip("/")) + 1, 1 << 20)
    return ~below.rlike(r"/\.|/_[^=/]*(/|$)|\._COPYING_$")


def read_texts(files: DataFrame, n: int, size: int) -> DataFrame:
    """files (path and more; n of size bytes together) with text, the whole file in the encoding that JSON is found in; blank files
    are left out. Many small files are read by a task, where Spark's readers would list them on the driver and open few a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, held = [], [], 0
            for k, path in enumerate(b.column("path").to_pylist()):
                store, own = _open(path)
                with store.open_input_stream(own) as found:
                    raw = found.read()
                text = raw.decode(json.detect_encoding(raw), "replace")
                if text.strip(" \t\r\n"):
                    at.append(k)
                    texts.append(text)
                    held += len(text)
                if held >= _TEXT:
                    yield taken(b, at, texts)
                    at, texts, held = [], [], 0
            yield taken(b, at, texts)

    def taken(b: pa.RecordBatch, at: list[int], texts: list[str]) -> pa.RecordBatch:
        rows = b.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.repartition(_tasks(files.sparkSession, n, size), "path").mapInArrow(run, f"{fields}, text string")


def read_lines(files: DataFrame, n: int, size: int) -> DataFrame:
    """files (path and more; n of size bytes together) with line, one row a line, however many small files there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lines, held = [], [], 0
            for k, path in enumerate(b.column("path").to_pylist()):
                store, own = _open(path)
                with store.open_input_stream(own) as found:
                    for line in io.BufferedReader(found):
                        at.append(k)
                        lines.append(line.rstrip(b"\n"))
                        held += len(line)
                        if held >= _TEXT:
                            yield taken(b, at, lines)
                            at, lines, held = [], [], 0
            yield taken(b, at, lines)

    def taken(b: pa.RecordBatch, at: list[int], lines: list[bytes]) -> pa.RecordBatch:
        rows = b.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(lines, pa.binary())], [*rows.schema.names, "line"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    read = files.repartition(_tasks(files.sparkSession, n, size), "path").mapInArrow(run, f"{fields}, line binary")
    return read.withColumn("line", F.col("line").cast("string"))


def folder_of(name: str, value: Column) -> Column:
    """name=value, escaped as Spark's writers name the folder of a partition."""
    escaped = value
    for x in "%" + "".join(map(chr, range(1, 32))) + "\"#'*/:=?\\\x7f{[]^":
        escaped = F.replace(escaped, F.lit(x), F.lit(f"%{ord(x):02X}"))
    return F.concat(F.lit(f"{name}="), F.coalesce(F.nullif(escaped, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")))


def write_folders(rows: DataFrame, root: str, replace: bool = False) -> None:
    """Writes rows (folder, line; a task's rows of a folder beside each other) to files root/folder/part-*.json in tasks, however many
    folders there are. A task writes its files to one hidden folder, and they are moved to their own when all are there; only
    what tasks that succeeded have written is moved, and a move that is tried again goes on. With replace a folder loses what it had."""
    run_id = uuid.uuid4().hex
    hidden = f"{root.rstrip('/')}/_staging-{run_id}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at, out, done, n = TaskContext.get(), None, None, [], 0
        store, top = _open(f"{hidden}/{task.partitionId():05d}-{task.taskAttemptId()}")
        store.create_dir(top, recursive=True)
        for b in batches:
            for folder, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if folder != at:
                    if out:
                        out.close()
                    at, n = folder, n + 1
                    out = store.open_output_stream(f"{top}/{n}")
                    done.append((folder, f"{top}/{n}", f"part-{task.partitionId():05d}-{n}-{run_id}.json"))
                out.write(line.encode() + b"\n")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["folder", "source", "name"])
            done = []
        if out:
            out.close()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, own = _open(root.rstrip("/"))
        there = lambda path: store.get_file_info(path).type == fs.FileType.File
        for b in batches:
            for folder, files in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names = {x["name"] for x in files}
                store.create_dir(f"{own}/{folder}", recursive=True)
                for e in store.get_file_info(fs.FileSelector(f"{own}/{folder}")) if replace else []:
                    if e.type == fs.FileType.File and e.base_name not in names:
                        store.delete_file(e.path)
                for x in files:
                    if there(x["source"]):
                        store.move(x["source"], f"{own}/{folder}/{x['name']}")
                    elif not there(f"{own}/{folder}/{x['name']}"):
                        raise FileNotFoundError(x["source"])
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    written = stored(rows.select("folder", "line").mapInArrow(write, "folder string, source string, name string"), "written")
    parts = _tasks(rows.sparkSession, written.count())
    moved = written.repartition(parts, "folder").groupBy("folder").agg(F.collect_list(F.struct("source", "name")).alias("files"))
    moved.mapInArrow(move, "n long").agg(F.sum("n")).collect()
    store, top = _open(hidden)
    store.create_dir(top, recursive=True)
    store.delete_dir(top)


def _rows(entries: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    columns = list(zip(*entries, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["path", "length", "folder"])


def write_named(files: DataFrame, root: str) -> None:
    """Writes each row of files (name, content binary) as root/name, in tasks. A task that runs again writes the same files anew;
    of rows with one name one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, own = _open(f"{root.rstrip('/')}/{name}")
                store.create_dir(own.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(own) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    files.select("name", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def number_lines(scan: DataFrame, kept: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of a scan of text or CSV files that kept holds for, with row_number and in_file; the splits with their counts n).

    row_number counts from 1 over all files in the order of their paths, in_file within the file; neither moves a row. A file
    may be read in splits by several tasks: rows come in order within a split, so a count per split, and the sums of the counts
    before it, give the numbers. There are as many counts as splits, which the driver lists in any case.
    """
    rows = scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    rows = (rows if kept is None else rows.where(kept)).withColumn("__id", F.monotonically_increasing_id())
    counts = rows.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
    splits = starts_of(counts, ["__file", "__start"]).withColumnRenamed("before", "__before")
    splits = stored(starts_of(splits, ["__start"], ["__file"]).withColumnRenamed("before", "__inside"), "splits")
    place = F.col("__id") - F.col("__first") + 1
    numbered = rows.join(splits.drop("n"), ["__file", "__start"]).withColumns({"row_number": F.col("__before") + place, "in_file": F.col("__inside") + place})
    return numbered.drop("__file", "__start", "__id", "__first", "__before", "__inside"), splits
