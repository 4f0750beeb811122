"""Readers of manifests, the seat directory, OCR responses and pages, diagnostics, and listings of recordings and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatescan.functions import text as X
from gatescan.operators.directory import parse_directory_row
from gatescan.operators.evaluation import ALIASES, coalesce_aliases, require_image
from gatescan.schemas import DIAGNOSTIC, RESPONSE
from gatescan.sources.files import list_files, number_lines, opens, plain_names, read_lines

#: The headers that a seat directory may have, and the message about others. Fixed values.
HEADERS = ("Seat No,Name", "Seat No,Chinese Name")
_EMPTY, _UNEXPECTED, _EXPECTED = "names.csv is empty", "Unexpected names.csv header: ", ". Expected Seat No,Name"
#: The keys of a JSON manifest that may hold its cases. Fixed values.
_LISTS = ("cases", "images", "records")
_BOM = "﻿"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", f"^{_BOM}", "").alias("value"))


def _json_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Each case as a row of strings. Values keep the text they have in JSON; the file is one JSON value, read whole."""
    names = [n for group in ALIASES.values() for n in group]
    text = _whole(spark, path).withColumn("value", F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")))
    list_of = [F.nullif(F.get_json_object("value", f"$.{k}"), F.lit("[]")) if k != _LISTS[-1] else F.get_json_object("value", f"$.{k}") for k in _LISTS]
    found = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.coalesce(*list_of))
    message = "JSON manifest must be a list or an object with a cases/images/records list"
    cases = F.when(found.startswith("["), F.from_json(found, "array<string>")).otherwise(F.raise_error(F.lit(message)).cast("array<string>"))
    rows = text.select(F.posexplode(cases).alias("k", "case"))
    schema = ", ".join(f"`{n}` string" for n in names)
    return rows.select((F.col("k") + 1).alias("row_number"), F.from_json("case", schema).alias("c")).select("row_number", "c.*")


def _delimited_manifest(spark: SparkSession, path: str, delimiter: str, multiline: bool) -> DataFrame:
    df = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=multiline, encoding="UTF-8")
    numbered = number_lines(df)[0].drop("in_file")
    return numbered.toDF(*[c.removeprefix(_BOM) for c in numbered.columns])


def read_manifest(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """image, expected_name, expected_seat (and row_number) from a .json, .csv or .tsv file; relative images are taken from its
    folder. In JSON the first of cases, images and records that isn't empty counts. A row without an image is an error.

    Quoted values of a CSV or TSV file may hold line ends, so one task reads a file; with multiline=False they may not, and a large
    file is read in splits. Rows are numbered over several files (a folder with such a name) in the order of their paths."""
    suffix = path.rsplit(".", 1)[-1].casefold() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix == "json":
        cases = coalesce_aliases(_json_manifest(spark, path))
    elif suffix in ("csv", "tsv"):
        cases = coalesce_aliases(_delimited_manifest(spark, path, "\t" if suffix == "tsv" else ",", multiline), first_present=True)
    else:
        raise ValueError("Manifest must be .json, .csv, or .tsv")
    return require_image(cases).withColumn("image", X.resolve_path(F.col("image"), path.rsplit("/", 1)[0] if "/" in path else "."))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """line_no, seat, name of a seat directory. Quotes are plain characters and only the first comma splits. Each file begins with
    its header; no line at all, or an unknown header in any file, is an error.

    Lines that aren't blank are numbered over the splits of a file, and over several files in the order of their paths, so the
    line order that decides between equal names is kept whatever the size."""
    line = X.strip(F.regexp_replace("value", f"^{_BOM}", ""))
    rows, splits = number_lines(spark.read.option("lineSep", "\n").text(path).withColumn("value", line), F.col("value") != "")
    other = F.raise_error(F.concat(F.lit(_UNEXPECTED), F.col("value"), F.lit(_EXPECTED))).cast("boolean")
    rows = rows.where(F.when(F.col("in_file") > 1, True).when(F.col("value").isin(*HEADERS), False).otherwise(other))
    # no line gives no row at all, so their number goes through an aggregate, which always gives one
    total = splits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_number"))
    none = total.withColumn("value", F.when(F.col("row_number") == 0, F.raise_error(F.lit(_EMPTY)).cast("string")).otherwise(""))
    parsed = rows.select("row_number", "value").unionByName(none).select(F.col("row_number").alias("line_no"), parse_directory_row(F.col("value")).alias("r"))
    return parsed.where("r is not null").select("line_no", "r.seat", "r.name")


def read_responses(spark: SparkSession, path: str, stream: bool = False, lines: bool = True, files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """One row per response document: a JSON object a line, or with lines=False (batch only) one document a file, over as many
    lines as it has. results stays JSON text. source is the file's path. files_per_batch or bytes_per_batch (such as "256m") bound
    a stream's micro-batches, and with them the memory of what is done with them."""
    if stream:
        reader = spark.readStream.schema(RESPONSE)
        for name, value in (("maxFilesPerTrigger", files_per_batch), ("maxBytesPerTrigger", bytes_per_batch)):
            reader = reader if value is None else reader.option(name, value)
        return reader.json(path).withColumn("source", F.col("_metadata.file_path"))
    return spark.read.schema(RESPONSE).json(path, multiLine=not lines).withColumn("source", F.col("_metadata.file_path"))


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source and pages (array of variants, each a page of either shape) of stored OCR output, one file a frame and stage; with
    lines=True one document a line, with row_number over all files. A document is parsed once; what is no JSON has no pages."""
    if lines:
        scan = spark.read.option("lineSep", "\n").text(path).withColumn("source", F.col("_metadata.file_path"))
        text = number_lines(scan)[0].select("source", "row_number", "value")
    else:
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value"))
    document = F.try_parse_json("value")
    pages = F.coalesce(F.try_variant_get(document, "$", "array<variant>"), F.when(document.isNotNull(), F.array(document)), F.array().cast("array<variant>"))
    return text.withColumn("pages", pages).drop("value")


def read_diagnostics(spark: SparkSession, root: str, files: str = "try_*/diag.json") -> DataFrame:
    """The records of a diagnostics folder (try_NNNN/diag.json) with attempt_no from the folder's name; no schema inference."""
    df = spark.read.schema(DIAGNOSTIC).option("multiLine", True).json(f"{root}/{files}")
    return _dated(df.withColumn("attempt_no", X.attempt_number(F.col("_metadata.file_path"))))


def read_written(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Records that write_diagnostics() has written, of a schema given, with the date of their folders. Files are listed and read
    in tasks, as there may be a folder or more for each date."""
    if not opens(root):
        return spark.read.schema(f"{schema}, date string").json(root)
    path = F.col("path")
    files = list_files(spark, root).where(plain_names(path, root) & path.endswith(".json"))
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
    named = F.regexp_extract("path", "/date=([^/]*)/", 1)
    date = F.when(named != "__HIVE_DEFAULT_PARTITION__", F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B"))))
    rows = read_lines(files, total.n, total.size)
    return rows.select(F.from_json("line", schema).alias("r"), date.alias("date")).select("r.*", "date")


def _dated(df: DataFrame) -> DataFrame:
    signed = F.regexp_replace("timestamp_utc", "^([0-9]{5,}-)", "+$1")  # as the pattern has years beyond 9999
    return df.withColumn("timestamp", F.to_timestamp(signed, "yyyy-MM-dd'T'HH:mm:ssX"))


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """What compact_diagnostics() has written, as read_diagnostics() gives it."""
    return _dated(spark.read.schema(f"{DIAGNOSTIC}, attempt_no int").parquet(path))


def list_audio(spark: SparkSession, root: str) -> DataFrame:
    """seat, path, length of every recording below root, empty ones too; the seat is the file's name. Contents aren't read."""
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    return list_files(spark, root).where(name != "").select(name.alias("seat"), "path", "length")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """image (path without scheme and host), length of every file below root, whatever its suffix, empty ones too. Contents aren't read."""
    return list_files(spark, root).select(X.plain_path(F.col("path")).alias("image"), "length")
