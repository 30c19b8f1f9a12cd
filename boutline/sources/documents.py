"""Landed JSON documents (one document per file, plain or gzip) and their rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_documents(spark: SparkSession, path: str | list[str], schema: str, per_line: bool = False) -> DataFrame:
    """Documents under `path` with an explicit schema, one per file (or per line, for compacted
    landing files); `document` is the file each came from. Unreadable documents keep their text
    in `_corrupt_record`."""
    reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", not per_line)
    docs = reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return docs.select("*", F.col("_metadata.file_path").alias("document"), F.col("_metadata.file_modification_time").alias("fetched"))


def stream_documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """The same documents as a stream: each landed file is read once."""
    reader = spark.readStream.schema(f"{schema}, {CORRUPT} string").option("multiLine", True)
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files_per_batch)
    docs = reader.json(path)
    return docs.select("*", F.col("_metadata.file_path").alias("document"), F.col("_metadata.file_modification_time").alias("fetched"))


# kind/part=value/name: the folder and the name up to the first dot or @ tell what a document answers.
PLACE = r"([^/]+)/(\w+)=(\w+)/([^/@.]+)[^/]*$"


def slot_of(document: F.Column) -> F.Column:
    """Kind and part of a landed document as one word (`pbp-season-2029`); empty off the layout."""
    place = [F.regexp_extract(document, PLACE, i) for i in (1, 2, 3)]
    return F.when(place[0] == "", "").otherwise(F.concat_ws("-", *place))


def name_of(document: F.Column) -> F.Column:
    return F.regexp_extract(document, PLACE, 4)


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(document, fetched, bytes) of the files under `paths`; no file is opened, since no content is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select(
        F.col("_metadata.file_path").alias("document"),
        F.col("_metadata.file_modification_time").alias("fetched"),
        F.col("_metadata.file_size").alias("bytes"),
    )


def read_texts(spark: SparkSession, paths: list[str], since: int) -> DataFrame:
    """Whole texts (plain or gzip) of the files under `paths` changed at or after `since` (microseconds);
    older files are left out when the scan is planned."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(paths)
    texts = texts.where(F.col("_metadata.file_modification_time") >= F.timestamp_micros(F.lit(since)))
    return texts.select(
        F.col("_metadata.file_path").alias("document"),
        F.col("_metadata.file_modification_time").alias("fetched"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("value").alias("payload"),
    )


def parse_texts(texts: DataFrame, schema: str) -> DataFrame:
    """Stored texts (document, fetched, payload) in the form `read_documents` gives files."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("payload", f"{schema}, {CORRUPT} string", options)
    return texts.select(parsed.alias("__doc"), "document", "fetched").select("__doc.*", "document", "fetched")


# A thing landed more than once counts as its newest document has it; files of one moment go by name.
ARRIVAL = ["fetched", "document"]


def newest_documents(docs: DataFrame, key: F.Column) -> DataFrame:
    """The newest document of each `key` (a request, a game); one without a key stays."""
    keyed = docs.withColumn("__key", key)
    newest = keyed.groupBy("__key").agg(F.max(F.struct(*ARRIVAL)).alias("m")).select("__key", F.col("m.document").alias("document"))
    return keyed.join(newest, ["__key", "document"], "left_semi").drop("__key").unionByName(docs.where(key.isNull()))


def readable(docs: DataFrame, required: str) -> DataFrame:
    return docs.where(F.col(CORRUPT).isNull() & F.col(required).isNotNull())


def rejected(docs: DataFrame, required: str) -> DataFrame:
    """Documents that cannot be parsed, with the reason."""
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed JSON").otherwise(F.lit(f"missing {required}"))
    return docs.where(F.col(CORRUPT).isNotNull() | F.col(required).isNull()).select("document", reason.alias("error"))


def outcomes(docs: DataFrame, required: str, task_key: F.Column, rows: F.Column) -> DataFrame:
    """One ledger mark per document: rows loaded, or why it failed."""
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed JSON").when(
        F.col(required).isNull(), F.lit(f"missing {required}")
    )
    return docs.select(
        task_key.alias("task_key"),
        F.when(reason.isNull(), "success").otherwise("failed").alias("status"),
        F.when(reason.isNull(), rows).cast("long").alias("rows"),
        reason.alias("error"),
    )
