"""Folder scans: listing, classes, checksums, decoded text, report and catalogue pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import rules as R
from folioframe.keeping import kept

ENCODINGS = ["utf-8", "utf-8-sig", "cp1258", "cp1252"]


def classified(files: DataFrame) -> DataFrame:
    """binaryFile rows with file_name, file_ext, scan_class: ignored before accepted or unsupported."""
    df = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    low = F.lower("file_name")
    ext = F.regexp_extract(low, r"\.([^.]+)$", 1)
    ignored = F.startswith(low, F.lit("~$")) | (low == "desktop.ini") | ext.isin("tmp", "lock")
    return df.withColumn("file_ext", ext).withColumn("scan_class", F.when(ignored, "ignored").when(ext.isin(R.ACCEPTED_EXTENSIONS), "accepted").otherwise("unsupported"))


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_name, file_ext, modificationTime, length, content, scan_class) of every file below root."""
    return classified(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))


def with_checksum(files: DataFrame) -> DataFrame:
    return files.withColumn("checksum", F.sha2("content", 256))


def decoded(files: DataFrame) -> DataFrame:
    """files with read.text, read.encoding, read.status (read, need_ocr, unsupported, failed), read.error: the first encoding that reads the bytes; other formats are unsupported.

    One projection: UTF-8 is read in the JVM, and only texts that are none go to Python.
    """

    @F.pandas_udf("text string, encoding string, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            rows = []
            for raw in contents:
                row = (None, None, None if raw is None else "no encoding reads the bytes")
                for encoding in ENCODINGS if raw is not None else ():
                    try:
                        row = (bytes(raw).decode(encoding), encoding, None)
                        break
                    except UnicodeDecodeError:
                        continue
                rows.append(row)
            yield pd.DataFrame(rows, columns=["text", "encoding", "error"])

    plain, is_text = F.col("content").cast("string"), F.col("file_ext") == "txt"
    utf8 = is_text & F.coalesce(F.is_valid_utf8(plain), F.lit(False))
    other = files.withColumn("__r", read(F.when(is_text & ~utf8, F.col("content"))))
    none = F.lit(None).cast("string")
    status = F.when(~F.coalesce(is_text, F.lit(False)), "unsupported").when(utf8 | F.col("__r.encoding").isNotNull(), "read").otherwise("failed")
    error = F.when(F.col("content").isNull() & is_text, "no content").otherwise(F.col("__r.error"))
    out = F.struct(
        F.when(utf8, plain).otherwise(F.col("__r.text")).alias("text"), F.when(utf8, "utf-8").otherwise(F.col("__r.encoding")).alias("encoding"), status.alias("status"), F.when(status == "failed", error).otherwise(none).alias("error")
    )
    return other.withColumn("read", out).drop("__r")


def scan_report(states: DataFrame) -> DataFrame:
    """One row of counts over scan_class and state."""
    n = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return states.agg(F.count(F.lit(1)).alias("total"), *(n("scan_class", v) for v in ("accepted", "ignored", "unsupported")), *(n("state", v) for v in ("new", "changed", "existing")))


def index_files(found: DataFrame, catalogue: DataFrame, read=decoded) -> tuple[DataFrame, DataFrame]:
    """(new catalogue, states of the found files): accepted files (with content and checksum) are read where new or changed, their metadata extracted, copies marked, and all overlaid.

    A file that has the checksum of another path is a row of its own with status duplicate.
    read: files -> files with a struct read, as `decoded`.
    """
    from folioframe.operators import catalog as C
    from folioframe.operators.structure import extracted_metadata

    states = C.scan_states(found, catalogue)
    fresh = kept(read(states.where("state <> 'existing'")).drop("content"))
    states = states.drop("content")
    meta = extracted_metadata(fresh.select(F.col("path").alias("doc_id"), "file_name", F.col("read.text").alias("text"))).withColumnRenamed("doc_id", "path")
    dup = C.duplicates(fresh.select("path", "checksum"), catalogue.select("id", "file_path", "checksum"))
    rows = fresh.select("path", "file_name", "file_ext", "checksum", F.col("length").alias("file_size"), F.col("read.status").alias("s")).join(meta, "path").join(dup.drop("checksum"), "path")
    status = F.when(F.col("is_duplicate"), "duplicate").otherwise(C.status_of_reading(F.col("s")))
    rows = rows.select(
        F.col("path").alias("file_path"), "file_name", "file_ext", "file_size", "checksum", "title", "document_type", "document_number", "issued_date", "issuing_agency", "signer",
        F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("duplicate of "), F.col("duplicate_of").cast("string"))).otherwise(F.col("summary")).alias("summary"),
        F.array_join("keywords", ", ").alias("keywords"), "field", status.alias("status"),
    )
    # A deleted file that is back, changed or not, lives again.
    back = states.where("state = 'existing'").select(F.col("path").alias("file_path")).join(catalogue.where("status = 'deleted'").select("file_path"), "file_path").withColumn("status", F.lit("need_review"))
    return C.upsert(C.upsert(catalogue, rows, "file_path"), back, "file_path"), states


def index_folder(spark: SparkSession, root: str, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new catalogue, counts per status): scan, read, extract, find duplicates, overlay, mark missing files deleted."""
    from folioframe.operators import catalog as C

    new, states = index_files(with_checksum(scan_folder(spark, root).where("scan_class = 'accepted'")), catalogue)
    gone = C.missing(catalogue, states, root).select("file_path", F.lit("deleted").alias("status"))
    new = C.upsert(new, gone, "file_path")
    return new, C.counts_by(new, "status")
