"""Validation of rows before they are stored: each function adds reject_reason, null where a row is valid; the first rule that fails is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import rules as R


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def _first(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    return df.withColumn("reject_reason", F.coalesce(*(F.when(failed, F.lit(reason)) for failed, reason in rules)))


def library_documents(df: DataFrame, statuses=R.LIBRARY_STATUSES) -> DataFrame:
    """A blank title becomes the file name, a blank status new; the extension is lower-cased."""
    title, status = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("status", F.lit("")))
    df = df.withColumns({"title": F.when(title == "", F.trim("file_name")).otherwise(title), "status": F.when(status == "", "new").otherwise(status), "file_ext": F.lower(F.trim("file_ext"))})
    return _first(
        df, (_blank("file_name"), "file_name is required"), (_blank("file_path"), "file_path is required"), (F.col("file_size") < 0, "file_size is negative"),
        (_blank("checksum"), "checksum is required"), (~F.col("status").isin(statuses), "unknown status"),
    )


def entities(df: DataFrame) -> DataFrame:
    return _first(df, (_blank("entity_type"), "entity_type is required"), (_blank("entity_value"), "entity_value is required"), (F.coalesce(F.col("weight"), F.lit(0)) <= 0, "weight is not positive"))


def relations(df: DataFrame) -> DataFrame:
    s, t = F.col("source_id"), F.col("target_id")
    return _first(df, (s <= 0, "source_id is not positive"), (t <= 0, "target_id is not positive"), (s == t, "a document is related to itself"), (_blank("relation_type"), "relation_type is required"))


def templates(df: DataFrame, extensions=R.TEMPLATE_EXTENSIONS) -> DataFrame:
    """A blank extension is taken from the path; is_ready: name, path and an allowed extension are there."""
    own, path = F.lower(F.trim(F.coalesce("file_ext", F.lit("")))), F.trim(F.coalesce("source_path", F.lit("")))
    df = df.withColumn("file_ext", F.when(own == "", F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))).otherwise(own))
    known = F.col("file_ext").isin(extensions)
    df = df.withColumn("is_ready", ~_blank("name") & ~_blank("source_path") & known)
    return _first(df, (F.col("file_size") < 0, "file_size is negative"), ((F.col("file_ext") != "") & ~known, "unsupported extension"))


def uploads(df: DataFrame, extensions=R.TEMPLATE_EXTENSIONS, most: int = R.MAX_TEMPLATE_BYTES) -> DataFrame:
    """Rows (file_name, length): an allowed extension, 1 byte to the limit."""
    ext = F.lower(F.regexp_extract("file_name", r"(\.[^./]+)$", 1))
    return _first(df, (~ext.isin(extensions), "unsupported extension"), (F.col("length") <= 0, "empty file"), (F.col("length") > most, "file too large"))


def progress_updates(df: DataFrame) -> DataFrame:
    return _first(df, (_blank("content"), "content is required"), (~F.coalesce("progress", F.lit(0)).between(0, 100), "progress out of range"))
