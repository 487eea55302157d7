"""Journals of JSON lines: whole files in, operations and refusals out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.kernels.records import operation_rows


def read_journal(files: DataFrame, key: str = "path", text_col: str = "value") -> DataFrame:
    """key, seq (from 1), line, truncated, reason.

    A last line without its line end is a torn write: it is dropped, and the file's
    rows are flagged.  A blank or unreadable line before it refuses the file.
    """
    lines = F.split(text_col, "\n", -1)
    rows = files.select(key, (F.element_at(lines, -1) != "").alias("truncated"), F.slice(lines, 1, F.size(lines) - 1).alias("lines"))
    bad = F.exists("lines", lambda x: (F.trim(x) == "") | F.json_object_keys(x).isNull())
    checked = rows.withColumn("reason", F.when(bad, "blank or unreadable line"))
    kept = F.when(F.col("reason").isNull(), F.col("lines")).otherwise(F.array().cast("array<string>"))
    return checked.select(key, "truncated", "reason", F.posexplode_outer(kept).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("seq"), "line", "truncated", "reason")


def read_operations(files: DataFrame, key: str = "path", text_col: str = "value") -> DataFrame:
    """key, n, line, operation (canonical, defaults filled in), hash, truncated, reason: a journal whose every whole
    line is an operation; one that is not refuses the file, for a line that is skipped is a change that vanished."""
    lines = read_journal(files, key, text_col).withColumnRenamed(key, "key").withColumnRenamed("seq", "n")
    own = operation_rows(lines.where("line is not null")).select("key", "n", "operation", "hash", F.col("reason").alias("bad"))
    joined = lines.withColumn("key", F.col("key").cast("string")).join(own, ["key", "n"], "left")
    refused = joined.groupBy("key").agg(F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("n"))).alias("first_bad"))
    out = joined.join(refused, "key").withColumn("reason", F.coalesce("reason", "first_bad"))
    return out.select("key", "n", "line", "operation", "hash", "truncated", "reason")

