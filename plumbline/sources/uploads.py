"""Checks of uploaded files, over a table of their names, types, sizes and first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

LARGEST, WINDOW = 25 * 1024 * 1024, 1024
TYPES = ("application/pdf", "application/x-pdf", "application/octet-stream")


def files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files under a path with their content; larger ones than LARGEST are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).where(F.col("length") <= LARGEST)


def first_error(name: Column, content_type: Column, size: Column, head: Column) -> Column:
    """The first check that fails, or null: file name, size, extension, type, signature."""
    clean = T.sanitized_filename(name)
    kind = F.lower(F.trim(F.get(F.split(content_type, ";"), F.lit(0))))
    signature = F.position(F.lit("255044462D"), F.hex(F.substring(head, F.lit(1), F.lit(WINDOW))))
    return (
        F.when(clean.isNull(), "unsafe_filename")
        .when(size == 0, "empty_file")
        .when(size > LARGEST, "file_too_large")
        .when(~F.lower(clean).rlike(r"\.pdf$"), "unsupported_extension")
        .when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), "unsupported_mime_type")
        .when(signature % 2 != 1, "signature_mismatch")
    )
