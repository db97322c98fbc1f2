"""Writers: CSV export, append-only tables, partition overwrite; stored aggregates are refreshed in versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import csv_cell
from quarry.operators.relational import bounded
from quarry.sources.versions import refresh

__all__ = ["append", "export_rows", "overwrite_partitions", "refresh", "write_csv"]
# Columns of the export.
EXPORT = ("asset_id", "cnj_number", "debtor_name", "debtor_type", "nature", "lifecycle_status", "exercise_year", "face_value", "updated_value", "final_score", "created_at")


def export_rows(df: DataFrame, order: Sequence[Column], limit=None, columns: Sequence[str] = EXPORT) -> DataFrame:
    """The first rows of an export, 1 to 50,000, 10,000 without a limit, as one line of quoted cells each."""
    n = bounded(limit, 1, 50_000, 10_000)
    return df.orderBy(*order).limit(n).select(F.concat_ws(",", *(csv_cell(c) for c in columns)).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Adds rows to a Parquet table; existing files are never changed."""
    (df.write.partitionBy(*partition) if partition else df.write).mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Replaces just the partitions that df has rows of."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(*partition).mode("overwrite").parquet(path)
