"""Helpers for Arrow-backed stages, and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.ship import ship
from pinweave.store import settle as stored

__all__ = ["kept_columns", "stored"]


def kept_columns(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Only the columns an operator reads, cast to their types; other columns, of whatever name, are left out."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in needed.items()])
