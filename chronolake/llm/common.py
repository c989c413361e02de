"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.model import table
from ..plans.shared import cut, drop, opened, scratch, shared_dir, small_batches

__all__ = ["cut", "drop", "opened", "scratch", "shared_dir", "small_batches", "table", "utf8"]


def utf8(column: str = "text"):
    """Bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
