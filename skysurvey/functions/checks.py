"""Values that carry a condition."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def checked(ok: Column, value: Column, message: str) -> Column:
    """The value; an error with the message where the condition is false or null."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))
