"""What the corpus operators have in common: tables in the shared folder, and lower case of A-Z alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.staging import dropped, new_path, shared_dir, written, written_within

__all__ = ["ascii_lower", "dropped", "new_path", "shared_dir", "written", "written_within"]

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """A-Z to a-z and nothing else; lower() alone would change other letters."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, ASCII_UPPER, ASCII_LOWER))
