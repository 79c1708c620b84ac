"""Numbered lines and line-local rules (A2, D4, E4).  Narrow: no shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import text


def lines(files: DataFrame, key: str = "file_id", code: str = "code") -> DataFrame:
    """``(key, line, text)``, numbered from 1."""
    return files.select(
        key, F.posexplode(text.split_lines(F.col(code))).alias("pos", "text")
    ).select(key, (F.col("pos") + 1).alias("line"), "text")


def secrets(files: DataFrame, language, key: str = "file_id", code: str = "code") -> DataFrame:
    """``(key, line)`` of every line that looks like a hard-coded secret."""
    return files.select(
        key, F.explode(text.secret_lines(F.col(code), language)).alias("line")
    )
