"""What the corpus operators share: words and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcraft.functions.scratch import drop_scratch, materialise, scratch_dir

__all__ = ["WORD", "drop_scratch", "materialise", "scratch_dir", "table", "to_every_task", "words"]

#: A word is a run of anything but the six ASCII white-space characters. In
#: Python ``bytes.split()`` cuts UTF-8 at exactly those.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def to_every_task(df: DataFrame, label: str, most_rows: int) -> DataFrame:
    """A table computed once, marked for broadcast if it is small enough.

    Its rows are counted; above ``most_rows`` it is joined like any other, and
    Spark splits a skewed side.
    """
    found = materialise(df, label)
    return F.broadcast(found) if found.count() <= most_rows else found
