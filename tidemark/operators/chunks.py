"""Long ordered series in chunks, with what each chunk needs of the one before, so no series is one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(df: DataFrame, index: str, size: int, carry: int) -> DataFrame:
    """Adds chunk and own: the last carry rows (at most size) of a chunk come again at the head of the next one, with own false.

    index: a dense number from 0 within series_id. Windows over (series_id, chunk) then see carry rows before any own row.
    """
    at = F.floor(F.col(index) / size)
    both = F.when(F.col(index) % size >= size - carry, F.array(at, at + 1)).otherwise(F.array(at))
    return df.withColumn("chunk", F.explode(both)).withColumn("own", F.col("chunk") == at)
