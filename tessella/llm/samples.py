"""Bounded training samples from the rows that may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, most_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and y (0 or 1) of at most `most` labelled rows of each class that are not held out, in the order of a hash of the id.

    Only the chosen ids (most of each class) reach the driver. most_chars leaves longer texts out of the sample.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).na.drop().where(~held_out())
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most).collect()]
    chosen = spark.createDataFrame(chosen, "doc_id long, y int").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if most_chars is not None:
        texts = texts.where(F.length("text") <= most_chars)
    return texts.join(F.broadcast(chosen), "doc_id")  # at most twice `most` rows
