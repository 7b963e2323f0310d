"""Text maps: blocks of `kind { name = value; }`, read by position and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(text: Column, kind: str) -> Column:
    """Bodies of all blocks of a kind, in order: their places are their ids."""
    return F.regexp_extract_all(text, F.lit(rf"\b{kind}\s*\{{([^}}]*)\}}"), F.lit(1))


def fields(body: Column) -> Column:
    """Names and values of a body."""
    clean = F.regexp_replace(F.trim(body), r"\s*;\s*$", "")
    return F.str_to_map(F.regexp_replace(clean, r"\s*([=;])\s*", "$1"), F.lit(";"), F.lit("="))


def read_blocks(maps: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """Each map's blocks of a kind: id and fields."""
    rest = [c for c in maps.columns if c != text_col]
    exploded = maps.select(*rest, F.posexplode(blocks(F.col(text_col), kind)).alias("id", "body"))
    return exploded.select(*rest, F.col("id").cast("long").alias("id"), fields(F.col("body")).alias("fields"))


def write_block(kind: str, **values: Column) -> Column:
    """One block as text; null fields are left out."""
    parts = [F.concat(F.lit(f" {k} = "), v.cast("string"), F.lit(";")) for k, v in values.items()]
    return F.concat(F.lit(f"{kind} {{"), F.concat_ws("", *parts), F.lit(" }"))


def fixed(value: Column, digits: int = 3) -> Column:
    """Decimal text that rounds halves to even, as C's printf does; the JVM's own formatter rounds them up."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))
