"""Tables written to the folder all executors share, and their removal."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.shared import delete, delete_at_exit, fresh, shared_dir

__all__ = ["Scratch", "fresh", "release", "shared_dir", "table", "written"]


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors.

    The result may be read at any time later, so its folder goes when the driver ends.
    """
    out, path = _write(df, name)
    delete_at_exit(df.sparkSession, path)
    return out


class Scratch:
    """Tables that only the steps inside a with-block read: removed at its end, also where a step fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, {}, []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes one table early; df is what written() gave."""
        delete(self.spark, self.paths.pop(id(df))[1])

    def __exit__(self, *_) -> None:
        for _, path in self.paths.values():
            delete(self.spark, path)
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.paths, self.names = {}, []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, whose results are written tables by now.

    Spark drops them once its driver has collected the plans, so this asks for a collection: tenths of a second a step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
