"""Small tables with real size statistics, and tables written to shared storage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import _parse_datatype_string

from kotonoha.session import scratch_dir


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table Spark knows the size of, so that it may choose by size
    to broadcast it (an RDD-backed frame has no size)."""
    names = _parse_datatype_string(schema).fieldNames()
    data = pa.Table.from_pylist([dict(zip(names, r)) for r in rows]) if rows else None
    if data is None:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(data).selectExpr(
        *[f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in _parse_datatype_string(schema)]
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Used where a result feeds several consumers or a join whose strategy
    should be chosen by its true size.  Survives executor loss.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    For rows that were exploded or read back from well-packed files: Spark's estimate does not know their number, and a
    side it takes for small would be gathered on the driver.
    """
    return df.hint("merge")
