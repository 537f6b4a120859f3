"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators.structure import KEYS


def pipe_lines(bars: DataFrame) -> DataFrame:
    """value: bars as lines of a pipe log."""
    cols = ["open_price", "high_price", "low_price", "close_price", "volume", "open_interest", "turnover"]
    return bars.select(F.concat_ws("|", F.unix_millis("datetime").cast("string"), "symbol", "exchange", *[F.col(c).cast("string") for c in cols]).alias("value"))


def append_pipe_log(bars: DataFrame, path: str) -> None:
    pipe_lines(bars).write.mode("append").text(path)


def parquet_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table, overwritten, partitioned by timeframe and symbol."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").partitionBy("timeframe", "symbol").parquet(f"{path}/{name}")


def json_payload(payload: DataFrame, path: str) -> None:
    """A JSON document for each series."""
    payload.select(*KEYS, F.col("payload").alias("value")).write.mode("overwrite").partitionBy(*KEYS).text(path)


def console(stream: DataFrame, name: str):
    """A streaming query that prints decisions or metrics."""
    return stream.writeStream.format("console").outputMode("append").queryName(name)
