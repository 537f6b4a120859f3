"""Helpers shared by the corpus operators: shared storage, checked broadcasts, arrow columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="barline-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that neither a lost executor nor reuse recomputes it.

    A checkpoint inherits its plan's estimate of size, and a join's is the product of both sides': over rounds of joins
    the digits of that number grow exponentially and fill the driver's memory. So the estimate is left behind.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done, jvm = df.checkpoint(eager=True), spark._jvm
    plan, none = done._jdf.queryExecution().analyzed(), jvm.scala.Option.empty()
    plain = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plain), spark)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if a count shows at most max_rows rows; else df for an ordinary shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


DEALT = 1000


def dealt_join(rows: DataFrame, groups: DataFrame, keys: list[str], by: str, how: str = "inner", dealt: int | None = None) -> DataFrame:
    """rows joined with groups, one row a key, whose column `count` has the number of rows of the key in rows.

    A key of more than `dealt` rows goes to several tasks, by the hash of the rows' column `by`. There is at most one
    such key for every `dealt` rows, so the list of them, which is broadcast, is small beside the rows.
    """
    dealt = dealt or DEALT
    part, parts = fresh(rows.join(groups.limit(0), keys), "part", "parts")
    hot = cut(groups.where(F.col("count") > dealt).select(*keys, F.ceil(F.col("count") / dealt).cast("int").alias(parts)))
    n = F.coalesce(parts, F.lit(1))
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn(part, F.pmod(F.xxhash64(by), n).cast("int")).drop(parts)
    groups = groups.drop("count").join(F.broadcast(hot), keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    return rows.join(groups, [*keys, part], how).drop(part)


def one_of_each(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each id: of the smallest text, and of those by the other columns' hash."""
    (place,) = fresh(rows, "place")
    others = [c for c in rows.columns if "map<" not in rows.schema[c].dataType.simpleString()]
    order = W.partitionBy(id_col).orderBy(text_col, F.xxhash64(*[f"`{c}`" for c in others]))
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def raw(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    """Column i of strings as UTF-8 bytes."""
    return batch.column(i).cast(pa.binary()).to_pylist()


ROWS_AT_ONCE = 2000
_HELD: dict = {}


def chain(*steps):
    """Functions on batches, one after another, as one: a task then needs one Python worker."""

    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return run


def slices(batches, rows: int = ROWS_AT_ONCE):
    """The rows of batches in smaller ones, so that what a worker makes of a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    trim()


def trim() -> None:
    """Give freed memory back to the system: a worker lives on after its task and would keep the peak of all its tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def held(owner: str, key: str, make):
    """What a worker keeps from one task to the next under a key; it keeps the things of one owner at a time."""
    if _HELD.get("owner") != owner:
        _HELD.clear()
        gc.collect()
        trim()
        _HELD["owner"] = owner
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows that no classifier learns from: crc32 of the id as text mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
