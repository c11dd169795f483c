"""Small Spark helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphwarden.functions.storage import configure, cut, discard, watched


#: rows that Python is handed at once; texts can be long, and workers keep what they once took
ARROW_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators rely on."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_groups(df: DataFrame, keys: list[str], make: Callable, schema: str) -> DataFrame:
    """``make(rows, bounds)`` over whole groups of ``keys``, where groups have a bounded size but may be many.

    One pass over partitions sorted by the keys; a group that ends a batch is carried into the next one.  ``make`` takes a
    frame of whole groups and the first row of each (and the end), and returns a frame or None.  For millions of small
    groups this spares the cost that a grouped map has for each.
    """
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frames):
            rows = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0].reset_index(drop=True)
            new = np.zeros(len(rows), bool)
            new[0] = True
            for k in keys:
                values = rows[k].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            return make(rows, np.append(np.flatnonzero(new), len(rows)))

        for batch in batches:
            if not len(batch):
                continue
            last = np.ones(len(batch), bool)
            for k in keys:
                last &= batch[k].to_numpy() == batch[k].iloc[-1]
            first = int(last.argmax())
            whole = []
            if first:
                whole, held = [*held, batch.iloc[:first]], []
            elif held and any(held[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys):
                whole, held = held, []
            if whole and (out := done(whole)) is not None:
                yield out
            held.append(batch.iloc[first:])
        if held and (out := done(held)) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(over, schema)


def cut_last(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What ``make`` returns as a written table, after which the tables that it wrote on the way are deleted."""
    with watched() as steps:
        made = make()
    out = cut(made, name)
    discard(*steps, spark=spark)
    return out


def rows_like(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns: extra columns, also with clashing names, never reach an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: bits of the filter in front of a join, kept as at most this many / 64 rows, whatever the tables' sizes
FILTER_BITS = 1 << 23


def bitmap(wanted: DataFrame, column: str) -> np.ndarray:
    """Bits of the values (longs) of ``column`` modulo ``FILTER_BITS``, for ``among``.

    Words of 64 bits are put together before they are collected: 1 MB and ``FILTER_BITS / 64`` rows at most, whatever the table.
    """
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = wanted.where(F.col(column).isNotNull()).select(bit.alias("bit")).selectExpr(
        "cast(floor(bit / 64) AS int) AS word", "shiftleft(1L, cast(bit % 64 AS int)) AS mask").groupBy("word").agg(
        F.bit_or("mask").alias("mask"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        bits[row["word"]] = row["mask"]
    return bits.view(np.uint64)


def among(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each long may be one of those in the bitmap; never false for one that is."""
    bit = (values % FILTER_BITS).astype(np.uint64)
    return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def apart(df: DataFrame, key: str, wanted: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` may be among ``wanted[column]``, and those whose key surely isn't.

    A bitmap of hashed keys, grouped into words, is joined by broadcast: its size has a fixed bound.  Only the first part
    needs to be shuffled to meet ``wanted``; where the bitmap is full, that is everything.  Null keys are in the second part.
    """
    bit = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    words = wanted.where(F.col(column).isNotNull()).select(bit.alias("__bit")).selectExpr(
        "floor(__bit / 64) AS __word", "shiftleft(1L, cast(__bit % 64 AS int)) AS __mask").groupBy("__word").agg(
        F.bit_or("__mask").alias("__mask"))
    marked = df.withColumn("__bit", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(FILTER_BITS))).withColumn(
        "__word", F.expr("floor(__bit / 64)")).join(F.broadcast(words), "__word", "left").withColumn(
        "__may", F.expr("coalesce(shiftright(__mask, cast(__bit % 64 AS int)) & 1, 0) = 1") & F.col(f"`{key}`").isNotNull())
    names = [F.col(f"`{c}`") for c in df.columns]
    return marked.where("__may").select(*names), marked.where("NOT __may").select(*names)
