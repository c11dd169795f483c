"""Dense row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphwarden.functions.storage import cut


def number_rows(df: DataFrame, order_cols: list[str], name: str = "rn", keep: list[str] | None = None) -> DataFrame:
    """Add ``name`` = 1..n in the order of ``order_cols``.

    The rows are range-partitioned and written once; the offsets come from one
    row per partition.  Rows equal on ``order_cols`` are spread by a tie-break,
    so a value held by a third of all rows still fills many partitions.  ``keep`` names the columns to go on with (all, if
    not given); the others only decide the order and are not written.

    Precondition where a retry must give equal rows the same numbers: ``df``
    comes straight from a scan or a written table, whose order is stable.
    """
    # position in the scan: stable under task retries, needed only to split ties
    ranged = (
        df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*[F.col(c) for c in order_cols], F.col("_tie"))
        .sortWithinPartitions(*order_cols, "_tie")
        .select(*(keep or df.columns))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stage = cut(ranged, "numbered", compression="zstd")
    sizes = stage.groupBy("_part").agg((F.max("_pos") + 1).alias("_n"))
    # one row per range partition: bounded by the partition count, not by the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        stage.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_off")
    )
