"""Size checks in front of broadcasts and caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.storage import written

SMALL_ROWS = 10_000


def within(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; stops counting one row above it."""
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count was found to be small.

    The hint holds through a later select or filter; the count of a frame is
    taken once.
    """
    if getattr(df, "_within", None) is None:
        df._within = {}
    if limit not in df._within:
        df._within[limit] = within(df, limit)
    return F.broadcast(df) if df._within[limit] else df


def few(df: DataFrame, name: str = "few") -> DataFrame:
    """``df`` as a written table, with a broadcast hint if it turned out small.

    For a handful of ids or values against the whole graph: the graph is then
    scanned in place instead of being shuffled, and the frame is computed once.
    """
    return small(written(df, name))


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames side by side, without a cross join."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
