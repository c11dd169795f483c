"""History truncation (H1-H3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.bounds import one_row
from graphwarden.operators.repair import delete_vertices

DAY_MS = 86_400_000
# Truncation modes and the default window in days.
LOG_ONLY, DELETE_AND_LOG, SILENT_DELETE = "LOG_ONLY", "DELETE_AND_LOG", "SILENT_DELETE"
DEFAULT_WINDOW_DAYS = 999


def history_cutoff(now_ms: int, days: int = DEFAULT_WINDOW_DAYS) -> int:
    """H1: rows that ended before this are history; no positive window means now."""
    return now_ms if days <= 0 else now_ms - days * DAY_MS


def _ended(cutoff: int):
    return F.col("end_ts").isNotNull() & (F.col("end_ts") < cutoff)


def truncate_counts(v: DataFrame, e: DataFrame, cutoff: int) -> DataFrame:
    """H2: one row of candidate counts."""
    one = lambda df, name: df.where(_ended(cutoff)).agg(F.count("*").alias(name))
    return one_row(one(v, "n_vertices"), one(e, "n_edges"))


def truncate_history(
    v: DataFrame, e: DataFrame, cutoff: int, mode: str = LOG_ONLY
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """H3: (vertices, edges, log).  Edges go first, then vertices with whatever edges they still have."""
    if mode not in (LOG_ONLY, DELETE_AND_LOG, SILENT_DELETE):
        raise ValueError(f"unknown mode {mode}")
    log = e.where(_ended(cutoff)).select(F.lit("edge").alias("kind"), F.col("eid").alias("id"), "end_ts").unionByName(
        v.where(_ended(cutoff)).select(F.lit("vertex").alias("kind"), F.col("vid").cast("string").alias("id"), "end_ts"))
    if mode == SILENT_DELETE:
        log = log.where(F.lit(False))
    if mode == LOG_ONLY:
        return v, e, log
    old = v.where(_ended(cutoff)).select("vid")
    _, e2 = delete_vertices(v, e.where(~_ended(cutoff)), old)
    return v.where(~_ended(cutoff)), e2, log
