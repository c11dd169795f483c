"""Filters and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.keys import blank, prop

MINUTE_MS = 60_000


def window_start(now_ms: int, minutes: int) -> int:
    """Start of the look-back window; 0 minutes means no window."""
    return 0 if minutes <= 0 else now_ms - minutes * MINUTE_MS


def window_filter_mod(v: DataFrame, now_ms: int, minutes: int) -> DataFrame:
    """rows modified at or after the window start, or without a time."""
    start = window_start(now_ms, minutes)
    return v.where(F.col("last_mod_ts").isNull() | (F.col("last_mod_ts") >= start)) if start else v


def window_filter_created(v: DataFrame, now_ms: int, minutes: int) -> DataFrame:
    """rows created strictly after the window start, or without a time."""
    start = window_start(now_ms, minutes)
    return v.where(F.col("created_ts").isNull() | (F.col("created_ts") > start)) if start else v


def parse_prop_filter(spec: str) -> list[tuple[str, str]]:
    """``p1|v1,p2|v2`` as pairs."""
    pairs = []
    for part in spec.split(","):
        bits = part.strip().split("|")
        if len(bits) != 2 or not bits[0]:
            raise ValueError(f"expected property|value, got {part!r}")
        pairs.append((bits[0], bits[1]))
    return pairs


def filter_props(v: DataFrame, spec: str) -> DataFrame:
    """all the property = value conditions of ``spec``."""
    for name, value in parse_prop_filter(spec):
        v = v.where(prop(name) == value)
    return v


def only_type(v: DataFrame, node_type: str) -> DataFrame:
    """one node type."""
    return v.where(F.col("node_type") == node_type)


def lookup_by_keys(v: DataFrame, node_type: str, keys_df: DataFrame) -> DataFrame:
    """vertices of a type whose key properties equal a row of ``keys_df``.

    The columns of ``keys_df`` that start with ``key:`` name the key properties
    (1 to 4); its other columns are carried along.
    """
    names = [c[4:] for c in keys_df.columns if c.startswith("key:")]
    if not 1 <= len(names) <= 4:
        raise ValueError(f"a lookup takes 1 to 4 key properties, got {len(names)}")
    side = only_type(v, node_type).select(
        "*", *[prop(n).alias(f"key:{n}") for n in names])
    return side.join(keys_df, [f"key:{n}" for n in names])


def filter_regex(v: DataFrame, node_type: str, patterns: dict[str, str]) -> DataFrame:
    """every named property matches its pattern as a whole."""
    out = only_type(v, node_type)
    for name, pattern in patterns.items():
        out = out.where(prop(name).rlike(f"^(?:{pattern})$"))
    return out


def read_id_list(ids: DataFrame, col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(accepted ids as ``vid``, rejected ids)."""
    text = F.trim(F.col(col))
    vid = F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))
    accepted = ids.where(vid.isNotNull()).withColumn("vid", vid)
    rejected = ids.where(vid.isNull())
    return accepted, rejected


def touch_report(v: DataFrame, ids: DataFrame, name: str, col: str = "id") -> DataFrame:
    """F8: per distinct requested id: updatable, no_property, not_found or bad_id."""
    wanted = ids.select(F.trim(F.col(col)).alias("id")).distinct()
    wanted = wanted.withColumn("vid", F.when(F.col("id").rlike("^[0-9]+$"), F.col("id").try_cast("long")))
    have = v.select("vid", F.lit(True).alias("_found"), prop(name).isNotNull().alias("_has"))
    return wanted.join(have, "vid", "left").select(
        "id",
        F.when(F.col("vid").isNull(), "bad_id")
        .when(F.col("_found").isNull(), "not_found")
        .when(~F.col("_has"), "no_property")
        .otherwise("updatable").alias("status"),
    )


def missing_or_empty(v: DataFrame, node_type: str, name: str) -> DataFrame:
    """the property is absent or empty."""
    return only_type(v, node_type).where(blank(prop(name)))
