"""Uniqueness and schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphwarden.functions.bounds import small
from graphwarden.functions.keys import drop_prop, prop, set_prop

SPARK_TYPES = {"String": "string", "Integer": "int", "Long": "bigint", "Boolean": "boolean"}


class NotUnique(ValueError):
    """A property asked to be unique has repeated values."""


def unique_check(v: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(one summary row, one row per vertex of a repeated value).

    Values are compared as text across all node types.
    """
    rows = v.select("vid", "node_type", prop(name).alias("value")).where(F.col("value").isNotNull())
    counts = rows.groupBy("value").agg(F.count("*").alias("n_nodes"))
    summary = counts.agg(
        F.coalesce(F.sum("n_nodes"), F.lit(0)).cast("long").alias("times_found"),
        F.coalesce(F.sum(F.col("n_nodes") - 1), F.lit(0)).cast("long").alias("extra_copies"),
        F.count_if(F.col("n_nodes") > 1).alias("repeated_values"))
    return summary, rows.join(counts.where(F.col("n_nodes") > 1), "value")


def unique_precheck(v: DataFrame, name: str) -> DataFrame:
    """One row: cases of duplicate values and the number of distinct repeated values."""
    counts = v.select(prop(name).alias("value")).where("value IS NOT NULL").groupBy("value").agg(
        F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("dupe_count"),
        F.count_if(F.col("n") > 1).alias("dupe_values"))


def _cast_text(value: Column, type_name: str) -> Column:
    return value.try_cast(SPARK_TYPES[type_name]).cast("string")


def retype_property(
    v: DataFrame, name: str, type_name: str, unique: bool = False, preserve: bool = True, date: str = "00000000"
) -> tuple[DataFrame, DataFrame]:
    """(vertices, failed casts).

    A value that cannot be cast stays under the retired name and is reported;
    without ``preserve`` all values are removed.
    """
    if type_name not in SPARK_TYPES:
        raise ValueError(f"type must be one of {sorted(SPARK_TYPES)}")
    if unique:
        n = unique_precheck(v, name).first()["dupe_count"]
        if n:
            raise NotUnique(f"{name} has {n} duplicate values")
    old = prop(name)
    new = _cast_text(old, type_name)
    bare = drop_prop(F.col("props"), name)
    if not preserve:
        return v.withColumn("props", bare), v.where(F.lit(False)).select("vid", old.alias("value"))
    retired = f"{name}-{date}-RETIRED"
    props = (
        F.when(old.isNull(), F.col("props"))
        .when(new.isNull(), set_prop(bare, retired, old))
        .otherwise(set_prop(bare, name, new)))
    failed = v.where(old.isNotNull() & new.isNull()).select("vid", old.alias("value"))
    return v.withColumn("props", props), failed


def expected_properties(nt: DataFrame) -> DataFrame:
    """U4: (name, type, cardinality); the first node type by name defines a shared property."""
    rows = nt.select("node_type", "list_props", F.explode("prop_types").alias("name", "type"))
    rows = rows.withColumn("cardinality", F.when(F.array_contains("list_props", F.col("name")), "SET").otherwise("SINGLE"))
    first = F.min_by(F.struct("type", "cardinality"), "node_type")
    return rows.groupBy("name").agg(first.alias("d")).select("name", "d.type", "d.cardinality")


def expected_indexes(nt: DataFrame) -> DataFrame:
    """U4: (index_name, is_unique, properties): one per indexed property, and a key index
    for types that have several keys or are top-level."""
    single = nt.select(
        F.explode("indexed").alias("index_name"), "node_type",
        "unique_props").withColumn("is_unique", F.array_contains("unique_props", F.col("index_name")))
    single = single.groupBy("index_name").agg(F.min_by("is_unique", "node_type").alias("is_unique")).select(
        "index_name", "is_unique", F.col("index_name").alias("properties"))
    keyed = nt.where((F.size("keys") > 1) | F.col("top_level")).select(
        F.concat(F.lit("key-for-"), "node_type").alias("index_name"),
        F.exists("keys", lambda k: F.array_contains("unique_props", k)).alias("is_unique"),
        F.concat_ws(",", F.when(F.col("top_level"), F.lit("node-type")), F.array_join("keys", ",")).alias("properties"))
    return single.unionByName(keyed)


def expected_labels(rules: DataFrame) -> DataFrame:
    """U4: distinct edge labels; their multiplicity in storage is always MULTI."""
    return rules.select("label").distinct().withColumn("multiplicity", F.lit("MULTI"))


def observed_properties(v: DataFrame) -> DataFrame:
    """What the data holds: (name, n, any_list, all_boolean, all_integer, all_long); the types are those of single values."""
    rows = v.select(F.explode("props").alias("name", "value"))
    many = F.from_json("value", "array<string>").isNotNull() & F.startswith(F.ltrim("value"), F.lit("["))
    rows = rows.withColumn("_list", F.coalesce(many, F.lit(False)))
    return rows.groupBy("name").agg(
        F.count("*").alias("n"),
        F.max("_list").alias("any_list"),
        F.min(F.col("value").isin("true", "false")).alias("all_boolean"),
        F.min(F.col("value").try_cast("int").isNotNull()).alias("all_integer"),
        F.min(F.col("value").try_cast("long").isNotNull()).alias("all_long"))


def schema_diff(v: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, type, n, status) with status missing, extra, changed or ok.

    A property is changed if a value is not of the declared type, or if one is a list where SINGLE is declared.  A declared
    SET also holds single values, whose elements' type is not looked at where lists occur.
    """
    rows = observed_properties(v).join(small(expected.select("name", "type", "cardinality")), "name", "full")
    c = F.col
    fits = (
        F.when(c("type") == "Boolean", c("all_boolean")).when(c("type") == "Integer", c("all_integer"))
        .when(c("type") == "Long", c("all_long")).otherwise(True))
    status = (
        F.when(c("n").isNull(), "missing").when(c("type").isNull(), "extra")
        .when((c("cardinality") == "SINGLE") & c("any_list"), "changed")
        .when(~fits & ~c("any_list"), "changed").otherwise("ok"))
    return rows.select("name", "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"), status.alias("status"))


def label_diff(e: DataFrame, rules: DataFrame) -> DataFrame:
    """U5 for edge labels: (label, n, status)."""
    have = e.groupBy("label").agg(F.count("*").alias("n"))
    want = small(expected_labels(rules).select("label", F.lit(True).alias("_want")))
    return have.join(want, "label", "full").select(
        "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "extra").otherwise("ok").alias("status"))
