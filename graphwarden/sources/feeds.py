"""Feed files, model definitions and change-event files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphwarden.functions.keys import empty_props
from graphwarden.functions.numbering import number_rows
from graphwarden.functions.storage import written
from graphwarden.model import EDGE_COLS, VERTEX_COLS

# Fixed values of the event files and of loaded models.
DELETE_SEPARATOR = "#@#"
MODEL_SOURCE, MODEL_TYPE, MODEL_VERSION = "ModelLoaderTool", "widget", "2.0"
MODEL_URI = "/service-design-and-creation/models/model/"


def feed_fields(line: Column) -> Column:
    """Fields of a CSV line without quotes and surrounding blanks."""
    return F.transform(F.split(line, ",", -1), lambda x: F.trim(F.regexp_replace(x, '["\\s]+$|^["\\s]+|"', "")))


def parse_feed(lines: DataFrame, cols: dict[str, int], width: int, header: str | None = None):
    """(rows with the named fields, fallout rows with a reason) from a ``value`` column of lines.

    ``header`` is dropped by content; blank lines are skipped; a line of another
    width, or with an empty named field, is fallout.
    """
    rows = lines.where(F.trim("value") != "")
    if header is not None:
        rows = rows.where(F.regexp_replace("value", r"\s", "") != header.replace(" ", ""))
    rows = rows.withColumn("_f", feed_fields(F.col("value")))
    named = {n: F.get("_f", F.lit(i)) for n, i in cols.items()}
    empty = F.lit(False)
    for c in named.values():
        empty = empty | (F.coalesce(c, F.lit("")) == "")
    rows = rows.withColumn("reason", F.when(F.size("_f") != width, "width").when(empty, "empty field"))
    good = rows.where("reason IS NULL").select(*[c.alias(n) for n, c in named.items()])
    return good, rows.where("reason IS NOT NULL").select(F.col("value").alias("line"), "reason")


def read_feed(spark: SparkSession, path: str, cols: dict[str, int], width: int, header: str | None = None):
    """S9 on a file or folder."""
    return parse_feed(spark.read.text(path), cols, width, header)


def parse_properties(lines: DataFrame) -> DataFrame:
    """(key, value) of ``key=value`` lines; comments are dropped."""
    text = F.trim("value")
    return lines.where((text != "") & ~text.startswith("#") & text.contains("=")).select(
        F.trim(F.substring_index(text, "=", 1)).alias("key"),
        F.trim(F.expr("substring(trim(value), instr(trim(value), '=') + 1)")).alias("value"))


def load_root_models(props: DataFrame, v: DataFrame, e: DataFrame, root_vid: int, vid_base: int, now_ms: int):
    """(vertices, edges) to add for models and versions that are not there yet.

    ``props`` holds ``x.<id type>.<name>`` keys.  New ids are ``vid_base`` plus the
    row number of the new model or version, so they cannot collide.
    """
    parts = F.split("key", r"\.")
    rows = props.where(F.size(parts) == 3).select(
        F.get(parts, F.lit(1)).alias("kind"), F.get(parts, F.lit(2)).alias("name"), "value")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    models = rows.groupBy("name").agg(
        pick("model-invariant-id").alias("inv"), pick("model-version-id").alias("ver"),
        F.coalesce(pick("model-type"), F.lit(MODEL_TYPE)).alias("type")).where("inv IS NOT NULL AND ver IS NOT NULL")

    def known(node_type: str, prop: str, as_name: str) -> DataFrame:
        return v.where(F.col("node_type") == node_type).groupBy(F.col("props").getItem(prop).alias(as_name)).agg(
            F.min("vid").alias(f"{as_name}_vid"))

    models = models.join(known("model", "model-invariant-id", "inv"), "inv", "left").join(
        known("model-ver", "model-version-id", "ver"), "ver", "left")
    fresh = models.where("inv_vid IS NULL").select(F.lit("model").alias("tag"), F.col("inv").alias("id")).unionByName(
        models.where("ver_vid IS NULL").select(F.lit("model-ver").alias("tag"), F.col("ver").alias("id"))).distinct()
    ids = number_rows(fresh, ["tag", "id"]).withColumn("new_vid", F.col("rn") + vid_base)
    for key, tag, out in (("inv", "model", "m_vid"), ("ver", "model-ver", "mv_vid")):
        mine = ids.where(F.col("tag") == tag).select(F.col("id").alias(key), "new_vid")
        models = models.join(mine, key, "left").withColumn(out, F.coalesce(f"{key}_vid", "new_vid")).drop("new_vid")
    models = written(models, "models")
    uri = F.concat(F.lit(MODEL_URI), F.col("inv"))

    def vertices(df: DataFrame, vid: str, node_type: str, link: Column, p: dict[str, Column]) -> DataFrame:
        cols = {"vid": F.col(vid), "node_type": F.lit(node_type), "uri": link,
                "uuid": F.md5(link.cast("binary")), "resource_version": F.lit(str(now_ms)),
                "created_ts": F.lit(now_ms).cast("long"), "last_mod_ts": F.lit(now_ms).cast("long"),
                "end_ts": F.lit(None).cast("long"), "source_of_truth": F.lit(MODEL_SOURCE),
                "props": F.create_map(*[x for n, c in p.items() for x in (F.lit(n), c)])}
        return df.select(*[cols[c].alias(c) for c in VERTEX_COLS])

    # one definition per id: the first name
    first = lambda key, keep: models.where(F.col(f"{key}_vid").isNull()).groupBy(key).agg(
        *[F.min_by(c, "name").alias(c) for c in keep])
    new_v = vertices(
        first("inv", ["m_vid", "name", "type"]), "m_vid", "model", uri,
        {"model-invariant-id": F.col("inv"), "model-type": F.col("type"), "model-name": F.col("name")})
    new_v = new_v.unionByName(vertices(
        first("ver", ["mv_vid", "name", "inv"]), "mv_vid", "model-ver",
        F.concat(uri, F.lit("/model-vers/model-ver/"), F.col("ver")),
        {"model-version-id": F.col("ver"), "model-name": F.col("name"), "model-version": F.lit(MODEL_VERSION)}))

    def links(src: Column, dst: Column, label: str) -> DataFrame:
        pairs = models.select(src.alias("src"), dst.alias("dst")).distinct()
        there = e.where(F.col("label") == label).select("src", "dst")
        cols = {"eid": F.concat_ws(":", F.lit(label), "src", "dst"), "label": F.lit(label),
                "contains_other_v": F.lit("NONE"), "delete_other_v": F.lit("NONE"), "prevent_delete": F.lit("NONE"),
                "end_ts": F.lit(None).cast("long"), "props": empty_props()}
        return pairs.join(there, ["src", "dst"], "left_anti").select(
            *[cols[c].alias(c) if c in cols else F.col(c) for c in EDGE_COLS])

    new_e = links(F.lit(root_vid).cast("long"), F.col("m_vid"), "models").unionByName(
        links(F.col("m_vid"), F.col("mv_vid"), "model-vers"))
    return new_v, new_e


def event_lines(v: DataFrame, ts: Column) -> DataFrame:
    """``ts_vid_version`` lines of changed vertices."""
    return v.select(
        F.concat_ws("_", ts.cast("string"), F.col("vid").cast("string"), "resource_version").alias("value"))


def delete_lines(v: DataFrame) -> DataFrame:
    """``type#@#uri#@#json`` lines of deleted vertices; always three parts, an absent one is empty."""
    parts = [F.coalesce("node_type", F.lit("")), F.coalesce("uri", F.lit("")), F.coalesce(F.to_json("props"), F.lit("{}"))]
    return v.select(F.concat_ws(DELETE_SEPARATOR, *parts).alias("value"))


def write_events(v: DataFrame, path: str, ts: Column) -> str:
    event_lines(v, ts).write.text(path)
    return path


def write_deletes(v: DataFrame, path: str) -> str:
    delete_lines(v).write.text(path)
    return path
