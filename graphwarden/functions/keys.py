"""Column expressions over the property bag."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY_SEPARATOR = "\u0001"


def prop(name: str, props: str | Column = "props") -> Column:
    col = F.col(props) if isinstance(props, str) else props
    return col.getItem(name)


def key_str(keys: Column, props: Column) -> Column:
    """Key values joined by a separator; null if any key value is absent or empty."""
    values = F.transform(keys, lambda k: F.nullif(F.element_at(props, k), F.lit("")))
    return F.when(
        (F.size(keys) > 0) & ~F.exists(values, lambda x: x.isNull()),
        F.array_join(values, KEY_SEPARATOR),
    )


def has_keys(keys: Column, props: Column) -> Column:
    """Whether every key property has a value; false without keys."""
    return (F.size(keys) > 0) & F.forall(keys, lambda k: F.coalesce(F.element_at(props, k), F.lit("")) != "")


def set_prop(props: Column, name: str | Column, value: Column) -> Column:
    """Property bag with ``name`` set to ``value`` (removed when ``value`` is null)."""
    name_col = F.lit(name) if isinstance(name, str) else name
    rest = F.map_filter(F.coalesce(props, empty_props()), lambda k, _: k != name_col)
    return F.when(value.isNull(), rest).otherwise(
        F.map_concat(rest, F.create_map(name_col, value))
    )


def drop_prop(props: Column, name: str) -> Column:
    return F.map_filter(props, lambda k, _: k != F.lit(name))


def empty_props() -> Column:
    return F.create_map().cast("map<string,string>")


def blank(col: Column) -> Column:
    return col.isNull() | (col == "")


def url_encode(col: Column) -> Column:
    """Percent-encoding of a path segment (blank becomes ``%20``, not ``+``)."""
    return F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))


def json_inside(text: Column) -> Column:
    """JSON text without its outer brackets.

    For objects of strings, numbers or arrays: their inside neither starts nor
    ends with a brace.
    """
    return F.btrim(text, F.lit("{}"))


def json_scalar(col: Column) -> Column:
    """A string as JSON text."""
    return F.btrim(F.to_json(F.array(col)), F.lit("[]"))
