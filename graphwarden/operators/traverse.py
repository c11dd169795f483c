"""Traversal queries.

``seed(g, "customer").has("market-segment", "BUILDING").to("order").count()``

The frontier holds one row per vertex with the number of walks that reach it,
so repeated results cost a number and not a row, and a hub walked in and out
costs its edges and not all pairs of its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphwarden.functions.bounds import SMALL_ROWS, within
from graphwarden.functions.keys import prop
from graphwarden.functions.storage import written
from graphwarden.model import Graph
from graphwarden.operators.structure import is_cousin

COPIES = 1000  # results that one row of a block stands for at most


def text(value) -> str:
    """A value as the property bag holds it."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def pair_rules(rules: DataFrame, a: str, b: str) -> list[dict]:
    """The edge rules of one pair of types, the containing ones alone if there are any."""
    mine = rules.where(
        ((F.col("from_type") == a) & (F.col("to_type") == b)) | ((F.col("from_type") == b) & (F.col("to_type") == a)))
    found = [r.asDict() for r in mine.distinct().collect()]  # the rules of one pair
    return [r for r in found if r["contains_other_v"] not in (None, "NONE")] or found


def steps(g: Graph, a: str, b: str) -> DataFrame:
    """(vid, _to): edges that lead from a vertex of type ``a`` to one of type ``b``; the types of the ends are not checked."""
    mine = pair_rules(g.rules, a, b)
    contains = any(r["contains_other_v"] not in (None, "NONE") for r in mine)
    e = g.e.where(~is_cousin() if contains else is_cousin())
    if mine:
        e = e.where(F.col("label").isin(sorted({r["label"] for r in mine})))
    ways = set()
    for r in mine:
        forward = (r["from_type"] == a) == (r["direction"] != "IN")
        ways |= {("src", "dst") if forward else ("dst", "src")}
        if r["direction"] == "BOTH" or a == b:
            ways |= {("src", "dst"), ("dst", "src")}
    ways = ways or {("src", "dst"), ("dst", "src")}
    return reduce(DataFrame.unionByName, [e.select(F.col(s).alias("vid"), F.col(d).alias("_to")) for s, d in sorted(ways)])


def _same(hits: DataFrame) -> DataFrame:
    return hits


@dataclass(frozen=True)
class Traversal:
    g: Graph
    types: tuple[str, ...]
    frontier: DataFrame | None = None  # (vid, n); None = every vertex of the types
    conds: tuple[Column, ...] = ()
    stored: tuple[DataFrame, ...] = ()
    is_few: bool = False  # whether the frontier was found small enough to broadcast
    cap: int | None = None  # limit of the results, which stored ones obey too
    back: Callable[[DataFrame], DataFrame] = _same  # from ids here to the ids of the sub-query's start that lead to them

    # ---- steps

    def has(self, key: str, *values) -> Traversal:
        """The property is one of ``values``."""
        return replace(self, conds=(*self.conds, prop(key).isin(*[text(x) for x in values])))

    def has_not(self, key: str, value) -> Traversal:
        """The property is not ``value``; vertices without it stay."""
        return replace(self, conds=(*self.conds, ~prop(key).eqNullSafe(F.lit(text(value)))))

    def to(self, node_type: str) -> Traversal:
        """T4: over tree edges if the rule of the type pair contains, else over cousin edges."""
        here, is_few = self.rows().select("vid", "n", "node_type"), self.is_few
        if self.frontier is None and self.conds:
            here = written(here, "seed")
            is_few = within(here, SMALL_ROWS)
        here = F.broadcast(here) if is_few else here
        ways = {t: steps(self.g, t, node_type) for t in self.types}
        hops = [here.where(F.col("node_type") == t).join(way, "vid").select(F.col("_to").alias("vid"), "n") for t, way in ways.items()]
        reached = reduce(DataFrame.unionByName, hops).groupBy("vid").agg(F.sum("n").alias("n"))
        if is_few:
            reached = written(reached, "hop")
            is_few = within(reached, SMALL_ROWS)

        def back(hits: DataFrame) -> DataFrame:
            ends = hits.select(F.col("vid").alias("_to"))
            lead = [here.where(F.col("node_type") == t).select("vid").join(way.join(ends, "_to", "left_semi"), "vid", "left_semi")
                    for t, way in ways.items()]
            return self.back(reduce(DataFrame.unionByName, lead))

        return replace(self, types=(node_type,), frontier=reached, conds=(), is_few=is_few, back=back)

    def union(self, *branches: Callable[[Traversal], Traversal]) -> Traversal:
        """T5: the results of several sub-queries from the current vertices."""
        base = replace(self, stored=())
        ends = [b(base) for b in branches]
        rows = reduce(DataFrame.unionByName, [t.rows().select("vid", "n") for t in ends])
        types = tuple(dict.fromkeys(t for x in ends for t in x.types))
        stored = self.stored + tuple(s for x in ends for s in x.stored)
        merged = rows.groupBy("vid").agg(F.sum("n").alias("n"))

        def back(hits: DataFrame) -> DataFrame:
            return reduce(DataFrame.unionByName, [
                t.back(t.rows().select("vid").join(hits, "vid", "left_semi")) for t in ends])

        return replace(self, types=types, frontier=merged, conds=(), stored=stored, is_few=False, back=back)

    def where(self, branch: Callable[[Traversal], Traversal]) -> Traversal:
        """Only vertices from which the sub-query reaches something.

        The sub-query runs forward over sets of vertices; its results then lead back step by step.
        """
        here = self.rows().select("vid", "n")
        start = here.select("vid", F.lit(1).cast("long").alias("n"))
        end = branch(replace(self, frontier=start, conds=(), stored=(), is_few=False, cap=None, back=_same))
        hits = end.back(end.rows().select("vid"))
        return replace(self, frontier=here.join(hits, "vid", "left_semi"), conds=())

    def store(self) -> Traversal:
        """Mark the current vertices; results then are the marked ones only."""
        return replace(self, stored=(*self.stored, self.rows().select("vid")))

    def limit(self, n: int) -> Traversal:
        """The first ``n`` results in id order; of stored vertices, the first ``n`` different ones."""
        top = self.rows().select("vid", "n").orderBy("vid").limit(n)
        # at most n rows reach this window
        before = Window.orderBy("vid").rowsBetween(Window.unboundedPreceding, -1)
        left = F.lit(n) - F.coalesce(F.sum("n").over(before), F.lit(0))
        kept = top.withColumn("_left", left).where("_left > 0").select(
            "vid", F.least("n", "_left").cast("long").alias("n"))
        return replace(self, frontier=kept, conds=(), cap=n if self.cap is None else min(n, self.cap))

    # ---- results

    def rows(self) -> DataFrame:
        """(n, vertex columns) of the current vertices."""
        pool = self.g.v.where(F.col("node_type").isin(*self.types))
        for c in self.conds:
            pool = pool.where(c)
        if self.frontier is None:
            return pool.select(F.lit(1).cast("long").alias("n"), "*")
        front = F.broadcast(self.frontier) if self.is_few else self.frontier
        return front.join(pool, "vid").select("n", *pool.columns)

    def vertices(self) -> DataFrame:
        """Distinct result vertices: the marked ones if any step is marked."""
        if not self.stored:
            return self.rows().select("vid").distinct()
        marked = reduce(DataFrame.unionByName, self.stored).distinct()
        return marked if self.cap is None else marked.orderBy("vid").limit(self.cap)

    def result(self) -> DataFrame:
        """The result list itself, duplicates kept; a row's copies are made in blocks."""
        if self.stored:
            return self.vertices()
        blocks = self.rows().select("vid", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("block"))
        size = F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES).cast("int")
        return blocks.select("vid", F.explode(F.sequence(F.lit(1), size)).alias("copy")).select("vid")

    def count(self) -> DataFrame:
        """One row, the number of results."""
        if self.stored:
            return self.vertices().agg(F.count("*").alias("n"))
        return self.rows().agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def seed(g: Graph, node_type: str) -> Traversal:
    """All vertices of a type."""
    return Traversal(g, (node_type,))


def subgraph(g: Graph, vids: DataFrame, style: str = "no_op") -> tuple[DataFrame, DataFrame]:
    """T10 ``star``: every edge touching a result and the far ends; T11 ``prune``: edges between
    results and their ends; T12 ``no_op``: the results alone."""
    ids = vids.select("vid").distinct()
    at = lambda s: ids.select(F.col("vid").alias(s))
    if style == "no_op":
        return vids, g.e.limit(0)
    if style == "prune":
        e = g.e.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi")
        ends = e.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    elif style == "star":
        marked = lambda s: at(s).withColumn(f"_{s}", F.lit(True))
        e = g.e.join(marked("src"), "src", "left").join(marked("dst"), "dst", "left").where(
            F.coalesce("_src", "_dst", F.lit(False)))
        ends = e.select(F.explode(F.array("src", "dst")).alias("vid")).unionByName(ids).distinct()
    else:
        raise ValueError(f"unknown style {style}")
    return g.v.join(ends, "vid", "left_semi"), e.select(*g.e.columns)
