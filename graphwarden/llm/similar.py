"""Verified links between near copies: candidates by shared keys, exact Jaccard inside size-banded tiles.

Each set has a map of one bit for every hashed element.  Bits of one set that another lacks bound their overlap from above, so
most false candidates end there: first as maps alone, before any text is fetched, then between the sets of a tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.storage import cut
from graphwarden.llm.streams import sorted_groups

#: set elements that one block of a tile holds at most (a single larger set is a block of its own)
BLOCK_ELEMENTS = 1 << 18
#: characters of texts whose sets a task makes at once (a single larger group is made whole)
BATCH_CHARACTERS = 1 << 21
#: bits of a set's map: the second for sets of more elements than the first has bits
NARROW, WIDE = 1 << 10, 1 << 13
#: sets of a tile up to which pairs are intersected at once where no maps were asked for
FEW = 8


def candidates(keyed: DataFrame) -> DataFrame:
    """``(center, node)`` for ``keyed(key, node)``: the smallest node of each key that several nodes share, and those nodes.

    Two nodes that share a key meet under the same center.  A key is aggregated to its smallest and largest node before
    anything is joined, so keys of one node, nearly all, end there; pairs within a key are never listed.
    """
    dealt = keyed.repartition("key")  # the aggregate and the join both read this one exchange
    shared = dealt.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("top")).where("center < top")
    return cut(dealt.join(shared, "key").select("center", "node").distinct(), "candidates")


def _tiles(pairs: DataFrame, shrink: float, capacity: int) -> DataFrame:
    """Adds ``tile`` (an array of tile names) to ``pairs(center, node, size)``.

    Nodes of a center fall into bands of size, each as wide as the smallest size ratio of a link, so that links lie within
    a band or between neighbouring ones.  A band of more elements than ``capacity`` is split by hash into blocks, and a
    tile is a pair of blocks.  Small centers are one tile.
    """
    banded = pairs.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(-np.log(shrink))).cast("int"))
    blocks = banded.groupBy("center", "band").agg(F.sum("size").alias("total"))
    whole = blocks.groupBy("center").agg(F.sum("total").alias("all"))
    blocks = blocks.withColumn("n", F.ceil(F.col("total") / capacity).cast("int"))
    above = blocks.select("center", (F.col("band") - 1).alias("band"), F.col("n").alias("n_above"))
    below = blocks.select("center", (F.col("band") + 1).alias("band"), F.col("n").alias("n_below"))
    known = (
        blocks.join(whole, "center").join(above, ["center", "band"], "left").join(below, ["center", "band"], "left")
        .withColumn("one", F.col("all") <= capacity))
    placed = banded.join(known.select("center", "band", "one", "n", "n_above", "n_below"), ["center", "band"])
    placed = placed.withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))

    def named(band, first, second, step):
        return F.concat_ws(":", band, F.lit(step), first, second)

    def others(n, make):
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(
            F.array().cast("array<string>"))

    many = F.concat(
        others(F.col("n"), lambda j: named(F.col("band"), F.least(F.col("i"), j), F.greatest(F.col("i"), j), 0)),
        others(F.col("n_above"), lambda j: named(F.col("band"), F.col("i"), j, 1)),
        others(F.col("n_below"), lambda j: named(F.col("band") - 1, j, F.col("i"), 1)))
    return placed.select("center", "node", "size", F.when(F.col("one"), F.array(F.lit("all"))).otherwise(many).alias("tile"))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of elements that two sorted sets share."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges the two runs
    return int(np.count_nonzero(both[1:] == both[:-1]))


def few_links(nodes: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """As ``tile_links``, by intersections alone."""
    root, out = list(range(len(sets))), []
    for i, a in enumerate(sets):
        for j in range(i):
            low, high = sorted((len(a), len(sets[j])))
            if root[i] == root[j] or not low or low * den < high * num:
                continue
            both = _overlap(a, sets[j])
            if den * both >= num * (low + high - both):
                gone = root[j]
                root = [root[i] if r == gone else r for r in root]
                out.append((nodes[i], nodes[j]))
    return out


def bitmap_of(elements: np.ndarray) -> bytes:
    """The map of a set, of one of two fixed sizes."""
    bits = NARROW if len(elements) <= NARROW else WIDE
    out = np.zeros(bits, np.uint8)
    out[(elements >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


class Maps:
    """Maps of the sets of a tile, to bound the overlap of one set with many."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes]):
        self.sizes = sizes
        self.wide = np.array([len(m) * 8 == WIDE for m in maps], bool)
        self.row = np.cumsum(self.wide) - 1
        self.large = np.frombuffer(b"".join(m for m, w in zip(maps, self.wide) if w), np.uint64).reshape(-1, WIDE // 64)
        self.small = np.zeros((len(maps), NARROW // 64), np.uint64)
        narrow = b"".join(m for m, w in zip(maps, self.wide) if not w)
        self.small[~self.wide] = np.frombuffer(narrow, np.uint64).reshape(-1, NARROW // 64)
        # the small map of a large set has the same bits modulo its size
        self.small[self.wide] = np.bitwise_or.reduce(self.large.reshape(len(self.large), WIDE // NARROW, NARROW // 64), 1)

    def may_link(self, i: int, js: np.ndarray, num: int, den: int) -> np.ndarray:
        """Those of ``js`` whose overlap with ``i`` may reach what a link needs: den * overlap >= num * union."""
        least = -(-num * (self.sizes[i] + self.sizes[js]) // (num + den))
        bound = self._bound(self.small, i, js)
        js, least = js[bound >= least], least[bound >= least]
        if self.wide[i] and len(js):
            both = self.wide[js]
            bound = self._bound(self.large, self.row[i], self.row[js[both]], i, js[both])
            keep = ~both
            keep[both] = bound >= least[both]
            js = js[keep]
        return js

    def _bound(self, maps, i, js, size_i=None, size_js=None):
        size_i, size_js = (i, js) if size_i is None else (size_i, size_js)
        here = self.sizes[size_i] - np.bitwise_count(maps[i] & ~maps[js]).sum(1, dtype=np.int64)
        there = self.sizes[size_js] - np.bitwise_count(maps[js] & ~maps[i]).sum(1, dtype=np.int64)
        return np.minimum(here, there)


def survivors(sizes: np.ndarray, maps: list[bytes], num: int, den: int) -> np.ndarray:
    """Which sets of a tile may have a link there, by their sizes and maps alone.

    A set known to have a partner is not searched for again, so a tile of copies costs one pass.
    """
    order = np.argsort(sizes, kind="stable")
    tile = Maps(sizes[order], [maps[i] for i in order])
    found = np.zeros(len(order), bool)
    for i in range(len(order)):
        size = int(tile.sizes[i])
        if found[i] or not size:
            continue
        first, last = np.searchsorted(tile.sizes, [-(-size * num // den), size * den // num + 1])
        js = np.arange(first, last)
        js = tile.may_link(i, js[js != i], num, den)
        if len(js):
            found[i] = found[js] = True
    out = np.zeros(len(order), bool)
    out[order] = found
    return out


def tile_links(nodes: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one tile: den * overlap >= num * union.

    Sets are sorted arrays.  Only pairs whose maps allow a link are intersected; pairs already connected are left out.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    tile = Maps(np.array([len(sets[i]) for i in order], np.int64), [bitmap_of(sets[i]) for i in order])
    root = np.arange(len(order))
    out = []
    for i in range(len(order)):
        size = int(tile.sizes[i])
        if not size:
            continue
        js = np.arange(i + 1, int(np.searchsorted(tile.sizes, size * den // num, "right")))
        js = js[root[js] != root[i]]
        for j in tile.may_link(i, js, num, den) if len(js) else ():
            if root[j] == root[i]:
                continue
            both = _overlap(sets[order[i]], sets[order[j]])
            if den * both >= num * (size + int(tile.sizes[j]) - both):
                root[root == root[j]] = root[i]
                out.append((nodes[order[i]], nodes[order[j]]))
    return out


def _surviving(placed: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``placed(center, tile, node, size, bits)`` that may have a link in their tile, without the maps."""
    def make(rows: pd.DataFrame, bounds: np.ndarray):
        sizes, maps = rows["size"].to_numpy(np.int64), rows["bits"].tolist()
        keep = np.zeros(len(rows), bool)
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                keep[a:b] = survivors(sizes[a:b], maps[a:b], num, den)
        return rows.loc[keep, ["center", "tile", "node"]] if keep.any() else None

    return sorted_groups(placed, ["center", "tile"], make, "center long, tile string, node long")


def verified_links(pairs: DataFrame, texts: DataFrame, sets_of: Callable, num: int, den: int,
                   identity: Callable | None = None, capacity: int = BLOCK_ELEMENTS, maps: DataFrame | None = None) -> DataFrame:
    """``links(a, b)``: for every tile a spanning forest of its exact links.

    ``pairs(center, node, size)``; ``texts(node, text)`` holds the text of each node; ``sets_of(texts)`` gives
    sorted arrays of unsigned 64-bit elements.  With ``identity``, rows whose set is another node's are left out.  A tile
    holds two blocks at most, so its memory is bounded, whatever the size of a group.

    ``maps(node, bits)`` holds the map of each node: with it, only nodes that may have a link in a tile fetch their texts.
    """
    placed = _tiles(pairs, num / den, capacity).select("center", "node", "size", F.explode("tile").alias("tile"))
    if maps is not None:
        placed = cut(_surviving(placed.join(maps, "node"), num, den), "surviving")
        texts = texts.join(placed.select("node").distinct(), "node", "leftsemi")
    rows, few = placed.select("center", "tile", "node").join(texts, "node"), FEW if maps is None else 0

    def make(rows: pd.DataFrame, bounds: np.ndarray):
        nodes, texts = rows["node"].tolist(), rows["text"].tolist()
        out, first = [], 0
        while first < len(bounds) - 1:  # as many whole groups at a time as have some millions of characters
            last, total = first, 0
            while last < len(bounds) - 1 and (last == first or total < BATCH_CHARACTERS):
                total += sum(map(len, texts[bounds[last]:bounds[last + 1]]))
                last += 1
            start = bounds[first]
            sets = sets_of(texts[start:bounds[last]])
            for a, b in zip(bounds[first:last] - start, bounds[first + 1:last + 1] - start):
                if b - a > 1:
                    found = {n: s for n, s in zip(nodes[start + a:start + b], sets[a:b]) if identity is None or identity(s) == n}
                    join = few_links if len(found) <= few else tile_links
                    out += join(list(found), list(found.values()), num, den)
            first = last
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    return sorted_groups(rows, ["center", "tile"], make, "a long, b long")
