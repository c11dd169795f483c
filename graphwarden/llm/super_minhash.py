"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, distributed components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.storage import cut
from graphwarden.llm import ngram_join
from graphwarden.functions.components import components
from graphwarden.llm.hashing import chunks, mix, signed
from graphwarden.llm.ngram_join import node_of, shingles
from graphwarden.llm.similar import bitmap_of, verified_links
from graphwarden.llm.streams import apart, rows_like

WORDS = 4
#: links have DEN * overlap >= NUM * union where the caller states no other share
NUM, DEN = 80, 100
#: a pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: all but 6e-7 of the pairs at 0.8
BANDS, ROWS = 36, 5
#: characters whose shingles are hashed at once
BATCH = 1 << 19

_FRACTION = np.uint64((1 << 40) - 1)
_STEPS = mix(np.arange(1, 1 << 12, dtype=np.uint64))


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of each set (none empty): for each of ``size`` places the least of ``rank + fraction`` over its elements.

    Every element has a random permutation of the places, the ranks, and a random fraction for each rank, all drawn from its
    hash.  Ranks of one element differ from place to place, which is what lowers the variance against independent hashes.
    Rank by rank, an element takes one more step of its shuffle and offers rank + fraction to the place it draws.  A set
    stops as soon as all its places hold less than the next rank: nothing to come could be smaller.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * size, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    places = None  # the shuffle of each element, as far as it has come
    for rank in range(size):
        drawn = mix(element + _STEPS[rank])
        swap = rank + ((drawn >> np.uint64(40)) * np.uint64(size - rank) >> np.uint64(24)).astype(np.int64)
        row = np.arange(len(element))
        if places is None:
            place = swap  # nothing was swapped before
        else:
            place = places[row, swap].astype(np.int64)
        np.minimum.at(out, owner * size + place, (np.uint64(rank) << np.uint64(40)) + (drawn & _FRACTION))
        worst = out.reshape(len(sets), size).max(1)
        active = worst >= (np.uint64(rank + 1) << np.uint64(40))
        if not active.any():
            break
        keep = active[owner]
        if places is None:
            places = np.tile(np.arange(size, dtype=np.uint16), (int(keep.sum()), 1))
        else:
            places = places[keep]
        element, owner, swap, place = element[keep], owner[keep], swap[keep], place[keep]
        row = np.arange(len(element))
        places[row, swap] = places[row, rank]
        places[row, rank] = place
    return out.reshape(len(sets), size)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each band of each signature (rows are sets)."""
    n, size = signature.shape
    parts = signature.reshape(n, bands, size // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands))
    for k in range(parts.shape[2]):
        key = mix(key + parts[:, :, k])
    return key


def signed_documents(docs: DataFrame, words: int) -> DataFrame:
    """For each row doc_id, n_shingles, node (what stands for its set), and the set's band keys and bitmap.

    The last three are null for an empty set and for a row without an id.
    """
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in chunks(texts, BATCH):
                sets = shingles(texts[a:b], words)
                some = [k for k, s in enumerate(sets) if len(s)]
                keys = signed(band_keys(signatures([sets[k] for k in some]))) if some else []
                found = {k: (signed(node_of(sets[k])), row, bitmap_of(sets[k])) for k, row in zip(some, keys)}
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64").array, "n_shingles": [len(s) for s in sets],
                    "node": pd.array([found[k][0] if k in found else None for k in range(b - a)], "Int64"),
                    "keys": [found[k][1] if k in found else None for k in range(b - a)],
                    "bits": [found[k][2] if k in found else None for k in range(b - a)]})

    rows = docs.mapInPandas(make, "doc_id long, n_shingles long, node long, keys array<long>, bits binary")
    return rows.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node")))


def meetings(keyed: DataFrame) -> DataFrame:
    """``(center, node)`` for ``keyed(key, node)``: nodes that share a key meet under the smallest of them.

    Keys are reduced to their smallest and largest node before the shuffle, and the few that several nodes share are joined
    back, so a key of a large family of near copies is split like any other skewed join key.
    """
    shared = keyed.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("top")).where("center < top")
    return cut(keyed.join(shared.select("key", "center"), "key").select("center", "node").distinct(), "meetings")


def near_duplicates(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included) and kept for each row.

    Documents link if the Jaccard similarity of their n-grams of ``words`` words is ``num / den`` or more; every link
    found is confirmed on the full sets.  Of each component the document with component_id is kept.

    Null and empty texts have no shingles, link with nothing and are kept.  Rows of one id are one document when linked:
    their classes join, and all of them are kept or none.  Rows with a null id link nothing, have a null component, and are
    kept.  No rows, no result; extra columns are ignored.

    Documents of equal sets are one node, whatever their number.  Nodes that agree in a band meet in size-banded tiles,
    where bitmaps and then exact intersections decide; links end in distributed components.  The bands miss a link of
    similarity 0.8 with a probability of 6e-7, and less above.  Nodes are 64-bit hashes of sets.
    """
    base = rows_like(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = cut(signed_documents(base, words), "signed")
    nodes = cut(held.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.max("n_shingles").alias("size"), F.first("keys").alias("keys"), F.first("bits").alias("bits")),
        "nodes")  # keys and maps of a node are equal
    pairs = meetings(nodes.select(F.explode("keys").alias("key"), "node"))
    wanted = cut(pairs.select("node").distinct().join(nodes.drop("keys"), "node"), "wanted")
    texts, _ = apart(base.where("text IS NOT NULL AND doc_id IS NOT NULL"), "doc_id", wanted, "first")
    texts = texts.join(wanted.select("node", "first"), F.col("doc_id") == F.col("first")).select("node", "text")
    links = verified_links(
        pairs.join(wanted.select("node", "size"), "node"), texts, lambda texts: shingles(texts, words), num, den,
        identity=lambda s: int(node_of(s).astype(np.int64)), maps=wanted.select("node", "bits"))
    named = held.where("node IS NOT NULL").select("doc_id", "n_shingles", "node")
    # an id with several texts links the nodes of all of them
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    classes = components(links.unionByName(named.join(several, "doc_id").select("a", F.col("node").alias("b"))))
    known = named.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = known.join(lowest, "component").select("doc_id", "n_shingles", "component_id")
    rest = held.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: the join's SQL with this operator's share
SQL = ngram_join.SQL.replace("85 *", "80 *").replace("AS component_id\nFROM", "AS component_id, d.doc_id = coalesce(low, rep.node, d.doc_id) AS kept\nFROM")
