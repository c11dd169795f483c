"""Jaccard self-join on word n-grams: exact classes of linked documents."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphwarden.functions.storage import cut
from graphwarden.functions.components import components
from graphwarden.llm.hashing import BYTE_VALUES, Windows, chunks, mix, runs, signed
from graphwarden.llm.similar import bitmap_of, candidates, verified_links
from graphwarden.llm.streams import apart, rows_like

WORDS = 4
#: links have DEN * overlap >= NUM * union where the caller states no other share
NUM, DEN = 85, 100
#: sets from this size on are cut into parts; smaller ones, and those a link can join them with, use triples
SMALL = 40
#: sets a task remembers, so that copies give their keys once
TOLD = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; shorter texts are one sequence, texts without words have none."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        blob = np.frombuffer(" ".join(["", *texts[a:b], ""]).encode("utf-8", "surrogatepass"), np.uint8)
        lengths = [len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts[a:b]]
        blob = _LOWER[blob]
        starts, ends = runs(~_SPACE[blob])
        word = Windows(BYTE_VALUES[blob])(starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([0, *lengths]))
        gram = Windows(word)
        every = gram.every(words)
        for first, last in zip(bounds[:-1], bounds[1:]):
            if last - first >= words:
                out.append(np.unique(every[first:last - words + 1]))
            elif last > first:
                out.append(gram(np.array([first]), np.array([last])))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def node_of(elements: np.ndarray) -> np.uint64:
    """A 64-bit number that stands for a set."""
    return mix(np.array([mix(elements).sum(dtype=np.uint64) + np.uint64(len(elements))], np.uint64))[0]


def digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node (what stands for the set; null for an empty one) and the set's bitmap for each row."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingles([t if isinstance(t, str) else "" for t in batch["text"]], words)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                "node": signed(np.array([node_of(s) for s in sets], np.uint64)), "bits": [bitmap_of(s) for s in sets]})

    return docs.mapInPandas(make, "doc_id long, n_shingles long, node long, bits binary").withColumn(
        "node", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")))


def _next_top(top: int, num: int, den: int) -> int:
    return max(top + 1, (top + 1) * den // num)


@lru_cache(maxsize=None)
def _tops(num: int, den: int) -> list[int]:
    """Largest size of each band, up to sets no text can have: a link's sizes lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(_next_top(out[-1], num, den))
    return out


@lru_cache(maxsize=None)
def parts_of(top: int, num: int = NUM, den: int = DEN) -> tuple[int, int]:
    """How many parts the sets of a band are cut into, and how many of them a set may leave empty.

    Sets of a link with at most ``top`` elements each differ in at most ``h`` elements, so of ``h + 1 + spare`` parts at
    least ``spare + 1`` are equal, and one of those has elements unless both sets leave more than ``spare`` parts empty.
    """
    h = (den - num) * 2 * top // (den + num)
    for spare in range(h + 2):
        empty = (h + 1 + spare) * np.exp(-(num / den) * top / (h + 1 + spare))
        if spare >= empty + 2 * np.sqrt(empty):
            break
    return h + 1 + spare, spare


def prefix(elements: np.ndarray, shared: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The smallest elements of a sorted set of which the two sets of any link have ``shared`` in common."""
    return elements[: len(elements) * (den - num) // den + shared]


def part_keys(elements: np.ndarray, band: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Keys of one set within one band: one for each part with elements, made of all the part's elements.

    A set with too many empty parts also gets its prefix as keys, under which it meets others of that kind.
    """
    parts, spare = parts_of(_tops(num, den)[band], num, den)
    salt = mix(np.array([2 * band + 3], np.uint64))[0]
    part = ((elements >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # elements are sorted, so parts are runs
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    keys = mix(np.add.reduceat(elements, first) ^ mix(part[first] + salt))
    if parts - len(first) > spare:
        keys = np.concatenate((keys, mix(prefix(elements, 1, num, den) ^ ~salt)))
    return keys


def triple_keys(elements: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Keys of a small set: every three elements of a prefix of which linked sets share three."""
    first = prefix(elements, 3, num, den)
    if len(first) < 3:
        return np.empty(0, np.uint64)  # so small a set links with equal sets alone, and those are one node
    i, j, k = np.array(list(combinations(range(len(first)), 3))).T
    return mix(mix(first[i]) + mix(first[j] ^ mix(first[k])))


def keys_of(elements: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Keys of which the sets of any link that are not equal share one (proved from the sizes, not by chance)."""
    n, out = len(elements), []
    if n * num <= SMALL * den:  # as large as a link allows beside a set of SMALL elements
        out.append(triple_keys(elements, num, den))
    if n >= SMALL:
        band = bisect_left(_tops(num, den), n)
        out += [part_keys(elements, band, num, den), part_keys(elements, band + 1, num, den)]
    return np.concatenate(out)


def join(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included) for each row of ``docs``.

    Documents link if the Jaccard similarity of their n-grams of ``words`` words is ``num / den`` or more.

    Null and empty texts have no shingles and link with nothing.  Rows of one id are one document when linked: their
    classes join.  Rows with a null id are returned with a null component and link nothing.  No rows, no result.

    Documents of equal sets are one node.  Candidates are exact, by the pigeonhole principle: the sets of a link, cut into
    more parts than they can differ in elements, agree in one part.  They are verified in size-banded tiles; links come as
    spanning forests and end in distributed components.  Nodes are 64-bit hashes of sets.
    """
    base = rows_like(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = cut(digests(base, words), "digests")
    sets = held.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.max("n_shingles").alias("size"), F.first("bits").alias("bits"))  # equal within a node

    def key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[int] = set()
        for batch in batches:
            for a, b in chunks(batch["text"].tolist(), 1 << 20):
                by_node = {node_of(s): s for s in shingles(batch["text"].tolist()[a:b], words) if len(s)}
                by_node = {node: s for node, s in by_node.items() if int(node) not in told}
                if len(told) > TOLD:
                    told.clear()  # a copy may give its keys again, which changes nothing
                told.update(map(int, by_node))
                found = [keys_of(s, num, den) for s in by_node.values()]
                if found:
                    yield pd.DataFrame({
                        "key": signed(np.concatenate(found)),
                        "node": np.repeat(signed(np.array(list(by_node), np.uint64)), [len(f) for f in found])})

    usable = base.where("text is not null and doc_id is not null")
    pairs = candidates(usable.select("text").mapInPandas(key_rows, "key long, node long"))
    wanted = cut(pairs.select("node").distinct().join(sets, "node"), "wanted")
    texts, _ = apart(usable, "doc_id", wanted, "first")
    texts = texts.join(wanted.select("node", "first"), F.col("doc_id") == F.col("first")).select("node", "text")
    links = verified_links(
        pairs.join(wanted.select("node", "size"), "node"), texts, lambda texts: shingles(texts, words), num, den,
        identity=lambda s: int(node_of(s).astype(np.int64)), maps=wanted.select("node", "bits"))
    # rows of one id are one document, so an id links the nodes of its different texts
    several = held.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    own = held.join(several, "doc_id").select("a", F.col("node").alias("b"))
    classes = components(links.unionByName(own))
    known = held.where("node is not null").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = known.join(lowest, "component").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(held.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
same AS (SELECT md5(string_agg(gram, chr(10) ORDER BY gram)) AS digest, doc_id FROM g GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY digest) AS node FROM same),
nodes AS (SELECT DISTINCT node FROM rep),
rare AS (SELECT gram FROM g JOIN nodes ON doc_id = node GROUP BY gram HAVING count(*) > 1),
r AS MATERIALIZED (SELECT doc_id, gram FROM g JOIN nodes ON doc_id = node SEMI JOIN rare USING (gram)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * overlap >= 85 * (x.n + y.n - overlap)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS low FROM both_ways UNION SELECT b, low FROM reach JOIN both_ways ON node = a WHERE low < b),
low AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, rep.node, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN low ON low.node = rep.node
"""
