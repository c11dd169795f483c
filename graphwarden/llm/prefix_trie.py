"""Prefix trie of conversations: sorted neighbours, joined by union-find from their longest common prefixes downwards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphwarden.functions.storage import cut
from graphwarden.llm.resample import CRC_SQL
from graphwarden.llm.streams import rows_like

#: bytes that stand for a turn: the first half of a SHA-256
TURN = 16
#: sorted conversations whose forest is built at once
BLOCK = 4096
#: conversation ids of one piece of a node's id list: ids that agree above so many bits
CHUNK_BITS = 12
#: conversations in a row that start with turns of the first of them, and how many turns at most (less one)
FAMILY, SHARED = 20, 4

#: depth and conv_id of a node, its parent's, and what is added up over the pieces of a node
NODE_SCHEMA = ("block long, open boolean, id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
               "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
_ADDED = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turn_key(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (a binary of 16 bytes for each turn), words (of each turn) for every conversation after rebuilding."""
    turns = rows_like(conversations, ["conv_id", "turn", "role", "text"]).where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.select("conv_id", F.struct(
        "turn", turn_key(F.col("role"), F.col("text")).alias("key"),
        F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words")).alias("turn"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))  # nulls first
    own = cut(own.withColumn("turns", F.transform("turns", lambda t: F.struct(
        F.substring(t["key"], 1, 2 * TURN).alias("key"), t["words"].alias("words")))), "conversations")
    lead = own.select(F.col("conv_id").alias("first"), F.slice("turns", 1, SHARED - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    whole = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(lead, "first", "left").withColumn("h", h)
    whole = whole.select("conv_id", F.concat(
        F.slice(F.coalesce("lead", F.array().cast("array<struct<key:string,words:bigint>>")), F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))
    return whole.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("keys"),
        F.transform("turns", lambda t: t["words"]).alias("words"))


def _hash_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the texts of each ``seq`` joined by commas, in the order of the rows; holds one hash, never a list."""
    now, digest = None, None
    for batch in batches:
        done = []
        for seq, ids in zip(batch["seq"], batch["ids"]):
            if seq == now:
                digest.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((now, digest.hexdigest()))
            now, digest = seq, hashlib.sha256(ids.encode())
        if done:
            yield pd.DataFrame(done, columns=["seq", "ends"])
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["seq", "ends"])


def id_lists(members: DataFrame) -> DataFrame:
    """(seq, ends): for ``members(conv_id, seq)`` the SHA-256 of each sequence's ids, ascending, joined by commas.

    Ids near each other are put together in pieces of bounded size, in many tasks; only the hash of a sequence with several
    pieces runs over them one after the other, since it is defined so, and holds no more than one piece.
    """
    pieces = members.groupBy("seq", F.shiftright("conv_id", CHUNK_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    pieces = cut(pieces, "id_lists")
    n = pieces.groupBy("seq").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    one = n.where("n = 1").select("seq", F.sha2("ids", 256).alias("ends"))
    several = pieces.join(n.where("n > 1").select("seq"), "seq", "leftsemi")
    return one.unionByName(several.repartition("seq").sortWithinPartitions("seq", "piece").mapInPandas(_hash_lists, "seq string, ends string"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two conversations share at their start."""
    n = min(len(a), len(b)) // TURN
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * TURN:mid * TURN] == b[low * TURN:mid * TURN] else (low, mid - 1)
    return low


def forest(lengths: list[int], edges: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Nodes (depth, first, last, parent) of the trie of sorted different sequences, without nodes of one child and no end.

    ``edges[i]`` is the common prefix of sequences i and i + 1.  Edges are taken from the deepest up.  Each joins the two
    components beside it: unless the left one's top stands at the edge's depth, the merge creates a branching node.  The right
    one's top is always deeper, as edges of one depth are taken from the left.  The last top has the parent -1.
    """
    n = len(lengths)
    depth, first, last, parent = list(lengths), list(range(n)), list(range(n)), [-1] * n
    root, top = list(range(n)), list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in sorted(range(n - 1), key=lambda i: -edges[i]):
        a, b, d = find(i), find(i + 1), edges[i]
        x, y = top[a], top[b]
        if depth[x] == d:
            node = x
        else:
            node = len(depth)
            depth.append(d)
            first.append(first[x])
            last.append(last[x])
            parent.append(-1)
            parent[x] = node
        parent[y] = node
        last[node] = last[y]
        root[b] = a
        top[a] = node

    return depth, first, last, parent


def prefix_ids(keys: bytes, depth: int) -> list[bytes]:
    """What stands for the prefixes of 0, 1, ... ``depth`` turns."""
    digest, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        if d:
            digest.update(keys[(d - 1) * TURN:d * TURN])
        out.append(digest.digest())
    return out


def block_nodes(block: int, left: bytes | None, right: bytes | None, keys: list[bytes], words: list[np.ndarray], low: list[int],
                n: list[int], ends: list[str]) -> list[tuple]:
    """Nodes of the trie over a run of sorted sequences, between its neighbours ``left`` and ``right`` in the whole order.

    A node that also has members beyond the run is open: the row is this run's piece of it, named by its prefix.  What is
    counted for a node or a child as such is counted where its first member is, so that the pieces add up.
    """
    m = len(keys)
    lengths = [len(k) // TURN for k in keys]
    edges = [common(a, b) for a, b in zip(keys, keys[1:])]
    before = -1 if left is None else common(left, keys[0])
    after = -1 if right is None else common(keys[-1], right)
    depth, first, last, parent = forest(lengths, edges)
    count = np.concatenate(([0], np.cumsum(n)))
    leaf = np.concatenate(([0], np.cumsum([(edges[i] if i + 1 < m else after) < lengths[i] for i in range(m)])))
    left_ids, right_ids = prefix_ids(keys[0], max(before, 0)), prefix_ids(keys[-1], max(after, 0))
    nodes = sorted(range(len(depth)), key=lambda k: -depth[k])
    lowest, saved, children = [None] * len(depth), [0] * len(depth), [0] * len(depth)

    def begins(k: int, d: int) -> bool:
        return first[k] > 0 or before < d

    def opens(k: int, d: int) -> bool:
        return not begins(k, d) or (last[k] == m - 1 and after >= d)

    def name(k: int, d: int) -> bytes:
        return left_ids[d] if not begins(k, d) else right_ids[d]

    rows, waiting = [], {}
    for k in nodes:  # children come before their parents
        at, up = depth[k], parent[k]
        members = int(count[last[k] + 1] - count[first[k]])
        if lengths[first[k]] == at:
            lowest[k] = low[first[k]] if lowest[k] is None else min(lowest[k], low[first[k]])
        below = depth[up] if up >= 0 else -1
        for d in range(at, below, -1):
            w = int(words[first[k]][d - 1]) if d else 0
            saved[k] += members * w - (w if begins(k, d) else 0)
            opened = opens(k, d)
            parent_open = d > 0 and opens(k, d - 1) if d - 1 > below else d > 0 and opens(up, d - 1)
            rows.append([
                block, opened, name(k, d) if opened else None,
                (name(k, d - 1) if d - 1 > below else name(up, d - 1)) if parent_open else None,
                lowest[k], d, lowest[k] if d and d - 1 > below and not parent_open else None, members,
                children[k] if d == at else int(begins(k, d + 1)), int(leaf[last[k] + 1] - leaf[first[k]]), saved[k],
                ends[first[k]] if d == at and lengths[first[k]] == d else None])
            if d and d - 1 == below and not parent_open:
                waiting.setdefault(up, []).append(rows[-1])
        for row in waiting.pop(k, []):
            row[6] = lowest[k]
        if up >= 0:
            saved[up] += saved[k]
            children[up] += begins(k, below + 1)
            lowest[up] = lowest[k] if lowest[up] is None else min(lowest[up], lowest[k])
    return [tuple(r) for r in rows]


def _blocks(size: int):
    """Rows of a range partition with its two neighbours (``side`` -1 and 1), in order, to nodes; blocks of ``size`` sequences."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        part, number, left = None, 0, None

        def done(rows: list[tuple], right: bytes | None) -> pd.DataFrame:
            nonlocal number, left
            out = block_nodes((part << 32) + number, left, right, *map(list, zip(*rows)))
            number, left = number + 1, rows[-1][0]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
            return frame.astype({"parent_conv_id": "Int64"})

        for batch in batches:
            for row in zip(*[batch[c] for c in ("part", "side", "keys", "words", "low", "n", "ends")]):
                if row[0] != part:
                    if held:
                        yield done(held, None)
                    held, part, number, left = [], row[0], 0, None
                if row[1] < 0:
                    left = row[2]
                elif row[1] > 0:
                    yield done(held, row[2])
                    held = []
                else:
                    if len(held) == size:
                        yield done(held, row[2])
                        held = []
                    held.append(row[2:])
        if held:
            yield done(held, None)

    return make


def trie(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """Nodes of the trie over the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns are ordered by number (null first), equal numbers by the SHA-256 of role and text, so repeated turns count as often
    as they are there.  Null roles and texts are empty.  Rows with a null conv_id belong to no conversation and are left
    out; without others the result has no rows, not even the root.  Remainders of negative ids are negative (they lead to
    the family's member next to zero).  Extra columns are ignored.

    A conversation is one row of 16 bytes and a number for each turn; texts are read once and not kept.  Equal
    conversations become one sequence before they are sorted, so copies of one conversation don't fill a task.  The
    sequences are sorted by range and cut into blocks.  Each block gives its forest by union-find over its neighbours'
    common prefixes; nodes that go on beyond a block are contracted to a piece each, and the pieces of all blocks are added.
    """
    members = cut(rebuilt(conversations).withColumn("seq", F.sha2("keys", 256)), "rebuilt")
    equal = members.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    different = members.join(equal, ["seq", "conv_id"]).withColumnRenamed("conv_id", "low").join(id_lists(members.select("conv_id", "seq")), "seq").select("keys", "words", "low", "n", "ends")
    ranged = cut(different.repartitionByRange("keys").withColumn("part", F.spark_partition_id().cast("long")), "sequences")
    ends = cut(ranged.groupBy("part").agg(F.min("keys").alias("first"), F.max("keys").alias("last")), "range_ends")
    order = Window.orderBy("part")  # one row per range partition
    beside = ends.select("part", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))
    beside = beside.select("part", F.explode(F.array(
        F.struct(F.lit(-1).alias("side"), F.col("left").alias("keys")), F.struct(F.lit(1).alias("side"), F.col("right").alias("keys"))
    )).alias("x")).select("part", "x.*").where("keys IS NOT NULL")
    rows = ranged.withColumn("side", F.lit(0)).unionByName(beside, allowMissingColumns=True)
    nodes = cut(rows.repartition("part").sortWithinPartitions("part", "side", "keys").select(
        "part", "side", "keys", "words", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("n", F.lit(0)).alias("n"), "ends"
    ).mapInPandas(_blocks(size), NODE_SCHEMA), "trie")
    return merged(nodes)


def merged(nodes: DataFrame) -> DataFrame:
    """The whole trie: pieces of open nodes added up, and the parents' smallest members filled in.

    Nodes below an open one look up its member under their own block, so that a node which a third of all nodes lie below
    is met once per block.
    """
    pieces = nodes.where("open")
    whole = cut(pieces.groupBy("id").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_id").alias("parent_id"),
        *[F.sum(c).alias(c) for c in _ADDED], F.max("ends_sha256").alias("ends_sha256")), "open_nodes")
    known = whole.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("known"))
    by_block = pieces.select("block", F.col("id").alias("parent_id")).distinct().join(known, "parent_id")
    names = ["conv_id", "depth", *_ADDED]
    parent = F.coalesce("parent_conv_id", "known").alias("parent_conv_id")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    inner = nodes.where("NOT open").join(by_block, ["block", "parent_id"], "left").select(*names, parent, ends)
    outer = whole.withColumn("parent_conv_id", F.lit(None).cast("long")).join(known, "parent_id", "left").select(*names, parent, ends)
    return inner.unionByName(outer)


SQL = rf"""
WITH crc_of AS (SELECT DISTINCT conv_id::VARCHAR AS x FROM conversations WHERE conv_id IS NOT NULL),
{CRC_SQL},
t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT x::BIGINT AS conv_id, crc % 4 AS h FROM crc),
r AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, key, words FROM (
  SELECT c.conv_id, 0 AS own, pos, key, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, key, words FROM c JOIN t USING (conv_id) WHERE pos > h)),
p AS MATERIALIZED (
  SELECT conv_id, depth, words, sha256(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS id FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS MATERIALIZED (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(id) OVER (PARTITION BY conv_id ORDER BY depth) AS child FROM p),
n AS MATERIALIZED (
  SELECT id, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, count(DISTINCT child) AS n_children, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (child IS NULL), '')) AS ends_sha256 FROM q GROUP BY id),
s AS (SELECT a.id, sum((b.n_convs - 1) * b.words) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves
  FROM n b JOIN q a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY a.id)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (id) LEFT JOIN n u ON u.id = n.parent
"""
