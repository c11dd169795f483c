"""Fuzzy line deduplication: MinHash bands find candidates, exact Jaccard verifies them, one line of each class stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from graphwarden.functions.storage import cut, discard
from graphwarden.functions.components import components
from graphwarden.llm.hashing import Windows, chunks, code_points, mix, signed
from graphwarden.llm.similar import candidates, verified_links
from graphwarden.llm.streams import among, apart, bitmap, cut_last, rows_like

#: characters of a shingle; shorter lines are one shingle
CHARS = 8
#: links have 100 * overlap >= 80 * union
NUM, DEN = 80, 100
#: a pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.999 at 0.8
BANDS, ROWS = 10, 3
#: lines a task remembers
TOLD = 200_000

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32)
_TIMES, _PLUS = _SEEDS[: BANDS * ROWS] | np.uint32(1), _SEEDS[BANDS * ROWS:]


#: values of the first characters, which nearly all characters are
_VALUES = mix(np.arange(1 << 8, dtype=np.uint64))


def _character_values(points: np.ndarray) -> np.ndarray:
    """``mix`` of each code point, looked up where all are of the first ones."""
    return _VALUES[points] if not len(points) or points.max() < len(_VALUES) else mix(points.astype(np.uint64))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; as ``np.unique``, which takes several times as long for the few values of a line."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _shingle_hashes(lines: list[str], chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines (none empty), the first of each line, and a hash of each whole line."""
    blob = code_points("".join(lines))
    sizes = np.array([len(x) for x in lines])
    ends = np.cumsum(sizes)
    hashes = Windows(_character_values(blob))
    every = hashes.every(chars)
    count = np.maximum(1, sizes - chars + 1)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    whole = hashes(ends - sizes, ends)
    short = sizes < chars
    # windows that reach into the next line are passed over; a short line has no window of its own
    inside = np.ones(len(every), bool)
    last = ends[:-1, None] - np.arange(1, chars)
    inside[last[(last >= 0) & (last < len(every))]] = False
    if not short.any():
        return every[inside], first, whole
    out = np.empty(int(count.sum()), np.uint64)
    own = np.repeat(short, count)
    out[own], out[~own] = whole[short], every[inside]
    return out, first, whole


def shingle_sets(lines: list[str], chars: int = CHARS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    out: list[np.ndarray] = []
    for a, b in chunks(lines):
        every, first, _ = _shingle_hashes(lines[a:b], chars)
        bounds = [*first.tolist(), len(every)]
        out += [_distinct(every[i:j]) for i, j in zip(bounds, bounds[1:])]
    return out


def band_keys(every: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash band keys of each line: rows are lines, columns are bands."""
    low = (every >> np.uint64(16)).astype(np.uint32)
    out, moved = np.empty((len(first), BANDS), np.uint64), np.empty_like(low)
    for band in range(BANDS):
        key = np.full(len(first), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(low, _PLUS[k], out=moved)
            np.multiply(moved, _TIMES[k], out=moved)
            key = mix(key + np.minimum.reduceat(moved, first))
        out[:, band] = key
    return out


def _lines(texts: list[str]) -> tuple[list[int], list[int], list[str], np.ndarray]:
    """Text, position and trimmed text of each line that isn't white space, and a hash of it."""
    doc, pos, lines = [], [], []
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            if line := line.strip():
                doc.append(i)
                pos.append(k)
                lines.append(line)
    digest = xxhash.xxh64_intdigest
    return doc, pos, lines, np.array([digest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64)


def _texts(batch: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch["text"]]


def line_rows(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """One row per line with text: doc_id, row_key, pos, line (a hash of the trimmed line), text.

    The trimmed text is there where the hash passes the filter, once for as long as a task remembers it, and null elsewhere.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # 1 MB

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, told = sent.value, set()
        for batch in batches:
            texts = _texts(batch)
            for a, b in chunks(texts, 1 << 19):
                doc, pos, lines, whole = _lines(texts[a:b])
                if not lines:
                    continue
                line = signed(whole)
                text = np.full(len(lines), None, object)
                for i in np.flatnonzero(among(bits, line)).tolist():
                    if (h := int(line[i])) not in told:
                        told.add(h)
                        text[i] = lines[i]
                if len(told) > TOLD:
                    told.clear()
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64").take(doc).array,
                    "row_key": batch["row_key"].to_numpy()[a:b][doc], "pos": np.array(pos, np.int32), "line": line, "text": text})

    return docs.mapInPandas(make, "doc_id long, row_key long, pos int, line long, text string")


def line_keys(docs: DataFrame, chars: int) -> DataFrame:
    """(key, node): the MinHash band keys of each different line of ``chars`` characters or more.

    A shorter line is one shingle of its own, which no other line has.  A task remembers lines, so that one which a third of
    all documents share gives its keys about once per task.
    """
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[int] = set()
        for batch in batches:
            texts = _texts(batch)
            for a, b in chunks(texts, 1 << 17):  # arrays of a chunk stay in the cache
                _, _, lines, whole = _lines(texts[a:b])
                new = {h: x for h, x in zip(whole.tolist(), lines) if len(x) >= chars and h not in told}
                if len(told) > TOLD:
                    told.clear()
                told.update(new)
                if new:
                    every, first, _ = _shingle_hashes(list(new.values()), chars)
                    keys = signed(band_keys(every, first))
                    yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(signed(np.array(list(new), np.uint64)), keys.shape[1])})

    return docs.mapInPandas(make, "key long, node long")


def _n_shingles(chars: int):
    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in shingle_sets(texts.tolist(), chars)])

    return size


def _keyed(docs: DataFrame) -> DataFrame:
    return rows_like(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_key"))


def dropped_lines(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """doc_id, row_key and drops (positions of lines, ascending) of the rows that lose lines.

    Equal lines are reduced to one node before bands are listed, so a line that a third of all documents share is one
    node.  The kept line of a class is the first one (by position) of its smallest document.
    """
    base = _keyed(docs)
    pairs = candidates(line_keys(base.select("text"), chars))
    wanted = cut(pairs.select("node").distinct(), "wanted")
    lines = cut(line_rows(base, bitmap(wanted, "node")), "lines")
    texts = lines.where(F.col("text").isNotNull()).select(F.col("line").alias("node"), "text")
    texts = texts.join(wanted, "node", "leftsemi").dropDuplicates(["node"])
    held = cut(texts.withColumn("size", _n_shingles(chars)("text")), "texts")
    found = verified_links(
        pairs.join(held.select("node", "size"), "node"), held.select("node", "text"), lambda x: shingle_sets(x, chars), NUM, DEN)
    classes = components(found)
    discard(pairs, wanted, held)
    distinct = cut(lines.groupBy("line").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc")), "distinct_lines")
    known = distinct.join(classes.withColumnRenamed("node", "line"), "line", "left")
    known = known.withColumn("component", F.coalesce("component", "line"))
    keepers = classes.select("component").distinct().join(known, "component").groupBy("component").agg(
        F.min("doc").alias("keeper"), F.lit(True).alias("linked"))  # the keeper is null where all rows have null ids
    several = cut(
        known.join(keepers, "component", "left").where("times > 1 or linked")
        .select("line", "component", F.coalesce("keeper", "doc").alias("keeper")), "several")
    hits = lines.select("doc_id", "row_key", "pos", "line").join(several, "line")
    place = F.rank().over(Window.partitionBy("doc_id", "component").orderBy("row_key", "pos"))
    return hits.withColumn("place", place).where(~(F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("place") == 1))).groupBy(
        "doc_id", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def _without():
    """Column function: a text without the lines at some positions."""
    def rest(text, drop):
        if drop is None or text is None:
            return text
        gone = set(drop)
        return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)

    @F.pandas_udf("string")
    def without(texts: pd.Series, drops: pd.Series) -> pd.Series:
        return pd.Series([rest(t, d) for t, d in zip(texts, drops)], dtype=object)

    return without


def dedup_lines(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """All columns of ``docs`` with repeated and nearly repeated lines gone from ``text``, and ``n_chars`` counted anew.

    Lines are what stands between line feeds, compared without white space at their ends; lines of white space alone always
    stay.  Two lines link if the Jaccard similarity of their 8-character shingles is 0.8 or more.  Of each class of linked
    lines one stays, anywhere in the table: the first one of the smallest doc_id.  Documents are never dropped: one that
    loses all its lines has an empty text.  Null texts stay null, equal rows keep the same lines, rows with a null id count
    as one document after all others, extra columns pass through.  The bands miss a link of similarity 0.8 with a
    probability of 0.0008, and less above; everything found is verified exactly.
    """
    drops = cut_last(lambda: dropped_lines(docs, chars), docs.sparkSession, "drops").select(
        F.col("row_key").alias("__row_key"), F.col("drops").alias("__drops"))
    keyed = docs.withColumn("__key", F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    some, rest = apart(keyed, "__key", drops, "__row_key")
    joined = some.join(drops, F.col("__key") == F.col("__row_key"), "left")
    out = joined.withColumn("text", _without()(F.col("text").cast("string"), F.col("__drops")))
    if "n_chars" in docs.columns:
        out, rest = [x.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) for x in (out, rest)]
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names).unionByName(rest.select(*names))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with text, before), n_chars and text of each document after deduplication."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return kept.select(
        "doc_id", F.coalesce(F.when(F.col("text").isNotNull(), n), F.lit(0)).alias("n_lines"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
