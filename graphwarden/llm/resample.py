"""Importance resampling: documents drawn by how much their n-grams look like those of a target collection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graphwarden.functions.numbering import number_rows
from graphwarden.functions.storage import cut
from graphwarden.llm.hashing import chunks
from graphwarden.llm.streams import rows_like

#: hashed features; the counts that reach the driver have so many rows at most
BUCKETS = 10_000
#: longest n-gram, fewest words of a document that may be drawn, share drawn (percent), seed of the draw
WORDS, LEAST, PERCENT, SEED = 1, 20, 10, 2024
#: characters of texts joined at once (a single longer text is a batch of its own)
BATCH = 1 << 20

#: separates the texts of a batch; no word holds it
SENTINEL = b"\x00"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(texts: list[str], longest: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a batch of texts, the text each is in, and how many words each text has.

    The texts are joined by a sentinel, so that one pass of the pattern finds the words of all of them.  An n-gram belongs
    to the text whose offset lies before its first word; those whose last word is in another text are masked.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    blob = SENTINEL.join(parts).lower()  # of bytes: A-Z alone
    offsets = np.cumsum([0, *[len(p) + 1 for p in parts]])
    words, starts = [], []
    for m in _WORD.finditer(blob):
        words.append(m.group())
        starts.append(m.start())
    text_of = np.searchsorted(offsets, np.array(starts, np.int64), "right") - 1
    hashes, owners, checks = [], [], [crc32(w) for w in words]
    for n in range(1, longest + 1):
        if n > 1:  # a checksum goes on from that of the n-gram one word shorter
            checks = [crc32(w, crc32(b" ", c)) for c, w in zip(checks, words[n - 1:])]
        first = text_of[:len(checks)]
        inside = first == text_of[n - 1:n - 1 + len(checks)]
        hashes.append(np.array(checks, np.int64)[inside] % buckets)
        owners.append(first[inside])
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(text_of, minlength=len(texts))


def _texts(df: DataFrame) -> DataFrame:
    return rows_like(df, ["text"]).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def bucket_counts(df: DataFrame, longest: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts: a task counts what it reads before anything is shuffled."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts, BATCH):
                total += np.bincount(features(texts[a:b], longest, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen, "n": total[seen]})

    return _texts(df).mapInPandas(make, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, longest: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket the log ratio of its share in ``target`` to that in ``raw`` (both plus one), in thousandths."""
    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in bucket_counts(df, longest, buckets).collect():  # ``buckets`` rows at most
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(raw), counts(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A standard Gumbel value for each id, in thousandths: adding it turns the highest scores into a draw by weight."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_features and weight (the mean gain of its n-grams, rounded down) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = sent.value
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts, BATCH):
                bucket, text, n_words = features(texts[a:b], longest, len(gain))
                n = np.bincount(text, minlength=b - a)
                order = np.argsort(text, kind="stable")
                sums = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
                ends = np.cumsum(n)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64").array, "n_words": n_words, "n_features": n,
                    "weight": (sums[ends] - sums[ends - n]) // np.maximum(n, 1)})

    base = rows_like(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.mapInPandas(make, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = WORDS, least: int = LEAST, percent: int = PERCENT,
             seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of ``docs``; rank is null where it isn't drawn.

    Of the documents with ``least`` words or more, ``percent`` percent (rounded down) with the highest scores are drawn.
    Features are all runs of 1 to ``longest`` words; null and empty texts have none and weigh 0.  Without target texts, or
    without documents, all counts are 0 there and the rules stay the same.  Ties go to the smaller doc_id; rows with equal
    ids are rows of their own, in the order of their weights.  Rows with a null id count in the statistics, have a weight,
    but no score and are never drawn.  Extra columns are ignored.

    Both passes read whole texts.  Ranks come from a sort by range, so no task holds all candidates.
    """
    gain = gains(docs, target, longest, buckets)
    scored = cut(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = F.coalesce((F.col("n_words") >= least) & F.col("score").isNotNull(), F.lit(False))
    n_drawn = scored.where(F.col("n_words") >= least).where("doc_id IS NOT NULL").count() * percent // 100
    ranked = number_rows(
        scored.where(able).withColumn("high", -F.col("score")).withColumn("heavy", -F.col("weight")),
        ["high", "doc_id", "heavy", "n_features"], "rank")
    drawn = F.when(F.col("rank") <= n_drawn, F.col("rank"))
    names = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*names, drawn.cast("long").alias("rank")).unionByName(
        scored.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))


#: checksums in SQL: a step for each byte over a table of 256 values, itself eight steps for each value
CRC_SQL = r"""
crc_table AS (SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
crc AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(encode(x))) + 1, 2), lambda k: ('0x' || substr(hex(encode(x)), k, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM crc_of, crc_table)
"""

SQL = rf"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)),
n AS MATERIALIZED (SELECT doc_id, x, count(*) AS n FROM w GROUP BY doc_id, x),
crc_of AS (SELECT DISTINCT x FROM n),
{CRC_SQL},
b AS MATERIALIZED (SELECT doc_id, crc % 10000 AS bucket, n FROM n JOIN crc USING (x)),
c AS (SELECT bucket, coalesce(sum(n) FILTER (doc_id IS NOT NULL), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (doc_id IS NULL), 0)::DOUBLE AS t FROM b GROUP BY bucket),
a AS (SELECT sum(s) AS sa, sum(t) AS ta FROM c),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sa + 10000) / ((s + 1) * (ta + 10000))))::BIGINT AS gain FROM c, a),
d AS (SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM b JOIN g USING (bucket) WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= 20) OVER () AS able FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * able // 100 THEN k END AS rank FROM r
"""
