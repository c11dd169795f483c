"""Toxicity scores from subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graphwarden.llm.hashing import Windows, chunks, code_points, mix, runs
from graphwarden.llm.streams import rows_like

BUCKETS = 1 << 18
NGRAMS = (3, 4, 5)
DIMENSIONS = 16
#: words of a window, and from one window to the next; a text's score is that of its worst window
WINDOW, STRIDE = 24, 12
#: a window of fewer subwords is averaged as if it had so many
LEAST = 150
#: bound of the training sample: labelled rows of classes 0 and 1, those with the smallest hash of their id
SAMPLE = (2400, 1200)
EPOCHS = 16
THRESHOLD = 0.3
HELD_OUT = (4, 2)



@cache
def letters() -> np.ndarray:
    """Whether each code point belongs to words: letters, marks on letters and numbers of any script, and @."""
    return np.array([chr(i).isalpha() or chr(i).isdigit() or chr(i) == "@" if i < 0x250 else unicodedata.category(chr(i))[0] in "LMN"
                     for i in range(0x110000)])


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the subwords of all texts, the word of each, and the words of each text as offsets.

    Subwords are the whole word and its character n-grams with the word's edges marked; letters are lower-cased, and
    anything but letters, marks, digits and @ ends a word, dashes and curly quotes as well.  Of equal words in a row, only the first is kept.
    """
    blob = code_points("\n" + "\n".join(t.lower().replace("\n", " ") for t in texts) + "\n")
    inside = letters()[blob]
    hashes = Windows(mix(np.where(inside, blob, 0).astype(np.uint64) + np.uint64(1)))
    starts, ends = runs(inside)
    word_at = np.cumsum(np.concatenate(([False], inside[1:] & ~inside[:-1]))) - 1  # the word a position lies in or follows
    outside = np.concatenate(([0], np.cumsum(~inside)))
    at, key = [starts - 1], [hashes(starts - 1, ends + 1)]
    for n in NGRAMS:
        i = np.flatnonzero(outside[n - 1: len(blob)] - outside[1: len(blob) - n + 2] == 0)[: max(0, len(blob) - n + 1)]
        i = i[i + n <= len(blob)]
        at.append(i)
        key.append(hashes(i, i + n))
    at, key = np.concatenate(at), np.concatenate(key)
    word = np.where(inside[at], word_at[at], word_at[at] + 1).astype(np.int32)
    bounds = np.searchsorted(starts, np.flatnonzero(blob == 10))
    # a word said again and again counts once
    value = hashes(starts, ends)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = value[1:] != value[:-1]
    fresh[bounds[bounds < len(starts)]] = True
    number = np.concatenate(([0], np.cumsum(fresh)))
    kept = fresh[word]
    return (key[kept] & np.uint64(BUCKETS - 1)).astype(np.int32), number[word[kept]].astype(np.int32), number[bounds]


def windows(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last word of each window, and the first window of each text (texts without words have none)."""
    n = np.diff(texts)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    offsets = np.concatenate(([0], np.cumsum(count)))
    k = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)
    end = np.minimum(np.repeat(texts[:-1], count) + k * STRIDE + WINDOW, np.repeat(texts[1:], count))
    start = np.maximum(end - WINDOW, np.repeat(texts[:-1], count))  # the last one is as long as the others
    return start, end, offsets


def running(values: np.ndarray, dtype=np.float64) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values, dtype=dtype)))


def scores(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of each text, that of its worst window; 0 for a text without words."""
    out = np.empty(len(texts))
    for a, b in chunks(texts):
        key, word, bounds = subwords(texts[a:b])
        start, end, offsets = windows(bounds)
        total = running(np.bincount(word, weights[key], int(bounds[-1])))
        size = running(np.bincount(word, minlength=int(bounds[-1])))
        mean = (total[end] - total[start]) / np.maximum(size[end] - size[start], LEAST)
        none = np.diff(offsets) == 0
        top = np.full(b - a, -np.inf)
        if len(mean):
            top[~none] = np.maximum.reduceat(mean, offsets[:-1][~none])
        out[a:b] = np.where(none, 0.0, 1 / (1 + np.exp(-np.clip(top + bias, -40, 40))))
    return out


def train(texts: list[str], labels: np.ndarray, prior: float | None = None, epochs: int = EPOCHS,
          seed: int = 7) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the bias, after embeddings and softmax were trained jointly.

    A text's gradient goes through its worst window.  The first embedding coordinate starts from the log odds of a bucket
    among the texts that hold it, so that the first windows chosen are already telling.  Returns the product of embeddings
    and softmax, all that scoring needs.  The bias stays at the log odds of ``prior`` (by default the share of label 1), so
    that a text without any evidence gets the prior.  Without texts of both labels every score is the prior.
    """
    labels = np.asarray(labels, np.float64)
    share = float(labels.mean()) if len(labels) else 0.5
    share = float(np.clip(share if prior is None else prior, 0.01, 0.99))
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    bags = []
    seen = np.zeros((2, BUCKETS))
    for text, y in zip(texts, labels):
        key, word, bounds = subwords([text])
        seen[int(y), np.unique(key)] += 1
        order = np.argsort(word, kind="stable")
        start, end, _ = windows(bounds)
        first = np.searchsorted(word[order], np.arange(int(bounds[-1]) + 1))
        bags.append((key[order], first[start], first[end]))
    rate = (seen + 0.5) / (np.array([[(labels == 0).sum()], [labels.sum()]]) + 1)
    evidence = np.minimum(1.0, seen.sum(0) / 8)  # rare buckets say little
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS))
    table[:, 0] = np.log(rate[1] / rate[0]) * evidence
    softmax = rng.normal(0, 0.01, (DIMENSIONS, 2))
    softmax[0] = -2, 2
    bias = np.array([0.0, np.log(share / (1 - share))])
    sums = np.full(BUCKETS, 1e-2)  # squared gradients so far, for steps that shrink by bucket
    usable = [i for i, bag in enumerate(bags) if len(bag[1])]
    for epoch in range(epochs):
        rate = 1.0 * (1 - epoch / epochs) + 0.02
        order = rng.permutation(usable)
        for at in range(0, len(order), 64):
            batch = order[at:at + 64]
            line = table @ (softmax[:, 1] - softmax[:, 0])
            picked = []
            for i in batch:
                key, start, end = bags[i]
                total = running(line[key])
                w = int(np.argmax((total[end] - total[start]) / np.maximum(end - start, LEAST)))
                picked.append(key[start[w]:end[w]])
            length = np.array([len(p) for p in picked])
            size = np.maximum(length, LEAST)
            flat = np.concatenate(picked)
            owner = np.repeat(np.arange(len(batch)), length)
            hidden = np.add.reduceat(table[flat], np.concatenate(([0], np.cumsum(length)[:-1])), axis=0) / size[:, None]
            logit = hidden @ softmax + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p - np.stack([1 - labels[batch], labels[batch]], 1)
            to_hidden = error @ softmax.T
            softmax -= rate * 0.2 * hidden.T @ error / len(batch)
            keys, where = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(where, to_hidden[owner, d] / size[owner], len(keys)) for d in range(DIMENSIONS)], 1)
            sums[keys] += (grad ** 2).mean(1)
            table[keys] -= rate * grad / np.sqrt(sums[keys])[:, None]
    return table @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


def held_out(doc_id: str = "doc_id", fold: tuple[int, int] = HELD_OUT) -> Column:
    """Whether the row's label must not be learned: crc32 of the id as text, modulo the number of folds."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(fold[0])) == fold[1], F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], sample: tuple[int, int]) -> tuple[list, np.ndarray]:
    """Whole texts of each label (0 and 1), at most ``sample`` of each, from rows that are not held out."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", fold)).distinct())
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y])
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = rows_like(docs, ["doc_id", "text"]).join(F.broadcast(chosen), "doc_id")  # as many ids as the sample has
    rows = (
        picked.where(F.col("text").isNotNull()).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        .orderBy("doc_id", "y").collect())  # bounded by the sample
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[np.ndarray, float]:
    texts, y = training_sample(docs, labels, "toxic", HELD_OUT, sample)
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    return train(texts, y, usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0])


def scorer(spark, model: tuple[np.ndarray, float]):
    """Column function: text to probability.  The model, one float for each bucket, is broadcast."""
    sent = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = sent.value
        for batch in batches:
            yield pd.Series(scores([t if isinstance(t, str) else "" for t in batch], weights, bias))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Rows with equal ids are scored one by one; a null text or one without words scores 0; a null id is never held out.
     Labels that are null, neither 0 nor 1, or of unknown documents are ignored.  No documents, no rows.
    """
    score = scorer(docs.sparkSession, fit(docs, labels, sample))
    scored = rows_like(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"),
        score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
