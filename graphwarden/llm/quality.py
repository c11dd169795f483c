"""Quality scores by nearest-neighbour voting in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphwarden.llm.hashing import Windows, chunks, code_points, mix
from graphwarden.llm.streams import rows_like
from graphwarden.llm.toxicity import held_out, training_sample

#: hashed terms (character n-grams), and dimensions of the latent space
TERMS, LATENT = 1 << 12, 64
NGRAMS = (1, 2, 3)
#: bound of the training sample: labelled rows of classes 0 and 1, those with the smallest hash of their id
SAMPLE = (1500, 1500)
NEIGHBOURS = 15
THRESHOLD = 0.3
HELD_OUT = (5, 0)


def term_counts(texts: list[str]) -> np.ndarray:
    """Hashed character n-gram counts (rows are texts), damped by a logarithm; runs of white space are one space."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for a, b in chunks(texts):
        flat = [" ".join(t.split()) for t in texts[a:b]]
        blob = code_points("\n" + "\n".join(flat) + "\n")
        owner = np.cumsum(blob == 10) - 1
        hashes = Windows(mix(blob.astype(np.uint64)))
        total = np.zeros((b - a) * TERMS)
        for n in NGRAMS:
            at = np.arange(max(0, len(blob) - n + 1))
            same = (owner[at] == owner[at + n - 1]) if n > 1 else blob != 10
            if n == 1:
                same &= blob != 10
            at = at[same]
            key = (hashes.every(n)[at] & np.uint64(TERMS - 1)).astype(np.int64)
            total += np.bincount(owner[at] * TERMS + key, minlength=len(total))[: len(total)]
        out[a:b] = np.log1p(total).reshape(b - a, TERMS)
    return out


class Space:
    """Latent space of the labelled sample: inverse document frequencies, principal directions, and the labelled vectors."""

    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 5):
        counts = term_counts(texts) if texts else np.zeros((1, TERMS), np.float32)
        self.labels = labels if len(labels) else np.array([0.5])
        self.share = float(self.labels.mean())
        self.weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        scaled = self._scaled(counts)
        self.center = scaled.mean(0)
        scaled = scaled - self.center
        # truncated singular value decomposition by random projection and power steps
        rng = np.random.default_rng(seed)
        span = rng.normal(size=(len(scaled), LATENT + 16)).astype(np.float32)
        for _ in range(4):
            span, _ = np.linalg.qr(scaled @ (scaled.T @ span)) if len(scaled) > LATENT else np.linalg.qr(scaled @ scaled.T)
        _, _, axes = np.linalg.svd(span.T @ scaled, full_matrices=False)
        self.axes = axes[:LATENT].T.astype(np.float32)
        self.vectors = self._unit(scaled @ self.axes)

    def _scaled(self, counts: np.ndarray) -> np.ndarray:
        scaled = counts * self.weights
        return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str], block: int = 512) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors: weights are similarities, sharpened by a power."""
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), block):
            part = texts[at:at + block]
            vectors = self._unit((self._scaled(term_counts(part)) - self.center) @ self.axes)
            near = vectors @ self.vectors.T  # exact cosines of a block of texts with all labelled vectors
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6).astype(np.float64) ** 4
            out[at:at + block] = (weight * self.labels[top]).sum(1) / weight.sum(1)
            for i, text in enumerate(part):
                if not text.strip():
                    out[at + i] = 0.0
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Space:
    return Space(*training_sample(docs, labels, "quality", HELD_OUT, sample))


def quality(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Rows with equal ids are scored one by one; a text that is null or white space alone scores 0; a null id is never held
    out.  Labels that are null, neither 0 nor 1, or of unknown documents are ignored; without any, other texts score 0.5.

    The space is fitted on a bounded sample of the labelled rows.  It is broadcast (about 1 MB of axes and 256 bytes for
    each labelled row of the sample), and every document's cosines with all labelled vectors are computed in blocks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        space = sent.value
        for batch in batches:
            yield pd.Series(space.scores([t if isinstance(t, str) else "" for t in batch]))

    scored = rows_like(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", HELD_OUT).alias("held_out"),
        score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
