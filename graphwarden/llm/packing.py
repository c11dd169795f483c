"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window, functions as F

from graphwarden.functions.storage import cut
from graphwarden.llm.streams import rows_like

CAPACITY = 4096
END_ID = 1
#: words of a generation; a Python worker remembers two and forgets the older one when the younger is full
CACHE_WORDS = 200_000
#: a fixed value of the tokenizer file, checked against it when it is loaded
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin bytes stand for themselves, the others for letters from 256 on, in order."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(other)}


class Remembered(dict):
    """Ids of what stands between white space, as little-endian bytes: found once in the tokenizer's model, then remembered.

    What was asked for lately stays, up to a bound.  A word with a sign behind it is made of the two and takes no room.
    """

    def __init__(self, tokenizer, words):
        super().__init__()
        self.letters, self.model, self.words, self.older = _byte_letters(), tokenizer.model, words, {}

    def of_word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(self.letters[b] for b in word.encode())
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        if run[-1] in ",.!?;:" and run[:-1].isalpha():
            return self[run[:-1]] + self[run[-1]]
        value = self.older.get(run)
        if value is None:
            parts = [run] if run.isalpha() else self.words.findall(run)
            value = self.of_word(run) if len(parts) == 1 else b"".join([self[p] for p in parts])
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[run] = value
        return value


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    split = spec["pre_tokenizer"] or {}
    plain = [
        (spec["normalizer"] or {}).get("normalizers") == [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        [(p.get("type"), (p.get("pattern") or {}).get("Regex"), p.get("use_regex")) for p in split.get("pretokenizers", [])]
        == [("Split", WORD_PATTERN, None), ("ByteLevel", None, False)],
    ]
    return tokenizer, all(plain), Remembered(tokenizer, regex.compile(WORD_PATTERN))


def token_ids(text: str, path: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit values, exactly as the tokenizer gives them.

    For the word tokenizer (lower-cased, split by ``WORD_PATTERN``) the runs between white space are looked up one by one;
    texts that may hold special tokens or letters outside Latin, whose lower case or composition may depend on their
    surroundings, and all texts of other tokenizers are encoded whole.
    """
    tokenizer, plain, known = _tokenizer(path)
    if not plain or "<|" in text or _NOT_SIMPLE.search(text):
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return b"".join(map(known.__getitem__, text.lower().split()))


_NOT_SIMPLE = re.compile("[^\\x09\\x0a\\x0d\\x20-\\x7e\\u00a1-\\u012f\\u0132-\\u017f\\u2010-\\u2026]")


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: its ids, then ``end_id``, cut every ``capacity`` ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"]):
                ids = token_ids(text, tokenizer_path) + end if isinstance(text, str) else end
                step = 4 * capacity
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return rows_like(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        cut_up, PIECE_SCHEMA)


def fullest(free: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """Lengths (longest first, each at most as often as counted) whose sum comes closest to ``free`` from below.

    Subset-sum over a bitset: bit s is set if some choice of the lengths so far sums to s.  The bitset before each item is
    kept, so that the choice is read back from the last one.  It stops as soon as ``free`` itself can be reached.
    """
    mask, reach, steps = (1 << (free + 1)) - 1, 1, []
    for length in lengths:
        if length > free:
            continue
        left, size = min(counts[length], free // length), 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
            if reach >> free & 1:
                break
        if reach >> free & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen[::-1]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bins of minimum slack as ``(how often, lengths)``, for pieces counted by length.

    Each bin takes the longest piece left and the fullest combination beside it.  The same bin is repeated as long as
    pieces of its lengths last, so the work depends on the number of distinct lengths (below ``capacity``), not of pieces.
    """
    counts = {length: n for length, n in histogram.items() if n > 0}
    order, bins = sorted(counts, reverse=True), []
    while order:
        first = order[0]
        counts[first] -= 1
        chosen = [first, *fullest(capacity - first, [x for x in order if counts[x]], counts)]
        counts[first] += 1
        need = {x: chosen.count(x) for x in chosen}
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
        bins.append((times, chosen))
        order = [x for x in order if counts[x]]
    return bins


def _layout(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each bin kind and length: length, first and past-last rank, pieces per bin, first sequence, offset."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, lengths in bins:
        offset = 0
        for length in dict.fromkeys(lengths):
            n = lengths.count(length)
            start = used.get(length, 0)
            used[length] = start + n * times
            out.append((length, start, used[length], n, sequence, offset))
            offset += n * length
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with the sequence each goes to and its place there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text is one piece of ``end_id``
    alone; rows with a null id or with equal ids are documents of their own.  An empty table gives no rows.

    Only the number of pieces by length (at most ``capacity`` rows) reaches the driver, which plans the bins.  Pieces are
    ranked within their length by (length, written partition), so that a length shared by a third of all pieces is ranked
    in many tasks, and find their bin by rank in the plan, whose size is bounded by the number of distinct lengths.
    """
    spark = docs.sparkSession
    held = cut(pieces(docs, tokenizer_path, capacity, end_id).withColumn("bucket", F.spark_partition_id()), "pieces")
    by_bucket = held.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_length = by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    layout = _layout(plan_bins({r["length"]: r["n"] for r in by_length}, capacity))
    plan = spark.createDataFrame(
        layout or [(0, 0, 0, 1, 0, 0)],
        "p_length long, first long, past long, each long, p_sequence long, p_offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_bucket.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = (
        held.withColumn("rank", rank - 1).join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("skip")))
    at = F.col("rank") - F.col("first")
    return ranked.join(
        F.broadcast(plan),  # some rows for each distinct length
        (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("p_offset") + at % F.col("each") * F.col("length")).alias("offset"))
