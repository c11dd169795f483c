"""Benchmark decontamination by verbatim windows, and by template windows with consistent slots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from graphwarden.functions.storage import cut
from graphwarden.llm.hashing import Windows, chunks, code_points, mix, runs, signed
from graphwarden.llm.streams import among, apart, bitmap, rows_like

#: tokens of a window, and how many of a template window's must be plain words (shorter items are one window, with half of
#: it plain words); windows of words as they stand need none
WINDOW, PLAIN = 8, 4
#: tokens of one item that a document must hold in a row to count as contaminated (or the whole item, if it is shorter)
COVERED = 13
#: benchmark windows up to which the join broadcasts them
SMALL_WINDOWS = 200_000
#: fixed words: units of measure that a number may stand in front of
UNITS = """mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr day days week weeks month months year years hour hours
minute minutes second seconds meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams
kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons percent dollar dollars euro euros cent
cents usd eur gbp mph kmh kph hz khz mhz ghz kb mb gb tb watt watts volt volts kw kwh degree degrees celsius fahrenheit""".split()

_N = 0x250
_LETTER = np.array([chr(i).isalpha() for i in range(_N)])
_DIGIT = np.array([chr(i).isdecimal() for i in range(_N)])
_UPPER = np.array([chr(i).isupper() for i in range(_N)])

_CASED = 0x1F000  # characters from here on have no case


def _folded(c: str) -> int:
    """The character that all cases of ``c`` have in common, ``c`` itself where that is not one character."""
    return next((ord(x) for x in (c.upper().casefold(), c.casefold(), c.lower()) if len(x) == 1), ord(c))


_FOLD = np.array([i if 0xD800 <= i < 0xE000 else _folded(chr(i)) for i in range(_CASED)], np.uint32)
#: small letters that are several in upper case
_WIDE = {c: c.upper().casefold() for c in map(chr, range(0x80, 0xFB18)) if len(c.upper()) > 1}
_WIDE_RE = re.compile(f"[{''.join(_WIDE)}]")
NUMBER, UNIT, NAME = 1, 2, 3
_KINDS = mix(np.arange(11, 15, dtype=np.uint64))
#: layers of windows: over words as they stand, case ignored, over templates, and over templates in which names are joined
LITERAL, TYPED, JOINED = 0, 1, 2
_SALTS = mix(np.arange(21, 24, dtype=np.uint64))
_UNIT_HASHES = np.sort(np.concatenate([
    Windows(mix(code_points(u).astype(np.uint64)))(np.array([0]), np.array([len(u)])) for u in UNITS]))


class Layer:
    """Windows over one reading of the tokens of several texts.

    ``first`` has the token with which each unit of the layer begins, and the number of tokens as its end; units do not
    cross texts.  ``plain`` says which units are plain words.
    """

    def __init__(self, kind: int, first: np.ndarray, values: np.ndarray, plain: np.ndarray, bounds: np.ndarray):
        self.first = first
        self.bounds = np.searchsorted(first[:-1], bounds)
        self.window = Windows(values ^ _SALTS[kind])
        self.plain = np.concatenate(([0], np.cumsum(plain)))

    def __len__(self) -> int:
        return len(self.first) - 1

    def windows(self, n: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """First units and hashes of the windows of ``n`` units between two units that hold enough plain words."""
        at = np.arange(start, max(start, end - n + 1))
        at = at[self.plain[at + n] - self.plain[at] >= (PLAIN if n == WINDOW else (n + 1) // 2)]
        return at, self.window(at, at + n)


class Tokens:
    """Tokens of several texts: where they stand, what slot they are (0: a plain word), and their layers of windows.

    A token is a run of letters or a number (digits, with points and commas between them).  Numbers, units after a number,
    and words that begin with a capital are slots; a slot's template hash is that of its type alone.  The literal layer
    has no slots: it is made of the tokens' texts, case ignored.  In the joined layer a run of names is one name.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts = [t if t.isascii() else _WIDE_RE.sub(lambda m: _WIDE[m[0]], t) for t in texts]
        blob = code_points("\n" + "\n\n".join(texts) + "\n")
        low = np.minimum(blob, _N - 1)
        wide = blob >= _N
        letter = np.where(wide, blob > 0x2BF, _LETTER[low]) & ~((blob >= 0x2000) & (blob <= 0x2BFF))
        digit = ~wide & _DIGIT[low]
        joint = (blob == 46) | (blob == 44)
        digit[1:-1] |= joint[1:-1] & digit[:-2] & digit[2:]
        word_start, word_end = runs(letter)
        number_start, number_end = runs(digit)
        starts = np.concatenate((word_start, number_start))
        order = np.argsort(starts, kind="stable")
        self.start = starts[order]
        self.end = np.concatenate((word_end, number_end))[order]
        number = (np.arange(len(order)) >= len(word_start))[order]
        folded = np.where(blob < _CASED, _FOLD[np.minimum(blob, _CASED - 1)], blob)
        value = Windows(mix(folded.astype(np.uint64)))(self.start, self.end)
        upper = np.where(wide[self.start], False, _UPPER[low[self.start]]) if len(order) else np.zeros(0, bool)
        near = np.zeros(len(order), bool)
        near[1:] = number[:-1] & (self.start[1:] - self.end[:-1] <= 1)
        unit = near & ~number & np.isin(value, _UNIT_HASHES)
        self.slot = np.select([number, unit, upper], [NUMBER, UNIT, NAME], 0).astype(np.int8)
        template = np.where(self.slot == 0, value, _KINDS[self.slot])
        lengths = np.array([len(t) for t in texts])
        self.origin = 1 + np.concatenate(([0], np.cumsum(lengths + 2)))
        self.bounds = np.searchsorted(self.start, self.origin)
        each, plain = np.arange(len(order) + 1), self.slot == 0
        name = self.slot == NAME
        head = np.ones(len(order), bool)
        head[1:] = ~(name[1:] & name[:-1])
        head[self.bounds[self.bounds < len(order)]] = True
        self.layers = {
            LITERAL: Layer(LITERAL, each, value, np.ones(len(order), bool), self.bounds),
            TYPED: Layer(TYPED, each, template, plain, self.bounds),
            JOINED: Layer(JOINED, np.append(np.flatnonzero(head), len(order)), template[head], plain[head], self.bounds)}

    def slots(self, kind: int, i: int, at: int, n: int) -> list[tuple[int, int, str]]:
        """First token and end (counted in text ``i``), and the text, of each slot among ``n`` units of a layer from ``at``."""
        if kind == LITERAL:
            return []
        first, a, shift, text = self.layers[kind].first, int(self.bounds[i]), int(self.origin[i]), self.texts[i]
        out = []
        for k, end in zip(first[at:at + n].tolist(), first[at + 1:at + n + 1].tolist()):
            if self.slot[k]:
                words = [text[self.start[j] - shift:self.end[j] - shift] for j in range(k, end)]
                out.append((k - a, end - a, " ".join(words)))
        return out


_WINDOWS = "layer int, hash long, at int, n int, slots array<string>"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_tokens, layer, hash, at, n, from, past (the window's tokens), slots of every window of every item.

    A slot is written ``from:past=text``.
    """
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                tokens = Tokens(texts[a:b])
                for i in range(b - a):
                    shift, size = int(tokens.bounds[i]), int(tokens.bounds[i + 1] - tokens.bounds[i])
                    for kind, layer in tokens.layers.items():
                        start, end = int(layer.bounds[i]), int(layer.bounds[i + 1])
                        n = min(WINDOW, end - start)
                        if not n:
                            continue
                        at, hashes = layer.windows(n, start, end)
                        for k, h in zip(at.tolist(), signed(hashes)):
                            slots = [f"{x}:{y}={text}" for x, y, text in tokens.slots(kind, i, k, n)]
                            out.append((batch["item_id"].iloc[a + i], size, int(layer.first[k]) - shift,
                                        int(layer.first[k + n]) - shift, kind, h, k - start, n, slots))
            if out:
                yield pd.DataFrame(out, columns=["item_id", "item_tokens", "from", "past", "layer", "hash", "at", "n", "slots"])

    items = rows_like(benchmark, ["item_id", "text"]).where("item_id is not null and text is not null")
    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().mapInPandas(
        make, f"item_id long, item_tokens int, from int, past int, {_WINDOWS}")


def document_windows(docs: DataFrame, bits: np.ndarray, lengths: list[tuple[int, int]]) -> DataFrame:
    """row_key, layer, hash, at, n, slots of the windows (layer and length) of all documents that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # 1 MB at any size

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sent.value
        for batch in batches:
            texts = batch["text"].tolist()
            out = []
            for a, b in chunks(texts):
                tokens = Tokens(texts[a:b])
                for kind, n in lengths:
                    layer = tokens.layers[kind]
                    at, hashes = layer.windows(n, 0, len(layer))
                    hashes = signed(hashes)
                    hit = among(bits, hashes)
                    at, hashes = at[hit], hashes[hit]
                    doc = np.searchsorted(layer.bounds, at, "right") - 1
                    inside = at + n <= layer.bounds[doc + 1]
                    for k, h, i in zip(at[inside].tolist(), hashes[inside], doc[inside].tolist()):
                        slots = [text for _, _, text in tokens.slots(kind, i, k, n)]
                        out.append((batch["row_key"].iloc[a + i], kind, h, k - int(layer.bounds[i]), n, slots))
            if out:
                yield pd.DataFrame(out, columns=["row_key", "layer", "hash", "at", "n", "slots"])

    return docs.where("text is not null").mapInPandas(make, f"row_key long, {_WINDOWS}")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row_key, item_id, covered: documents that hold enough of an item, and how many of its tokens in a row.

    Windows of one layer that agree lie on a diagonal, the distance between their places in document and item.  Windows
    that follow one another without a gap in covered tokens are a stretch; the longest one counts.  In a stretch of
    templates each value of an item's slots must always be replaced by the same value: a stretch is cut at all slots of a
    value that is not, and its longest part counts.  The literal layer has no slots, so that words copied as they stand
    count whatever their case, however many of them are slots, and whatever clashes around them.  Tokens are counted in the
    item, so that a name of several words counts in full where the joined layer finds another in its place.
    """
    windows = cut(benchmark_windows(benchmark), "benchmark_windows")
    lengths = sorted((r["layer"], r["n"]) for r in windows.select("layer", "n").distinct().collect())  # WINDOW a layer at most
    found = document_windows(docs, bitmap(windows, "hash"), lengths)
    known = windows.select(
        "layer", "hash", "n", "item_id", "item_tokens", F.col("at").alias("item_at"), "from", "past",
        F.col("slots").alias("item_slots"))
    if windows.count() <= SMALL_WINDOWS:
        known = F.broadcast(known)
    met = found.join(known, ["hash", "layer", "n"]).select(
        "row_key", "item_id", "item_tokens", "layer", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "from", "past",
        "slots", "item_slots")
    met = cut(met.distinct(), "met")
    place = ["row_key", "item_id", "layer", "diagonal"]
    stretch = Window.partitionBy(*place).orderBy("item_at")
    cutoff = F.col("from") > F.coalesce(F.lag("past").over(stretch), F.lit(-1))
    grouped = met.withColumn("run", F.sum(cutoff.cast("int")).over(stretch))
    enough = F.col("covered") >= F.least(F.lit(COVERED), "item_tokens")
    whole = grouped.groupBy(*place, "run").agg(
        F.min("from").alias("from"), F.max("past").alias("past"), F.first("item_tokens").alias("item_tokens"))
    whole = whole.withColumn("covered", F.col("past") - F.col("from")).where(enough)
    # slots of the stretch: the values a name, number or unit of the item is replaced by
    slots = grouped.select(*place, "run", F.explode(F.arrays_zip("slots", "item_slots")).alias("s")).select(
        *place, "run", F.col("s.slots").alias("now"), F.split("s.item_slots", "[:=]", 3).alias("s")).select(
        *place, "run", "now", F.col("s")[2].alias("was"),
        F.struct(F.col("s")[0].cast("int").alias("from"), F.col("s")[1].cast("int").alias("past")).alias("spot"))
    clash = slots.groupBy(*place, "run", "was").agg(
        F.size(F.collect_set("now")).alias("n"), F.collect_set("spot").alias("spots")).where("n > 1")
    cuts = clash.groupBy(*place, "run").agg(F.sort_array(F.flatten(F.collect_list("spots"))).alias("cuts"))
    # the longest part of the stretch between the slots that clash
    parts = F.zip_with(
        F.concat(F.array("from"), F.col("cuts.past")), F.concat(F.col("cuts.from"), F.array("past")), lambda a, b: b - a)
    covered = whole.join(cuts, [*place, "run"], "left").withColumn(
        "covered", F.when(F.col("cuts").isNull(), F.col("covered")).otherwise(F.array_max(parts))).where(enough)
    return covered.groupBy("row_key", "item_id").agg(F.max("covered").alias("covered"))


def _keyed(docs: DataFrame) -> DataFrame:
    return rows_like(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("row_key"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, covered (tokens of the longest stretch, 0 if none) for each row of ``docs``.

    Null and empty texts hold nothing.  Rows with equal or null ids are judged one by one; equal texts are judged alike.
    Items that are null, empty or repeated match nothing more, those without enough plain words only what repeats their
    words.  Case is ignored where words are repeated.  An empty benchmark leaves every document clean.
    """
    base = _keyed(docs)
    per_row = matches(base, benchmark).groupBy("row_key").agg(
        F.countDistinct("item_id").alias("n_items"), F.max("covered").alias("covered"))
    joined = base.select("doc_id", "row_key").join(per_row, "row_key", "left")
    return joined.select(
        "doc_id", F.col("covered").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("covered", F.lit(0)).alias("covered"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    bad = cut(matches(_keyed(docs), benchmark).select("row_key").distinct(), "leaks")
    keyed = docs.withColumn("__key", F.xxhash64(docs["text"].cast("string")))
    some, rest = apart(keyed, "__key", bad, "row_key")
    kept = some.join(bad, F.col("__key") == F.col("row_key"), "leftanti")
    return kept.unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
