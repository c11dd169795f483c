"""Token counts by greedy longest match, in time linear in the text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphwarden.llm.streams import rows_like

#: words remembered by a Python worker
CACHE_WORDS = 200_000


class Automaton:
    """Trie over a vocabulary of byte strings with failure links and counts of the tokens popped on the way.

    After reading some bytes the automaton stands at the trie node of what is not yet settled.  If the next byte has no
    child there, the failure link leads to the node of what is left once the settled tokens are popped; how many those are
    was counted when the link was made, so a word's number of tokens is found without building one.
    """

    def __init__(self, vocabulary):
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        token = [False]
        parent, order = [(0, 0)], [0]
        for word in vocabulary:
            node = 0
            for byte in word:
                at = self.child.get(node << 8 | byte)
                if at is None:
                    at = self.child[node << 8 | byte] = len(token)
                    token.append(False)
                    parent.append((node, byte))
                node = at
            if node:
                token[node] = True
        depth = [0] * len(token)
        for node in range(1, len(token)):
            depth[node] = depth[parent[node][0]] + 1  # parents are made before their children
        order = sorted(range(1, len(token)), key=depth.__getitem__)
        self.fail, self.pops = [-1] * len(token), [0] * len(token)
        for node in order:
            if token[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            up, byte = parent[node]
            back, count = self.fail[up], self.pops[up]
            while back >= 0 and (back << 8 | byte) not in self.child:
                count += self.pops[back]
                back = self.fail[back]
            if back >= 0:
                self.fail[node], self.pops[node] = self.child[back << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Number of tokens of a word; 1 (one unknown token) if the vocabulary cannot spell it."""
        child, fail, pops = self.child, self.fail, self.pops
        node = total = 0
        for byte in word:
            at = child.get(node << 8 | byte)
            while at is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                at = child.get(node << 8 | byte)
            node = at
        while node > 0:
            total += pops[node]
            node = fail[node]
        return total if node == 0 else 1


def vocabulary(path: str) -> list[bytes]:
    """Byte strings of a rank file: lines of base64 text and a rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class _Counts(dict):
    """Number of tokens of a word (with a space in front), remembered up to a bound."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(b" " + word.encode("utf-8", "surrogatepass"))
        return n


@lru_cache(maxsize=2)
def counts(path: str) -> _Counts:
    return _Counts(Automaton(vocabulary(path)))


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of ``docs``.

    Words are what stands between white space; each one, with a space in front, is spelled by the longest token of the
    vocabulary that fits, again and again from left to right.  A null or empty text has no words and no tokens; rows with
    equal or null ids are counted one by one.
    """
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = counts(vocabulary_path)
        for batch in batches:
            words = [t.split() if isinstance(t, str) else [] for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_words": [len(w) for w in words],
                "n_tokens": [sum(map(known.__getitem__, w)) for w in words]})

    return rows_like(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        make, "doc_id long, n_words long, n_tokens long")
