"""Importance resampling, the prefix trie of conversations and SuperMinHash near duplicates, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from graphwarden.llm import prefix_trie, resample, super_minhash

from test_similarity import classes, edited, sets_of
from test_text_operators import docs

CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, seq string, words int, depth long"


def drawn(rows, target, longest, least, percent, seed):
    def words(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def grams(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[k:k + n]).encode()) % 10000 for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(g for _, x in rows for g in grams(x)), Counter(g for x in target for g in grams(x))
    gain = {g: math.floor(1000 * math.log((t[g] + 1) * (s.total() + 10000) / ((s[g] + 1) * (t.total() + 10000)))) for g in s | t}
    out = []
    for i, x in rows:
        found = grams(x)
        weight = sum(gain[g] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(words(x)) >= least and i is not None])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], -r[2], r[1]))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_resampling(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "Straße", "日本", "x9"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(200)]
    rows += [(500, None), (501, ""), (502, "\x00 \x00--\n"), (503, "a\x00b\x00a"), (504, "same text here " * 10), (504, "same text here " * 10),
             (505, "same text here " * 10), (504, "w1 w2 other " * 10), (None, "nobody w1 w2 " * 20), (506, "Long W1 " * 60_000), (507, "x" * 300_000)]
    target = ["w1 w2 w3 w1", None, "", "Straße w1 \x00 w2"]
    given = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, doc_id string")
    for longest, percent in ((1, 10), (3, 37)):
        got = resample.resample(docs(spark, rows), given, longest=longest, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, drawn(rows, target, longest, 20, percent, 2024)))
    none = resample.resample(docs(spark, rows), given.limit(0), percent=100)
    assert sorted(map(str, map(tuple, none.collect()))) == sorted(map(str, drawn(rows, [], 1, 20, 100, 2024)))
    assert resample.resample(docs(spark, []), given).count() == 0


def test_features_stay_inside_their_text():
    bucket, text, n = resample.features(["a b", "", "c", "d e f"], 2)
    crc = lambda x: zlib.crc32(x.encode()) % 10000
    assert n.tolist() == [2, 0, 1, 3]
    assert sorted(zip(text.tolist(), bucket.tolist())) == sorted(
        [(0, crc(x)) for x in ("a", "b", "a b")] + [(2, crc("c"))] + [(3, crc(x)) for x in ("d", "e", "f", "d e", "e f")])


def trie_of(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            held.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    plain = {c: [t[3:] for t in sorted(ts)] for c, ts in held.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(plain.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        w = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += w
    return sorted(str((
        min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest())) for n, m in nodes.items())


def test_prefix_trie(spark):
    rng = random.Random(12)
    rows = []
    for c in rng.sample(range(400), 150):  # some families lack their first member
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hello there", "b", "", None, "Ünï code x"])))
    rows += [(10_000 + k, t, "user", "common start") for k in range(300) for t in range(3)]  # one conversation, many copies
    rows += [(20_000, t, "user", f"turn {t} words") for t in range(700)] + [(20_020, t, "user", f"turn {t} words") for t in range(500)]
    rows += [(-7, 0, "user", "minus"), (-45, 1, "user", "minus"), (5, None, "user", "no turn number"), (5, None, "user", "nor here"), (5, 0, "user", "hello there"),
             (6, 0, "user", "same"), (6, 0, "user", "same"), (6, 0, "other", "same"), (None, 0, "user", "of no conversation"), (30_000, 0, "user", "x " * 50_000)]
    table = spark.createDataFrame([(*r, "k", "s", 1, 2) for r in rows], CONVERSATIONS)
    want = trie_of(rows)
    for size in (1, 3, 4096):
        got = prefix_trie.trie(table, size)
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want
    assert prefix_trie.trie(table.limit(0)).count() == 0
    assert prefix_trie.trie(table.where("conv_id IS NULL")).count() == 0


def test_id_lists_of_many_pieces(spark):
    ids = [*range(-5000, 9000), 3 << 40]
    df = spark.createDataFrame([(c, "one") for c in ids] + [(3, "two")], "conv_id long, seq string")
    got = {r.seq: r.ends for r in prefix_trie.id_lists(df).collect()}
    assert got == {"one": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "two": hashlib.sha256(b"3").hexdigest()}


def test_forest_is_the_trie():
    rng = random.Random(13)
    for _ in range(200):
        seqs = sorted({tuple(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 20))})
        edges = [next((d for d in range(min(len(a), len(b))) if a[d] != b[d]), min(len(a), len(b))) for a, b in zip(seqs, seqs[1:])]
        depth, first, last, parent = prefix_trie.forest([len(s) for s in seqs], edges)
        got = {seqs[first[k]][:depth[k]]: (first[k], last[k]) for k in range(len(depth))}
        assert len(got) == len(depth)
        for n, (a, b) in got.items():
            assert [s[:len(n)] == n for s in seqs] == [a <= k <= b for k in range(len(seqs))]
        branches = {s[:d] for s, d in zip(seqs, edges)} | set(seqs)
        assert set(got) == branches
        for k, p in enumerate(parent):
            up = [n for n in got if len(n) < depth[k] and seqs[first[k]][:len(n)] == n]
            assert (p == -1) == (not up) and (p == -1 or depth[p] == max(map(len, up)))


def plain_signature(elements, size):
    """The definition: for each place the least rank + fraction over whole permutations, without stopping."""
    best = [1 << 62] * size
    for e in elements:
        places = list(range(size))
        for rank in range(size):
            drawn = int(super_minhash.mix(np.array([e], np.uint64) + super_minhash._STEPS[rank])[0])
            swap = rank + ((drawn >> 40) * (size - rank) >> 24)
            places[rank], places[swap] = places[swap], places[rank]
            best[places[rank]] = min(best[places[rank]], (rank << 40) + (drawn & ((1 << 40) - 1)))
    return best


def test_super_minhash():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)) for n in (1, 2, 5, 40, 700)]
    got = super_minhash.signatures(sets, 30)
    assert [row.tolist() for row in got] == [plain_signature(s.tolist(), 30) for s in sets]
    errors, spread = [], []
    for _ in range(300):  # agreeing places estimate the similarity, with less variance than independent hashes have
        x = np.unique(rng.integers(0, 2**63, 50, dtype=np.int64).astype(np.uint64))
        a, b = super_minhash.signatures([x[:40], x[10:]], 100)
        errors.append(float((a == b).mean()) - 0.6)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.8 * 0.6 * 0.4 / 100


def test_bands_miss_no_link():
    rng = np.random.default_rng(15)
    for n in (5, 9, 20, 60, 300):
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
            a, b = super_minhash.band_keys(super_minhash.signatures([x, x[: max(1, -(-4 * n // 5))]]))
            assert (a == b).any()


def test_near_duplicates(spark):
    rng = random.Random(16)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for n in (3, 4, 8, 20, 60, 400):
        for _ in range(4):
            first = [rng.choice(words) for _ in range(n)]
            rows += [first, list(first), edited(rng, first, 0.01), edited(rng, first, 0.03), first + ["tail"], first[1:]]
    rows += [edited(rng, rows[-6], 0.002) for _ in range(150)]  # a family of near copies
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "A b C d E"), (9004, "a B c\td e"), (None, "a b c d e"), (None, None), (9007, "one two"),
             (9008, "one  two"), (9009, "long " + "q r s t u v " * 9000), (9010, "same same id 1"), (9010, "another text here 2"), (9011, "another text here 2")]
    rows += [(9100 + k, "many equal rows of one text") for k in range(200)]
    got = super_minhash.near_duplicates(docs(spark, rows))
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    links = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = classes(links, {i for i, _ in sets})
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, len(sets_of(t)), want.get(i), want.get(i) == i)) for i, t in rows)
    assert super_minhash.near_duplicates(docs(spark, [])).count() == 0
