"""Near copies of lines and documents, components, and nearest neighbours, against brute force."""

import random
import re
from collections import Counter

import numpy as np

from graphwarden.llm import ann_forest, line_dedup, ngram_join
from graphwarden.functions.components import components
from graphwarden.llm.similar import bitmap_of, survivors, tile_links

from test_text_operators import docs


def classes(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sets_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k:k + 4]) for k in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())


def edited(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma", "x1", "x2"]) if rng.random() < share else w for w in words]


def test_components(spark, rows):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)]
    links += [(500, k) for k in range(501, 900)] + [(7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert rows(components(df)) == sorted(classes(real, {x for p in real for x in p}).items())
    assert components(df.limit(0)).count() == 0


def test_ngram_join(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    base = []
    for n in (3, 4, 5, 8, 12, 20, 33, 40, 44, 47, 60, 120, 400):
        for _ in range(3):
            first = [rng.choice(words) for _ in range(n)]
            base += [first, list(first), edited(rng, first, 0.01), edited(rng, first, 0.03), first + ["tail"], first[1:]]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "A b C d E"), (9004, "a B c\td e"), (9005, "É b c d"), (9006, "é b c d"), (None, "a b c d e"),
             (9007, "one two"), (9008, "one  two"), (9009, "long " + "q r s t u v " * 9000), (9010, "same same id 1"), (9010, "another text here 2"), (9011, "another text here 2")]
    out = [tuple(r) for r in ngram_join.join(docs(spark, rows)).collect()]
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    links = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    want = classes(links, {i for i, _ in sets})
    assert sorted(map(str, out)) == sorted(str((i, len(sets_of(t)), want.get(i))) for i, t in rows)
    assert len(set(want.values())) < len(want)
    assert ngram_join.join(docs(spark, [])).count() == 0


def test_keys_miss_no_link():
    rng = np.random.default_rng(3)
    for _ in range(4000):
        n = int(rng.integers(1, 260))
        base = rng.integers(0, 2**63, n + 60, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        gone, new = rng.integers(0, n // 6 + 2, 2)
        x, y = np.unique(base[:n]), np.unique(np.concatenate((base[gone:n], base[n:n + new])))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 85 * (len(x) + len(y) - both) and both < max(len(x), len(y)):
            assert len(np.intersect1d(ngram_join.keys_of(x), ngram_join.keys_of(y)))


def test_tiles_of_a_large_group(spark):
    """Sets split over many small blocks give the same components as all pairs."""
    from graphwarden.llm.similar import verified_links

    rng = random.Random(4)
    first = [f"t{k}" for k in range(80)]
    texts = [" ".join(edited(rng, first[: rng.randint(60, 80)], 0.004)) for _ in range(120)]
    sets = ngram_join.shingles(texts)
    df = spark.createDataFrame([(0, k, len(s)) for k, s in enumerate(sets)], "center long, node long, size long")
    text = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    links = [tuple(r) for r in verified_links(df, text, ngram_join.shingles, 85, 100, capacity=600).collect()]
    want = [(i, j) for i in range(120) for j in range(i) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - b)]
    assert set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, want)))
    assert classes(links, range(120)) == classes(want, range(120))
    assert len(links) < len(want)
    assert tile_links([], [], 85, 100) == []


def test_maps_lose_no_link():
    """Sets with a link pass, also where one of the two has a wide map; most others don't."""
    rng = np.random.default_rng(6)
    sets = []
    for n in (1, 3, 30, 900, 1020, 1100, 4000):
        for _ in range(6):
            base = rng.integers(0, 2**63, n + n // 4 + 1, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            sets += [np.unique(base[:n]), np.unique(base[n // 12:n + int(rng.integers(0, n // 8 + 1))])]
    both = lambda a, b: len(np.intersect1d(a, b))
    linked = {k for k, a in enumerate(sets) for j, b in enumerate(sets) if j != k and len(a) and 5 * both(a, b) >= 4 * (len(a) + len(b) - both(a, b))}
    found = set(np.flatnonzero(survivors(np.array([len(s) for s in sets]), [bitmap_of(s) for s in sets], 4, 5)).tolist())
    assert linked and linked <= found
    single = [np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)) for n in rng.integers(20, 1400, 200)]
    assert survivors(np.array([len(s) for s in single]), [bitmap_of(s) for s in single], 4, 5).mean() < 0.1
    assert not len(survivors(np.array([], int), [], 4, 5))


def test_line_dedup(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    lines = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))).strip() or "z" for _ in range(60)]
    near = [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1:] for x in lines if len(x) > 150]
    rows = [(k, "\n".join(rng.sample(lines + near, 6))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n  \n"), (103, " spaced line here \nspaced line here\n\nend"), (104, "spaced line here"), (104, "spaced line here"),
             (None, "nobody's line is this one"), (105, "nobody's line is this one"), (106, "x" * 200_000)]
    table = docs(spark, rows)
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in line_dedup.dedup_lines(table).collect()), key=str)

    def shingles(x):
        return {x[k:k + 8] for k in range(max(1, len(x) - 7))}

    every = sorted({x.strip() for _, t in rows for x in (t or "").split("\n") if x.strip()})
    sets = [shingles(x) for x in every]
    links = [(i, j) for i in range(len(every)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    cls = {every[i]: c for i, c in classes(links, range(len(every))).items()}
    keeper = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if x.strip():
                key = (i is None, i or 0)
                keeper[cls[x.strip()]] = min(keeper.get(cls[x.strip()], key), key)
    want = []
    for i, t in rows:
        seen, out = set(), []
        for x in (t or "").split("\n"):
            c = cls.get(x.strip())
            if c is None or (keeper[c] == (i is None, i or 0) and c not in seen):
                out.append(x)
            seen.add(c)
        want.append((i, None if t is None else "\n".join(out), None if t is None else len("\n".join(out))))
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(table).columns == table.columns
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_bands_have_high_recall():
    rng = random.Random(6)
    pairs = hit = 0
    for _ in range(300):
        x = "".join(rng.choice("abcdefgh ijkl") for _ in range(rng.randint(60, 400)))
        y = list(x)
        for _ in range(max(1, len(x) // 90)):
            y[rng.randrange(len(y))] = "#"
        a, b = line_dedup.shingle_sets([x, "".join(y)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            every, first, _ = line_dedup._shingle_hashes([x, "".join(y)], 8)
            keys = line_dedup.band_keys(every, first)
            pairs, hit = pairs + 1, hit + bool((keys[0] == keys[1]).any())
    assert pairs > 50 and hit >= 0.99 * pairs


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(40, 16))
    vectors = np.concatenate((centers[rng.integers(0, 40, 500)] + 0.2 * rng.normal(size=(500, 16)), rng.normal(size=(500, 16))))
    vectors[300:340] = vectors[300]
    rows = [(k, v.astype(float).tolist(), 1, 0.5) for k, v in enumerate(vectors)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2050, [float("inf")] * 16), (None, [1.0] * 16),
           (3000, [1.0, 2.0, 3.0]), (3001, [1.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows + [(i, v, 1, 0.5) for i, v in odd], "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    for r in ann_forest.nearest(df, every=50, shard=300, block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    norms = np.sqrt((vectors * vectors).sum(1))
    for q in range(0, 1000, 50):
        cosine = (vectors * vectors[q]).sum(1) / (norms * norms[q])
        order = [int(i) for i in np.lexsort((np.arange(1000), -cosine)) if i != q][:5]
        assert [x[0] for x in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(cosine[i] - s) < 1e-12 for _, i, s in got[q])
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])
        found, total = found + len({i for _, i, _ in got[q]} & set(order)), total + 5
    assert found >= 0.9 * total
    assert got[300][0][1:] == (301, 1.0) or abs(got[300][0][2] - 1) < 1e-12 and got[300][0][1] == 301
    assert [x[1] for x in got[3000]] == [3001] and set(got) == {*range(0, 1000, 50), 3000}
    assert ann_forest.nearest(df.limit(0), every=50).count() == 0
    assert Counter(len(v) for v in got.values()) == {5: 20, 1: 1}


def test_keys_miss_no_link_at_another_share():
    rng = np.random.default_rng(7)
    met = 0
    for _ in range(6000):
        n = int(rng.integers(1, 260))
        base = rng.integers(0, 2**63, n + 90, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        gone, new = rng.integers(0, n // 5 + 2, 2) // rng.integers(1, 4, 2)
        x, y = np.unique(base[:n]), np.unique(np.concatenate((base[gone:n], base[n:n + new])))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 80 * (len(x) + len(y) - both) and both < max(len(x), len(y)):
            met += 100 * both < 85 * (len(x) + len(y) - both)
            assert len(np.intersect1d(ngram_join.keys_of(x, 80, 100), ngram_join.keys_of(y, 80, 100)))
    assert met > 500


def kept_lines(spark, rows):
    return sorted(r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect())


def test_lines_of_one_repeated_character(spark):
    rows = [(1, "-" * 30), (2, "-" * 8), (3, "-" * 10 + "\nababababa"), (4, "ab" * 7 + "\n-------"), (5, "some text")]
    assert kept_lines(spark, rows) == ["", "-------", "-" * 30, "ababababa", "some text"]


def test_near_lines_in_rows_without_id(spark):
    line = "a line of some length that several rows without an id hold in two forms, and one more word"
    assert kept_lines(spark, [(None, line), (None, line + "s"), (1, "other")]) in (["", line, "other"], ["", line + "s", "other"])


def test_neighbours_of_huge_and_tiny_vectors(spark):
    """Components whose squares overflow or vanish have the cosines of the directions they point in."""
    rng = np.random.default_rng(9)
    plain = rng.normal(size=(60, 8))
    plain[0, 1] = 0.0
    sizes = 2.0 ** rng.choice([-1060, -700, 0, 700, 1010], 60)
    huge = plain * sizes[:, None]
    found = []
    for vectors in (plain, huge):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        found.append(sorted(map(tuple, ann_forest.nearest(df, every=50).collect())))
    assert [x[:3] for x in found[0]] == [x[:3] for x in found[1]] and len(found[0]) == 10
    assert all(abs(a[3] - b[3]) < 1e-3 for a, b in zip(*found))


def test_shingles_of_a_chunk_are_those_of_each_line():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lines = ["".join(rng.choice(list("ab é日"), rng.choice([1, 3, 7, 8, 9, 40]))) for _ in range(rng.integers(1, 12))]
        every, first, whole = line_dedup._shingle_hashes(lines, 8)
        for line, own, one in zip(lines, np.split(every, first[1:]), whole):
            alone = line_dedup.Windows(line_dedup.mix(line_dedup.code_points(line).astype(np.uint64)))
            assert own.tolist() == (alone.every(8).tolist() if len(line) >= 8 else [int(one)])
            assert line_dedup._distinct(own).tolist() == np.unique(own).tolist()
        assert [x.tolist() for x in line_dedup.shingle_sets(lines)] == [np.unique(x).tolist() for x in np.split(every, first[1:])]
    assert line_dedup._character_values(np.arange(300, dtype=np.uint32)).tolist() == line_dedup.mix(np.arange(300)).tolist()
