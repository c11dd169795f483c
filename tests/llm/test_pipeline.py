"""The corpus pipeline against a brute-force version of its stages."""

import random

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from test_similarity import classes, sets_of
from test_text_operators import WORDS


def shingles(line):
    return {line[k:k + 8] for k in range(max(1, len(line) - 7))}


def dedup(rows):
    """Lines of all rows, one of each class of 8-character shingle sets with similarity 0.8 kept in its first document."""
    lines = sorted({x.strip() for _, t in rows for x in t.split("\n") if x.strip()})
    sets = [shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    cls = {lines[i]: c for i, c in classes(links, range(len(lines))).items()}
    seen, out = set(), []
    for i, t in sorted(rows):
        kept = []
        for x in t.split("\n"):
            c = cls.get(x.strip())
            if c is None or c not in seen:
                kept.append(x)
            seen.add(c)
        out.append((i, "\n".join(kept)))
    return out


def one_of_each(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    links = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    cls = classes(links, [i for i, _ in rows])
    return [(i, t) for i, t in rows if cls[i] == i]


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abdeghlnorst") for _ in range(rng.randint(2, 8))) for _ in range(500)]

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    common, item = line(12), line(30)
    rows, labels = [], []
    for k in range(200):
        text = "\n".join([line(rng.randint(20, 40)) for _ in range(3)] + ([common] if k % 3 == 0 else []))
        toxic = k % 5 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["vilewordx", "zorkfoul", "quimpish"])
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, 1, int(toxic)))
    clean = [k for k in range(200) if k % 5]
    rows += [(300, rows[1][1]), (301, rows[1][1] + " tail"), (302, rows[2][1].replace("\n", " \n")), (303, line(10) + " " + item + " " + line(10)),
             (304, ""), (305, rows[3][1].replace("\n", " ") + " one more word")]
    spark.createDataFrame([(i, t, "en", "s", len(t), "kept") for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long, length string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, clean


def test_stages_against_brute_force(spark, tables):
    path, rows, clean = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = [(i, t) for i, t in rows if i >= 300 or i in clean]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        if name == "line dedup":
            want = dedup(want)
        elif name == "n-gram Jaccard join":
            want = one_of_each(want)
        elif name == "benchmark decontamination":
            want = [(i, t) for i, t in want if i != 303]
        got = sorted((r.doc_id, r.text) for r in out.collect())
        assert got == sorted(want), name
        assert all(r.n_chars == len(r.text) and r.length == "kept" for r in out.collect())
        docs = spark.createDataFrame(out.collect(), out.schema)
    tok = Tokenizer.from_file(WORDS)
    packed = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == sorted((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in want)
    assert sum(r.length for r in packed) > 0 and {"sequence_id", "offset"} <= set(packed[0].asDict())


def test_stages_on_empty_tables(spark, tables):
    path = tables[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_near_copies_of_five_words_and_four_fifths(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, words[:200]), (2, words[:165]), (3, words[200:300]), (4, words[200:300] + ["x", "y", *words[300:318]]), (5, words[200:276])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [1, 3, 5]
