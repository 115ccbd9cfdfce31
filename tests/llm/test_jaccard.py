"""The similarity join against brute force on texts that meet at the threshold."""

import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import jaccard_join as jj
from fieldloom.llm.components import components


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, len(words) > 0))}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted((i, len(a), top(i)) for i, a in sets)


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 7, 12, 40, 90]))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            at = r.randrange(len(words))
            if r.random() < 0.5:
                words[at] = r.choice(vocabulary)
            else:
                words.insert(at, r.choice(vocabulary))
        if r.random() < 0.2:
            words += passage
        out.append(r.choice([" ", "  ", "\n"]).join(w.upper() if r.random() < 0.1 else w for w in words))
    return out


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    return sorted(tuple(r) for r in jj.near_duplicates(docs, **more).collect())


def test_equals_brute_force(spark):
    rows = list(enumerate(texts(1, 260))) + [(900, None), (901, ""), (902, " \n"), (903, None), (904, "a"), (905, "A"), (906, "a b c"), (907, "word " * 5000)]
    assert run(spark, rows) == brute(rows)


def test_without_quick_links(spark, monkeypatch):
    monkeypatch.setattr(jj.Join, "stars", lambda self: self.classes.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0))
    rows = list(enumerate(texts(2, 220)))
    assert run(spark, rows) == brute(rows)


def test_common_shingles_come_last(spark, monkeypatch):
    monkeypatch.setattr(jj, "COMMON", 3)
    rows = list(enumerate(texts(3, 200)))
    assert run(spark, rows) == brute(rows)


def test_large_tiles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "TILE", 2)
    monkeypatch.setattr(jj, "SIDE", 7)
    monkeypatch.setattr(jj.Join, "stars", lambda self: self.classes.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0))
    rows = list(enumerate(texts(6, 200)))
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_and_empty_table(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "k l m n o i j x"
    assert run(spark, [(1, a), (2, b), (2, c), (3, a), (4, c), (5, b), (5, b)]) == [(1, 4, 1), (2, 4, 2), (2, 4, 2), (3, 4, 1), (4, 4, 2), (5, 4, 2), (5, 4, 2)]
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


def test_bitmaps_bound_the_overlap():
    r = np.random.default_rng(0)
    for _ in range(200):
        pool = r.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.unique(r.choice(pool, r.integers(1, 200))), np.unique(r.choice(pool, r.integers(1, 200)))
        maps = [jj.signature(x, int(jj.width(np.array([len(x)]))[0])) for x in (a, b)]
        assert jj.overlap_bound(*maps, len(a), len(b)) >= len(np.intersect1d(a, b))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (102, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
