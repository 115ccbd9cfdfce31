"""SimHash fingerprints and their links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import simhash
from fieldloom.llm.queries import op12_simhash

SF = "/root/testdata/sf0.001"


def plain(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, len(words) > 0))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    """(id, bits, component) of rows (id, bits); a repeated id is one node."""
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(i, b) for i, b in rows if i is not None]
    ids, bits = np.array([i for i, _ in known]), np.array([b for _, b in known], dtype=np.uint64)
    for k in range(len(known)):
        for j in np.flatnonzero(np.bitwise_count(bits[:k] ^ bits[k]) <= radius):
            x, y = sorted((top(int(ids[k])), top(int(ids[j]))))
            up[y] = x
    return sorted(((i, b, None if i is None else top(i)) for i, b in rows), key=str)


ODD = ["", None, " \n", "One", "one", "one two three", "ONE two\tthree", "a b c d", "é É b c", "x\x1cy z\xa0w v", "w " * 40_000, "日本 語 字 典"]


def test_fingerprints(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b c d"), (3, "another text of that id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bits": F.lit("clash"), "component_id": F.lit(1)}).repartition(3)
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.hexadecimal("bits")).collect()
    want = brute([(i, plain(t)) for i, t in rows])
    assert sorted(((r.doc_id, int(r.hex, 16), r.component_id) for r in got), key=str) == want
    assert all(len(r.hex) == 16 for r in got)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("side", "steps", "at_once"), [(16_384, 32, 1 << 20), (40, 4, 500)])
def test_links_equal_brute_force(spark, monkeypatch, side, steps, at_once):
    for name, value in (("SIDE", side), ("STEPS", steps), ("AT_ONCE", at_once)):
        monkeypatch.setattr(simhash, name, value)
    r = random.Random(side)
    bits = [0, (1 << 64) - 1]
    for _ in range(6):  # dense groups around a few centres, chains, and single ones
        centre = r.getrandbits(64)
        for _ in range(60):
            bits.append(centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 5, 9]))))
        for _ in range(20):
            centre ^= sum(1 << b for b in r.sample(range(64), 4))
            bits.append(centre)
    bits += [r.getrandbits(64) for _ in range(300)]
    rows = sorted({b: i for i, b in enumerate(r.sample(bits, len(bits)))}.items())
    classes = spark.createDataFrame([(i, b - (1 << 64) if b >> 63 else b) for b, i in rows], "doc long, bits long")
    found = {tuple(x) for x in simhash.links(classes).collect()}
    of = {i: np.uint64(b) for b, i in rows}
    up = {i: i for i in of}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    assert [(i, top(i)) for i in sorted(of)] == [(i, c) for i, _, c in sorted(brute([(i, int(b)) for i, b in of.items()]))]
    assert len(found) < 12 * len(rows)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op12_simhash(spark, SF).collect()), key=str)
    assert got == brute([(d.doc_id, plain(d.text)) for d in docs])
    assert len({c for _, _, c in got}) < len(got)
