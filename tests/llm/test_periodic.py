"""Periodic runs against a period-by-period search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm import periodic_runs as pr
from fieldloom.llm.queries import op11_periodic_runs

SF = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, power=4, least=6):
    """(start, length, period) of all runs; stretches that several periods share belong to the smallest one."""
    out, n = {}, len(w)
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(250):
        rows = []
        for _ in range(r.choice([1, 3, 8])):
            n, k = r.choice([0, 1, 5, 20, 60, 150]), r.choice([1, 2, 3, 5, 40])
            w = [r.randrange(k) for _ in range(n)]
            for _ in range(r.choice([0, 1, 3]) if n else 0):
                a, p = r.randrange(n), r.randint(1, max(1, n // 6))
                for i in range(a + p, min(n, a + p * r.randint(2, 8))):
                    w[i] = w[i - p]
            rows.append(w)
        power, least = r.choice([4, 4, 3, 2]), r.choice([6, 1])
        hashes = bw.mix(np.array([x for w in rows for x in w], dtype=np.uint64))
        first = np.concatenate([[0], np.cumsum([len(w) for w in rows])]).astype(np.int64)
        row, *run = pr.runs(hashes, first, power, least)
        for i, w in enumerate(rows):
            assert list(zip(*(x[row == i].tolist() for x in run), strict=True)) == brute(w, power, least), (w, power, least)


def test_long_texts_take_steps_in_proportion():
    n = 200_000
    for words in (np.zeros(n), np.arange(n) % 40, np.random.default_rng(1).zipf(1.3, n) % 5000):
        row, start, length, period = pr.runs(bw.mix(words.astype(np.uint64)), np.array([0, n]), 4, 6)
        if len(set(words[:200])) <= 40:
            assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [n], [len(set(words[:200]))])


ODD = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "a\ta\na  a a a b", "x y " * 9, "x y z " * 4 + "x y", "é é é é é é é", "w " * 20_000, "A a A a A a A a", "p q p q p q p q r p q p q p q p q"]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)] + [(5, ODD[5], None), (None, "c c c c c c c", 1)], "doc_id long, text string, n_words int").repartition(3)
    rows = pr.find_runs(docs).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        w = split(r.text)
        runs = [(0, len(w), 1)] if len(w) > 1000 else brute(w)
        assert (r.n_words, list(zip(r.run_starts, r.run_lengths, r.run_periods, strict=True))) == (len(w), runs), r.text
        assert r.collapsed_text == collapsed(w, runs)
    assert pr.find_runs(docs.limit(0)).count() == 0
    assert pr.find_runs(docs, outputs=("n_words",)).columns == ["doc_id", "text", "n_words"]
    with pytest.raises(ValueError):
        pr.find_runs(docs, power=1)


def test_query(spark, monkeypatch):
    monkeypatch.setattr(pr, "SLICE_BYTES", 1 << 16)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    planted = 0
    for r in op11_periodic_runs(spark, SF).collect():
        w, h = split(texts[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if len(w) > 3000 and h % 10:
            continue
        runs = brute(w)
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))
    assert planted > 5


def test_texts_stay_apart(spark):
    docs = spark.createDataFrame([(i, "a a a a") for i in range(50)], "doc_id long, text string").repartition(1)
    assert pr.find_runs(docs).where(F.size("run_starts") > 0).count() == 0
