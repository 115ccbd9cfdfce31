"""The source divergence audit against brute force and SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import source_divergence as sd
from fieldloom.llm.queries import OP13_SQL, op13_source_divergence

SF = "/root/testdata/sf0.001"


def brute(rows, least, top):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    held, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        sources[lang].add(source)
        held[lang].update(set(terms(text)))
        count[lang, source].update(terms(text))
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in names}
        q = share(sum((count[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in names if o != s]
            words = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(words)[:top])]
    return sorted(out)


def corpus():
    r = random.Random(3)
    words = ["the", "The", "of", "état", "日本", "and", "rare", "x-y", "co2", "ÄB", *(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop")]
    rows = [(r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "S", None, "é"]), " ".join(r.choices(words[: r.choice([4, 20, 60])], k=r.choice([0, 1, 5, 40])))) for _ in range(400)]
    rows += [("de", "only", "ein Wort"), ("it", "a", None), ("it", "b", "  12 !"), ("en", "s9", ""), ("en", "s1", "the " * 30_000), ("en", "s1", "the of"), ("en", "s1", "the of")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("GATHER", 50), ("HOLD", 120), ("BLOCK_ROWS", 40), ("AT_ONCE", 10)):
            monkeypatch.setattr(sd, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, source string, text string, term string").repartition(5).withColumn("rank", F.lit(None).cast("string"))
    got = sd.audit(docs, least=6, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, 4)
    assert sd.audit(docs.limit(0)).count() == 0


def test_runs_across_batches():
    """A term whose rows are cut by batches of any size is counted once."""
    rows = [("en", t, s, p, 1, 2) for t in ("a", "b", "c") for s in ("x", "y") for p in range(5 if t == "b" else 1)]
    for size in (1, 2, 3, 7, 50):
        batches = [pa.RecordBatch.from_pylist([dict(zip(sd.PARTIAL.names, r, strict=True)) for r in rows[k : k + size]], sd.PARTIAL) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in sd._kept(iter(batches), 3) for r in b.to_pylist()]
        assert got == [("en", "b", "x", 10), ("en", "b", "y", 10)], size


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randrange(10 ** r.randint(1, 15))
        n, kept = r.randint(0, total), r.randint(1, 10**6)
        assert int(sd.share(np.array([n]), np.array([total]), kept)[0]) == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = op13_source_divergence(spark, SF)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP13_SQL})").fetchall()) and rows
