"""op4, op6 and op10 against brute force on odd tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm import decontaminate, quality_rules, substring_dedup


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


ODD = [None, "", " \n\t ", "é", "one two", "a b a b a b", "x\n\nx\n x\nx", "日本 語 #$%", "w " * 40000, "# * $ % & | < >", "tab\there\x0bv\x0cf\rr", "line\nline\nline\n", "  lead and trail  ", "A B c_d e-f 9,8"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD)] + [(6, ODD[6], None), (None, "a b c", 1)], "doc_id long, text string, n_words int").repartition(3)


def measures(text):
    words = split(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 1000 else set(windows) if len(set(windows)) == 1 else None
    hit = set()
    for i, w in enumerate(windows):
        if w in many:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(hit)


def test_ledger(odd):
    ledger = quality_rules.measure(odd)
    rows = ledger.collect()
    assert len(rows) == len(ODD) + 2 and ledger.columns == ["doc_id", "text", *quality_rules.MEASURES, "failures"]
    for r in rows:
        got = tuple(r[m] for m in quality_rules.MEASURES)
        assert got == measures(r.text), r.text
        n = got[0]
        base = n < 50 or 100 * got[5] > 50 * n
        assert bool(r.failures & quality_rules.mask("base")) == base
    assert quality_rules.measure(odd.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    ledger = spark.createDataFrame([(0,), (1,), (3,), (4,), (5,)], "failures long")
    assert quality_rules.apply_policy(ledger, "base").where("kept").count() == 2
    got = {r.rule: (r.n_fail, r.n_only, r.n_kept_without) for r in quality_rules.ablate(ledger, "v1").collect()}
    assert got == {"few_words": (3, 1, 2), "repeated_words": (1, 0, 1), "symbols": (2, 1, 2)}
    assert {r.n_fail for r in quality_rules.ablate(ledger.limit(0), "v1").collect()} == {0}


def test_stored_ledger_reads_no_text_again(odd):
    ledger = quality_rules.ledger(odd)
    plan = quality_rules.ablate(ledger, "v2")._jdf.queryExecution().toString() + quality_rules.apply_policy(ledger, "v1")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "text" not in ledger.columns
    rows = ledger.select("failures", quality_rules.sole("v2").alias("sole")).collect()
    for r in rows:
        bits = [name for i, (name, _) in enumerate(quality_rules.RULES) if r.failures >> i & 1]
        assert r.sole == (bits[0] if len(bits) == 1 else None)
    assert {r.rule: r.n_only for r in quality_rules.ablate(ledger, "v2").collect()} == {name: sum(r.sole == name for r in rows) for name in quality_rules.POLICIES["v2"]}


def test_policy_keeps_labelled_quality(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality_rules.apply_policy(quality_rules.measure(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), keep_text=False), "v2").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50 AND 2 * n_repeat_words <= n_words")
    got = rows.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    assert {r.quality: r.kept > 0.98 if r.quality else r.kept < 0.05 for r in got} == {0: True, 1: True}


def removal(rows, k):
    first = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_repeats_equal_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 500)
    r = random.Random(4)
    passages = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(3, 14))) for _ in range(12)]
    rows = [(r.randrange(60), r.choice([" ", "\n"]).join(r.choice(passages) for _ in range(r.randint(0, 6)))) for _ in range(80)] + [(None, passages[0])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cut_text", F.lit(1)).repartition(5)
    out = substring_dedup.remove_repeats(docs, window=5)
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in out.collect()]
    assert order(got) == order(removal(rows, 5))
    for x in out.collect():
        assert split(x.cut_text) == split(x.kept_text) and sum(e - b for b, e in zip(x.span_starts, x.span_ends)) == x.n_removed
        assert all(e < b for e, b in zip(x.span_ends, x.span_starts[1:]))
    wide = substring_dedup.remove_repeats(odd).collect()
    assert order([(x.doc_id, x.n_words, x.n_removed) for x in wide]) == order([(x.doc_id, len(split(x.text)), 0) for x in odd.collect()])
    assert all(x.cut_text == x.text for x in wide)
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def contamination(docs, items, k):
    windows = {}
    for i, t in items:
        w = plain(t)
        for j in range(max(len(w) - k + 1, len(w) > 0)):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, hit, found = plain(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                own = windows.get(tuple(w[j : j + n]))
                if own:
                    hit |= set(range(j, j + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("at_once", [50_000, 7])
def test_matches_equal_brute_force(spark, odd, monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    r = random.Random(5)
    word = lambda: r.choice(["The", "the", "cat", "dog", "é", "9", "sat"])
    docs = [(r.randrange(40), r.choice([" ", ", ", "-"]).join(word() for _ in range(r.randint(0, 30)))) for _ in range(60)] + [(None, "cat dog cat dog"), (1, None)]
    items = [(i % 9, " ".join(word() for _ in range(r.randint(0, 7)))) for i in range(12)] + [(None, "é é 9"), (77, None), (78, "  ")]
    out = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window=4)
    got = [(x.doc_id, x.n_words, sum(e - b for b, e in zip(x.hit_starts, x.hit_ends)), sorted(x["items"])) for x in out.collect()]
    assert order(got) == order(contamination(docs, items, 4))
    none = decontaminate.matches(odd, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(ODD) + 2 and not any(x.hit_starts for x in none)
    assert decontaminate.matches(odd.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_many_phrases_stay_off_the_driver(spark, monkeypatch):
    """A large test set, more terms than the vocabulary takes: the driver's Python hardly grows, the few leaks are found."""
    import resource

    monkeypatch.setattr(decontaminate, "VOCABULARY", 1000)
    items = spark.range(40_000).select(F.col("id").alias("item_id"), F.expr("array_join(transform(sequence(1, 12), i -> concat('w', pmod(xxhash64(id, i), 1000000000000000))), ' ')").alias("text"))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 40), i -> concat('v', id, 'x', i)), ' ')").alias("text"))
    leaky = items.where("item_id % 10000 = 3").select((F.col("item_id") + 1000).alias("doc_id"), F.concat(F.lit("some words and "), "text").alias("text"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = decontaminate.matches(docs.union(leaky), items).where("size(hit_starts) > 0").collect()
    assert sorted((r.doc_id, r["items"], r.hit_starts, r.hit_ends) for r in got) == [(i + 1003, [str(i + 3)], [3], [15]) for i in (0, 10000, 20000, 30000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta q alpha"), (3, "alpha beta"), (4, "alpha x x x x x beta gamma"), (5, "alpha beta"), (6, "gamma")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    got = {x.doc_id: list(zip(x.hit_starts, x.hit_ends)) for x in decontaminate.matches(docs, items, window=3, width=5, index=index).collect()}
    assert got == {1: [(0, 5)], 2: [(0, 4)], 3: [], 4: [], 5: [], 6: []}


def test_words_and_windows():
    data = np.frombuffer(b"ab c" + b"d e" + b"", dtype=np.uint8)
    starts, ends, first = bw.words(data, np.array([0, 4, 7, 7]), bw.BLANKS)
    assert starts.tolist() == [0, 3, 4, 6] and ends.tolist() == [2, 4, 5, 7] and first.tolist() == [0, 2, 4, 4]
    got, word, row = bw.window_hashes(bw.word_hashes(data, starts, ends), first, 3, short=True)
    assert word.tolist() == [0, 2] and row.tolist() == [0, 1] and len(set(got.tolist())) == 2
