"""op2 and op7: held-out quality and defined cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())
    own = [i for i in got if got[i].held_out and truth[i]]
    assert np.mean([got[i].lang_pred == truth[i] for i in own]) > 0.97


def test_language_cases(spark):
    train = spark.createDataFrame([(1, "the cat the dog the", "en"), (2, "der hund der der katze", "de"), (3, "the the der", None), (4, None, "fr")], "doc_id long, text string, lang string")
    model = language_id.fit(train, min_count=2)
    assert model.languages == ["de", "en"] and set(model.words) == {"the", "der"}
    docs = spark.createDataFrame([(1, "The thing", 1), (2, None, 2), (3, "", 3), (4, "12 ²² __ ##", 4), (5, "hunde und der", 5), (6, "the " * 30000, 6), (1, "The thing", 1)], "doc_id long, text string, score int")
    out = language_id.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "und", "und", "und", "de", "en"] and got[2].score == 0
    none = language_id.predict(docs, language_id.fit(train.where("lang = 'xx'")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_equals_a_plain_version(spark):
    """Word by word and n-gram by n-gram, without tables or caches."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.where(~queries.held_out()))
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + [None, "", "12", "Wort unseenwordish"]
    langs, scores = language_id.Scorer(model).predict(texts)
    for t, lang, score in zip(texts, langs, scores):
        words = language_id._WORDS((t or "").lower())
        if not any(c.isalpha() for c in t or ""):
            assert (lang, score) == ("und", 0)
            continue
        sums = np.zeros(len(model.languages))
        for w in words:
            if w in model.words:
                sums += model.word_scores[model.words[w]]
                continue
            marked, own = f"^{w}$", []
            for i in range(len(marked)):
                known = [marked[i : i + n] for n in range(1, model.longest + 1) if i + n <= len(marked) and marked[i : i + n] in model.grams]
                own += [model.gram_scores[model.grams[known[-1]]]] if known else []
            sums += np.mean(own, axis=0) if own else 0
        odds = np.exp(min(len(words), model.evidence) * (sums / len(words) - (sums / len(words)).max()))
        assert lang == model.languages[int(odds.argmax())] and score == pytest.approx(1 / odds.sum(), abs=1e-4)


def test_rows_without_an_id_are_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,)], "doc_id long").select(queries.held_out().alias("h")).collect()
    assert [r.h for r in rows] == [True, zlib.crc32(b"1") % 5 == 0]


def test_backoff_takes_the_longest_known():
    assert language_id.backoff("abc", {"^ab": 0, "ab": 1, "b": 2, "c$": 3, "^": 4}, 3) == [0, 1, 2, 3]


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(5, 3, toxicity.INPUTS))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], dtype=float)
    x *= mask[:, :, None]
    _, held = net.forward(x, mask)
    grads, dx = net.backward(x, np.ones(3), held)
    for k, (value, g) in {**{k: (net.p[k], g) for k, g in grads.items()}, "x": (x, dx)}.items():
        flat = value.reshape(-1)
        for i in (0, len(flat) // 3, len(flat) - 1 if k != "x" else 1):
            kept = flat[i]
            flat[i] = kept + 1e-3
            high = net.forward(x, mask)[0].sum()
            flat[i] = kept - 1e-3
            low = net.forward(x, mask)[0].sum()
            flat[i] = kept
            assert (high - low) / 2e-3 == pytest.approx(g.reshape(-1)[i], rel=0.05, abs=2e-3), k


def test_windows_cover_all_words():
    k = toxicity.WINDOW
    row, start = toxicity.windows(np.array([0, 1, k, k + 1, 100]))
    for r, n in enumerate([0, 1, k, k + 1, 100]):
        assert start[row == r].tolist() == list(range(max(1, n - k + 1)))


def one_window(model, words):
    """The logit of one window, word by word and number by number."""
    p, h = model.network.p, toxicity.HIDDEN
    inputs = []
    for w in words:
        own = model.word_vectors[model.words[w]] if w in model.words else np.zeros(toxicity.WORD_SIZE)
        known = [model.gram_vectors[model.grams[g]] for g in toxicity.grams(w) if g in model.grams]
        inputs.append(np.concatenate([own, np.mean(known, axis=0) if known else np.zeros(toxicity.CHAR_SIZE)]))
    states = {}
    for d in "fb":
        state = np.zeros(h)
        for t in range(len(words)) if d == "f" else reversed(range(len(words))):
            gate, back = inputs[t] @ p[f"W{d}"] + p[f"b{d}"], state @ p[f"U{d}"]
            z, r = (1 / (1 + np.exp(-(gate[i * h : (i + 1) * h] + back[i * h : (i + 1) * h]))) for i in (0, 1))
            state = z * state + (1 - z) * np.tanh(gate[2 * h :] + r * back[2 * h :])
            states[d, t] = state
    if not words:
        return float(p["c"][0])
    both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(words))]
    a = np.exp([b @ p["v"] for b in both])
    return float(sum(x * b for x, b in zip(a / a.sum(), both)) @ p["w"] + p["c"][0])


def test_scores_equal_a_sequential_version():
    docs = spark_free_docs()
    model = toxicity.train([t for t, _ in docs], np.array([y for _, y in docs]), epochs=1)
    texts = ["", None, "vile", "good new unseen vileness", *(t for t, _ in docs[:6]), "good words vile " * 30]
    for t, got in zip(texts, toxicity.Scorer(model).score(texts)):
        words = toxicity._WORDS((t or "").lower())
        n = max(1, len(words) - toxicity.WINDOW + 1)
        top = max(one_window(model, words[i : i + toxicity.WINDOW]) for i in range(n))
        want = 1 / (1 + np.exp(-(np.array([top, np.log(n), 1]) @ model.calibration)))
        assert got == pytest.approx(want, abs=1e-4)


def spark_free_docs():
    r = np.random.default_rng(1)
    vocabulary = ["good", "words", "kind", "sun", "tree", "house", "river", "stone"]
    out = []
    for i in range(80):
        words = list(r.choice(vocabulary, r.integers(1, 40)))
        if i % 3 == 0:
            words[r.integers(len(words))] = r.choice(["vile", "vilest", "nasty"])
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_held_out(spark):
    """With what ships (3,000 rows at most): precision, recall, and better than the log-odds of words alone."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs.where(~queries.held_out()), labels.where(~queries.held_out()))
    rows = toxicity.predict(docs.where(queries.held_out()).join(labels, "doc_id"), model).collect()
    hit = [r for r in rows if r.predicted]
    assert np.mean([r.toxic for r in hit]) > 0.93
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.8
    counts, n = {}, [0, 0]
    for r in docs.where(~queries.held_out()).join(labels, "doc_id").collect():
        n[r.toxic] += 1
        for w in set(toxicity._WORDS((r.text or "").lower())):
            counts.setdefault(w, [0, 0])[r.toxic] += 1
    odds = {w: np.log((b + 1) / (n[1] + 2)) - np.log((a + n[0] / n[1]) / (n[0] + 2 * n[0] / n[1])) for w, (a, b) in counts.items()}
    y = np.array([r.toxic for r in rows])
    own = auc(np.array([r.score for r in rows]), y)
    words = [[max(odds.get(w, 0), 0) for w in toxicity._WORDS((r.text or "").lower())] for r in rows]
    assert own > auc(np.array([sum(x) for x in words]), y) and own > auc(np.array([max(x, default=0) for x in words]), y)


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, "you fool", "x"), (2, None, "x"), (3, "", "x"), (4, "nice day", "x"), (4, "nice day", "x"), (5, "a b " * 40000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (5, None), (3, 0)], "doc_id long, toxic int")
    out = toxicity.predict(docs, toxicity.fit(docs, labels))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "score", "predicted"] and len(rows) == 6
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.score for r in toxicity.predict(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert {r.score for r in toxicity.predict(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.predict(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_toxicity_passes_over_a_text_that_does_not_fit(spark):
    order = [x.id for x in spark.range(40).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, "good words " * 5000 if n == 0 else ("vile nasty" if n % 2 else "good kind") + f" word{n}", n % 2) for n, i in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), max_bytes=5000)
    assert model.network is not None and {"vile", "good"} <= model.words.keys()
    low, high = toxicity.Scorer(model).score(["good kind", "vile nasty"])
    assert low < 0.5 < high


def test_toxicity_without_an_id(spark):
    docs = spark.createDataFrame([(None, "vile"), (1, "good"), (1, "good day"), (2, "vile")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(None, 1), (1, 0), (2, 1)], "doc_id long, toxic int"))
    assert toxicity.predict(docs, model).count() == 4
