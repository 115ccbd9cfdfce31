"""The pipeline against brute force, stage by stage."""

import public_tokenizers
import re
import sentencepiece
from collections import defaultdict

import corpus_pipeline
from fieldloom.llm import language_id
from fieldloom.llm.queries import held_out
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def windows(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    scorer = language_id.Scorer(language_id.fit(docs.where(~held_out())))
    langs, score = scorer.predict([r.text for r in rows])
    kept = [r for r, lang, s in zip(rows, langs, score) if lang != "und" and s >= 0.5]
    groups = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in kept])}
    kept = [r for r in kept if groups[r.doc_id] == r.doc_id]
    first = {}
    for r in kept:
        for w in windows(split(r.text), 50):
            first.setdefault(w, r.doc_id)
    left = {}
    for r in kept:
        words, gone = split(r.text), set()
        for i, w in enumerate(windows(words, 50)):
            if first[w] < r.doc_id:
                gone |= set(range(i, i + 50))
        if not words or len(gone) < len(words):
            left[r.doc_id] = (r.text, [w for i, w in enumerate(words) if i not in gone], bool(gone))
    leaks = defaultdict(set)
    for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = plain(b.text)
        for w in windows(words, min(10, len(words))) if words else ():
            leaks[len(w)].add(w)
    clean = {i: x for i, x in left.items() if not any(w in own for n, own in leaks.items() for w in windows(plain(" ".join(x[1])), n))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == clean.keys() and 0 < len(got) < len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, (text, words, shorter) in clean.items():
        assert got[i].round_trip and got[i].n_tokens == len(got[i].ids)
        if shorter:
            assert split(library.decode(got[i].ids)) == words
        else:
            assert got[i].ids == library.encode(text)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (3, "the cat and the dog", "en", "s", 19), (None, "the cat and the dog", "en", "s", 19), (4, "the cat and the dog", "en", None, 19)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        assert ids == {"language": [(False, 3), (False, 4), (True, 0)], "near_duplicates": [(False, 1), (False, 2), (False, 3), (True, 0)]}.get(name, [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]), name
        assert stage(spark, docs.limit(0), SF).count() == 0
