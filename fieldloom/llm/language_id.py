"""Language identification by word-first backoff.

A word that the training rows hold at least `min_count` times is scored by its log frequency in each language. Any
other word falls back to character n-grams with word edges marked: at each place the longest known n-gram is taken,
from `longest` characters down to one, and the mean of their log frequencies is the word's score. Frequencies are
counted in Spark over at most `max_rows` labelled rows (those with the smallest hash of their id), which bounds the
model that travels with the tasks: it holds no more than words / min_count words. Distinct words of a batch are scored
once; documents only add up rows of a table.

score is the posterior of the predicted language under equal priors, with the mean score of a word taken for at most
`evidence` words, so that it stays below 1 where words disagree.

Defined cases: a text that is null or without a letter gives `und` with score 0, as do all texts when no row has a
label; of languages with equal scores the first by name is taken; very long texts are read whole; repeated rows, and
rows without an id, are predicted each; an empty table gives no rows; extra columns pass, and those named like an output
give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.store import widened

#: Distinct words whose scores a task remembers.
CACHE = 400_000
_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    longest: int
    evidence: int


def _table(rows, languages: list[str], smooth: float) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies by language of (lang, key, n) rows."""
    place = {x: i for i, x in enumerate(languages)}
    keys = {k: i for i, k in enumerate(sorted(set(rows["key"])))}
    counts = np.zeros((len(keys), len(languages)))
    np.add.at(counts, (rows["key"].map(keys).to_numpy(dtype=np.int64), rows["lang"].map(place).to_numpy(dtype=np.int64)), rows["n"].to_numpy(dtype=float))
    logs = np.log(counts + smooth) - np.log(counts.sum(axis=0, keepdims=True) + smooth * max(1, len(keys)))
    return keys, logs.astype(np.float32)


def fit(rows: DataFrame, max_rows: int = 8_000, min_count: int = 3, longest: int = 4, evidence: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a text and a language."""
    labelled = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    last = labelled.select("h").orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    if last is None:
        return Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32), longest, evidence)
    words = labelled.where(F.col("h") <= last).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n")).persist()
    try:
        known = words.withColumn("all", F.sum("n").over(_by_key())).where(F.col("all") >= min_count).select("lang", "key", "n").toPandas()
        marked = F.concat(F.lit("^"), F.col("key"), F.lit("$"))
        sizes = F.array(*(F.lit(i) for i in range(1, longest + 1)))
        cuts = F.flatten(F.transform(sizes, lambda k: F.when(F.length("w") >= k, F.transform(F.sequence(F.lit(1), F.length("w") - k + 1), lambda i: F.substring(F.col("w"), i, k))).otherwise(F.array().cast("array<string>"))))
        grams = words.select("lang", marked.alias("w")).select("lang", F.explode(cuts).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n")).where("n > 1").toPandas()
    finally:
        words.unpersist()
    languages = sorted(set(known["lang"]) | set(grams["lang"]))
    word_keys, word_scores = _table(known, languages, 0.5)
    gram_keys, gram_scores = _table(grams, languages, 0.5)
    return Model(languages, word_keys, word_scores, gram_keys, gram_scores, longest, evidence)


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("key")


def backoff(word: str, grams: dict[str, int], longest: int) -> list[int]:
    """Numbers of the longest known n-grams at each place of an unseen word."""
    marked, found = f"^{word}$", []
    for i in range(len(marked)):
        for n in range(min(longest, len(marked) - i), 0, -1):
            number = grams.get(marked[i : i + n])
            if number is not None:
                found.append(number)
                break
    return found


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=bool)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > CACHE:
            self._forget()
        m = self.model
        new = list(set(words).difference(self.known))
        if not new:
            return
        made = np.zeros((len(new), len(m.languages)), dtype=np.float32)
        seen = np.array([m.words.get(w, -1) for w in new])
        made[seen >= 0] = m.word_scores[seen[seen >= 0]]
        unseen = np.flatnonzero(seen < 0)
        lists = [backoff(new[i], m.grams, m.longest) for i in unseen]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        if size.sum():
            sums = np.concatenate([np.zeros((1, made.shape[1])), np.cumsum(m.gram_scores[[g for x in lists for g in x]], axis=0, dtype=np.float64)])
            ends = np.cumsum(size)
            made[unseen] = (sums[ends] - sums[ends - size]) / np.maximum(size, 1)[:, None]
        self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, made])
        self.letters = np.concatenate([self.letters, [any(map(str.isalpha, w)) for w in new]])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words, first = [], [0]
        for t in texts:
            if t:
                words += _WORDS(t.lower())
            first.append(len(words))
        at = np.array(first)
        n = np.diff(at)
        langs = self.model.languages
        if not langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        self._learn(words)
        number = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(self.scores[number], axis=0, dtype=np.float64)])
        mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)[:, None]
        weight = np.minimum(n, self.model.evidence)[:, None] * mean
        odds = np.exp(weight - weight.max(axis=1, keepdims=True))
        best = weight.argmax(axis=1)
        score = odds[np.arange(len(best)), best] / odds.sum(axis=1)
        hits = np.concatenate([[0], np.cumsum(self.letters[number])])
        real = hits[at[1:]] > hits[at[:-1]]
        return [langs[b] if r else "und" for b, r in zip(best, real, strict=True)], np.where(real, score, 0.0)


ADDED = {"lang_pred": "string", "score": "double"}


@bw.tidied
def _predicted(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, keep: list[int]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        for low, high, _, _ in bw.text_slices(batch.column(text_at)):
            langs, score = scorer.predict(batch.column(text_at).slice(low, high - low).to_pylist())
            yield pa.record_batch([*(batch.column(i).slice(low, high - low) for i in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*(batch.schema.names[i] for i in keep), *ADDED])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score; input columns with these names give way."""
    docs = docs.drop(*(c for c in ADDED if c in docs.columns and c != text_col))
    text_at = docs.columns.index(text_col)
    keep = [i for i in range(len(docs.columns)) if keep_text or i != text_at]
    return docs.mapInArrow(lambda it: _predicted(it, model, text_at, keep), widened([docs.schema[i] for i in keep], ADDED))
