"""Benchmark decontamination by a distributed positional inverted index of the training documents.

The index is partitioned by documents: one stored row holds a block of documents and, for each term in it, the sorted
list of positions. A block is bounded by its bytes, so neither a common word nor a large group of copies meets in one
task. Test phrases are a stored table as well. A phrase is routed by its rarest term over all documents: only blocks
that hold this term get the phrase, as a row (block, phrase). A task then takes a block with its phrases and
intersects the lists of positions, adjusted by the terms' offsets, from the rarest term of the block to the commonest.
Nothing about the phrases is held by the driver, whatever their number; a block with very many of them is dealt in
parts. Only terms of the test set are posted unless there are more of them than VOCABULARY.

A word is a run of ASCII letters, digits and non-ASCII characters after A-Z became a-z. A test phrase is `window`
consecutive words of an item; an item with fewer words, but at least one, is one phrase.

Defined cases: null and empty texts have no words, and such items no phrase; very long texts are indexed whole, as a
block of their own; phrases never cross from one document to the next; rows that repeat a document id, and rows without
one, are matched and returned on their own; items that share an id count as one; a null item id reads as the empty
string; an empty test set leaves every document clean; extra columns of documents and items are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.store import cut

#: Terms of a vocabulary that travels with tasks, bytes of text in a block, phrases that a block takes at once.
VOCABULARY, BLOCK_BYTES, AT_ONCE = 1_000_000, 1 << 20, 50_000
INDEX = "block string, doc_ids array<long>, starts binary, terms binary, ends binary, positions binary"
MATCHES = "block string, ordinal int, doc_id long, n_words long, hit_starts array<int>, hit_ends array<int>, items array<string>"
PHRASES = "phrase binary, item string"


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = bw.LOWER[data]
    starts, ends, first = bw.words(low, at, bw.NOT_ALNUM)
    return bw.word_hashes(low, starts, ends), first


@bw.tidied
def _index(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, at in bw.text_slices(batch.column(1), BLOCK_BYTES):
            hashes, first = _terms(data, at)
            n = high - low
            where = np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(first))  # one position stays free after each document
            if vocabulary is not None:
                near = np.searchsorted(vocabulary, hashes)
                near[near == len(vocabulary)] = 0
                known = vocabulary[near] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)
                hashes, where = hashes[known], where[known]
            order = np.argsort(hashes, kind="stable")
            hashes, where = hashes[order], where[order]
            own = np.flatnonzero(bw.heads(hashes))
            blob = lambda x, kind: pa.array([np.ascontiguousarray(x, dtype=kind).tobytes()], pa.binary())
            ids = batch.column(0).slice(low, n).cast(pa.int64())
            yield pa.record_batch(
                [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), blob(first + np.arange(n + 1), np.int64), blob(hashes[own], np.uint64), blob(np.append(own[1:], len(hashes)) if len(own) else own, np.int64), blob(where, np.uint32)],
                names=["block", "doc_ids", "starts", "terms", "ends", "positions"],
            )


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index; vocabulary: sorted hashes of the only terms to post, or None for all."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(slim.mapInArrow(lambda it: _index(it, vocabulary), INDEX), "postings")


class Block:
    """One stored row of the index."""

    def __init__(self, row: dict):
        self.docs = row["doc_ids"]
        self.starts = np.frombuffer(row["starts"], dtype=np.int64)
        self.terms = np.frombuffer(row["terms"], dtype=np.uint64)
        self.ends = np.concatenate([[0], np.frombuffer(row["ends"], dtype=np.int64)])
        self.positions = np.frombuffer(row["positions"], dtype=np.uint32).astype(np.int64)

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each phrase's terms in this block; which phrases have all their terms here."""
        if not len(self.terms):
            return np.zeros(phrases.shape, dtype=np.int64), np.zeros(len(phrases), dtype=bool)
        at = np.minimum(np.searchsorted(self.terms, phrases), len(self.terms) - 1)
        return at, (self.terms[at] == phrases).all(axis=1)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term] : self.ends[term + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand one after the other."""
        size = self.ends[terms + 1] - self.ends[terms]
        found = None
        for offset in np.argsort(size, kind="stable"):
            here = self.postings(terms[offset])
            if found is None:
                found = here - offset
                continue
            want = found + offset
            near = np.minimum(np.searchsorted(here, want), len(here) - 1)
            found = found[here[near] == want]
            if not len(found):
                break
        return found

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """Where spans of `width` words of one document begin that hold all the terms in any order and begin with one."""
        lists = sorted((self.postings(t) for t in np.unique(terms)), key=len)
        rare = lists[0]
        begin = np.unique(np.concatenate(lists))
        nxt = np.minimum(np.searchsorted(rare, begin), len(rare) - 1)
        begin = begin[(rare[nxt] >= begin) & (rare[nxt] < begin + width)]
        limit = np.minimum(begin + width, self.starts[np.searchsorted(self.starts, begin, side="right")] - 1)
        for here in lists:
            held = np.searchsorted(here, begin) < np.searchsorted(here, limit)
            begin, limit = begin[held], limit[held]
        return begin


@bw.tidied
def _phrases(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Columns: item, text. The terms of each phrase."""
    for batch in batches:
        for low, high, data, at in bw.text_slices(batch.column(1)):
            hashes, first = _terms(data, at)
            count = np.diff(first)
            runs = np.maximum(count - window + 1, count > 0)
            row = np.repeat(np.arange(high - low), runs)
            begin = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
            size = np.minimum(count[row], window)
            cuts = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], size)
            yield pa.record_batch([bw.binary_rows(hashes[take], cuts), batch.column(0).take(pa.array(row + low))], names=["phrase", "item"])


def phrase_table(items: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Stored: (phrase, items), each different phrase with the ids of the items that have it."""
    slim = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return cut(slim.mapInArrow(lambda it: _phrases(it, window), PHRASES).groupBy("phrase").agg(F.collect_set("item").alias("items")), "phrases")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different term of each phrase."""
    for batch in batches:
        lists = batch.column(0).to_pylist()
        terms = np.frombuffer(b"".join(lists), dtype=np.int64)
        row = np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists])
        order = np.lexsort((terms, row))
        terms, row = terms[order], row[order]
        own = bw.heads(terms, row)
        yield pa.record_batch([batch.column(0).take(pa.array(row[own])), pa.array(terms[own])], names=["phrase", "term"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: block, terms, ends. How often each term stands in the block."""
    for batch in batches:
        for block, terms, ends in zip(*(batch.column(k) for k in range(3)), strict=True):
            own = np.frombuffer(terms.as_buffer(), dtype=np.uint64).view(np.int64)
            n = np.diff(np.frombuffer(ends.as_buffer(), dtype=np.int64), prepend=0)
            yield pa.record_batch([pa.array([block.as_py()] * len(own), pa.string()), pa.array(own), pa.array(n, pa.int64())], names=["block", "term", "n"])


def route(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(block, phrase, items): every phrase, all of whose terms are posted, with each block that holds its rarest one."""
    held = index.select("block", "terms", "ends").mapInArrow(_posted, "block string, term long, n long")
    often = held.groupBy("term").agg(F.sum("n").alias("n"))
    terms = phrases.select("phrase").mapInArrow(_exploded, "phrase binary, term long")
    rarest = terms.join(often, "term", "left").groupBy("phrase").agg(F.min(F.struct("n", "term")).alias("rarest"), F.count_if(F.col("n").isNull()).alias("missing")).where("missing = 0")
    keyed = phrases.join(rarest.select("phrase", F.col("rarest.term").alias("term")), "phrase")
    return held.select("term", "block").join(keyed, "term").select("block", "phrase", "items")


def _matches(row: dict, phrases: list[tuple[np.ndarray, list[list[str]]]], width: int) -> pa.RecordBatch:
    """A row for each document of a block. phrases: by length, their terms and items; width: 0 for exact phrases, else the
    span of proximity matches."""
    block = Block(row)
    n = len(block.docs)
    cover = np.zeros(int(block.starts[-1]) + 2, dtype=np.int32)
    begins, ends, items = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
    for terms, owners in phrases:
        at, there = block.find(terms)
        for i in np.flatnonzero(there):
            found = block.near(at[i], width) if width else block.phrase(at[i])
            if not len(found):
                continue
            cover[found] += 1
            doc = np.searchsorted(block.starts, found, side="right") - 1
            stop = np.minimum(found + (width or terms.shape[1]), block.starts[doc + 1] - 1)
            np.add.at(cover, stop, -1)
            for d in np.unique(doc):
                items[d].update(owners[i])
    hit = np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]])
    step = np.diff(hit)
    for b, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        d = int(np.searchsorted(block.starts, b, side="right") - 1)
        begins[d].append(int(b - block.starts[d]))
        ends[d].append(int(e - block.starts[d]))
    return pa.record_batch(
        [pa.array([row["block"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(block.docs, pa.int64()), pa.array(np.diff(block.starts) - 1, pa.int64()), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
        names=["block", "ordinal", "doc_id", "n_words", "hit_starts", "hit_ends", "items"],
    )


def _met(block: pa.Table, phrases: pa.Table, width: int) -> pa.Table:
    """A block of the index with (a part of) its phrases."""
    by: dict[int, tuple[list[bytes], list[list[str]]]] = {}
    for phrase, items in zip(phrases.column("phrase").to_pylist(), phrases.column("items").to_pylist(), strict=True):
        own = by.setdefault(len(phrase) // 8, ([], []))
        own[0].append(phrase)
        own[1].append(items)
    ready = [(np.frombuffer(b"".join(p), dtype=np.uint64).reshape(-1, n), items) for n, (p, items) in sorted(by.items())]
    out = [_matches(row, ready, width) for row in block.to_pylist()]
    bw.tidy()
    return pa.Table.from_batches(out) if out else _NONE


_NONE = pa.table([pa.array([], t) for t in (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))], names=["block", "ordinal", "doc_id", "n_words", "hit_starts", "hit_ends", "items"])


def _union(starts: list, ends: list) -> tuple[list[int], list[int]]:
    out: list[list[int]] = []
    for b, e in sorted(zip(starts, ends, strict=True)):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [x[0] for x in out], [x[1] for x in out]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["hit_starts"], r["hit_ends"] = _union(r["hit_starts"], r["hit_ends"])
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def _vocabulary(phrases: DataFrame) -> np.ndarray | None:
    """The sorted terms of the phrases, or None where there are more than VOCABULARY."""
    terms = phrases.select("phrase").mapInArrow(_exploded, "phrase binary, term long").select("term").distinct()
    found = terms.limit(VOCABULARY + 1).toPandas()["term"].to_numpy(dtype=np.int64)
    return np.sort(found.view(np.uint64)) if len(found) <= VOCABULARY else None


def matches(docs: DataFrame, items: DataFrame, window: int = 10, width: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """A row for each document: doc_id, n_words, hit_starts and hit_ends (maximal word intervals of matches) and items.

    width 0: exact phrases of `window` words. Else all words of such a phrase, in any order, within `width` words.
    index: one made before by build_index(); by default one over the terms of the items is built.
    """
    phrases = phrase_table(items, window, item_col, item_text)
    if index is None:
        index = build_index(docs, _vocabulary(phrases), id_col, text_col)
    routed = route(phrases, index)
    parts = phrases.count() // AT_ONCE + 1
    if parts > 1:
        # A block takes its phrases in parts; what they find is united afterwards.
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int")
        routed = routed.withColumn("part", part)
        index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["block", "part"] if parts > 1 else ["block"]
    blocks = index.groupBy(*keys).cogroup(routed.groupBy(*keys))
    out = blocks.applyInArrow(lambda b, p: _met(b, p, width), MATCHES)
    if parts > 1:
        out = out.groupBy("block", "ordinal", "doc_id", "n_words").agg(F.flatten(F.collect_list("hit_starts")).alias("hit_starts"), F.flatten(F.collect_list("hit_ends")).alias("hit_ends"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).mapInArrow(_merge, MATCHES)
    return out.drop("block", "ordinal")
