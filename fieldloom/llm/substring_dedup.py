"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window of `window` words of every document is hashed from prefix sums. Each map task first combines its own
windows, so a passage that very many documents share leaves a task once for each flush and not once for each
document: occurrences after the task's smallest document are decided on the spot, and only the smallest one asks
the others. What is left is dealt by hash, packed into binary blocks; the task that gets a hash block sorts it and
answers the documents that are not the smallest holder. Repeated windows then merge into maximal word intervals.

Defined cases: a null or empty text has no words; a text of fewer words than the window is left whole; a window is
compared with strictly smaller document ids only, so rows that repeat a document id never remove each other's words;
rows with a null id are left whole and remove nothing; very long texts are taken whole, by their bytes and not as lists
of words; an empty table gives no rows; an input column with the name of an output gives way. Hashes have 64 bits: among n windows the chance that any two
different ones meet is about n * n / 3.7e19.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.store import cut, drop, release, widened

#: Windows gathered in a map task before it combines and emits them; windows a hash block is sized for.
FLUSH, BLOCK = 500_000, 1_000_000
BLOCKS = "block int, hit boolean, docs binary, runs binary, keys binary"


def _by_doc(block: np.ndarray, docs: np.ndarray, keys: np.ndarray, hit: bool) -> pa.RecordBatch | None:
    """One row for each block: its documents, how many keys each has, and the keys."""
    if not len(keys):
        return None
    order = np.lexsort((docs, block))
    block, docs, keys = block[order], docs[order], keys[order]
    at = np.flatnonzero(bw.heads(block, docs))
    runs = np.diff(np.append(at, len(docs))).astype(np.int32)
    own = np.flatnonzero(bw.heads(block))
    cuts = np.append(own, len(keys))
    by_run = np.append(np.searchsorted(at, own), len(at))
    return pa.record_batch([pa.array(block[own].astype(np.int32)), pa.array(np.full(len(own), hit)), bw.binary_rows(docs[at], by_run), bw.binary_rows(runs, by_run), bw.binary_rows(keys, cuts)], names=["block", "hit", "docs", "runs", "keys"])


def _combine(keys: np.ndarray, docs: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    fresh = bw.heads(keys, docs)
    keys, docs = keys[fresh], docs[fresh]
    first = bw.heads(keys)
    rest = ~first
    for part in (_by_doc((keys[first] % np.uint64(blocks)).astype(np.int64), docs[first], keys[first], False), _by_doc(blocks + _doc_block(docs[rest], blocks), docs[rest], keys[rest], True)):
        if part is not None:
            yield part


@bw.tidied
def _windows(batches: Iterator[pa.RecordBatch], window: int, blocks: int) -> Iterator[pa.RecordBatch]:
    keys, docs, held = [], [], 0
    for batch in batches:
        known = np.asarray(batch.column(0).is_valid())
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for low, high, data, at in bw.text_slices(batch.column(1)):
            starts, ends, first = bw.words(data, at, bw.BLANKS)
            if len(starts) < window:
                continue
            got, _, row = bw.window_hashes(bw.word_hashes(data, starts, ends), first, window)
            real = known[low:high][row]
            keys.append(got[real])
            docs.append(ids[low:high][row][real])
            held += len(keys[-1])
            if held >= FLUSH:
                yield from _combine(np.concatenate(keys), np.concatenate(docs), blocks)
                keys, docs, held = [], [], 0
    if held:
        yield from _combine(np.concatenate(keys), np.concatenate(docs), blocks)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
    return np.repeat(join("docs", np.int64), join("runs", np.int32)), join("keys", np.uint64)


def _doc_block(docs: np.ndarray, blocks: int) -> np.ndarray:
    return (bw.mix(docs.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _answer(table: pa.Table, blocks: int) -> pa.Table:
    """Of one hash block (or of a block of documents decided before): the keys to remove, packed by blocks of documents."""
    docs, keys = _unpack(table)
    if not table.column("hit")[0].as_py():
        order = np.lexsort((docs, keys))
        docs, keys = docs[order], keys[order]
        first = bw.heads(keys)
        least = docs[np.flatnonzero(first)][np.cumsum(first) - 1]
        late = docs > least
        docs, keys = docs[late], keys[late]
    part = _by_doc(_doc_block(docs, blocks), docs, keys, True)
    return pa.Table.from_batches([part] if part is not None else [], table.schema)


def _gather(table: pa.Table) -> pa.Table:
    """One row for each document of a block of documents."""
    docs, keys = _unpack(table)
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    own = np.flatnonzero(bw.heads(docs))
    return pa.table([pa.array(docs[own]), bw.binary_rows(keys, np.append(own, len(keys)))], names=["doc", "keys"])


def repeated_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc long, keys binary): hashes of the document's windows that a document with a smaller id holds too. A stored
    table with one row for each such document."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(8, int(size / 6.5 / BLOCK) + 1)
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    packed = slim.mapInArrow(lambda it: _windows(it, window, blocks), BLOCKS)
    answers = cut(packed.groupBy("block").applyInArrow(lambda t: _answer(t, blocks), BLOCKS), "answers")
    release(docs.sparkSession)
    found = cut(answers.groupBy("block").applyInArrow(_gather, "doc long, keys binary"), "windows")
    drop(answers)
    release(docs.sparkSession)
    return found


def intervals(hit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of words covered by the windows that begin where hit is true."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] > at[:-1] + window
    begin = at[new]
    return begin, np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + window


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the words of one text, given by their first and end bytes."""
    got, _, _ = bw.window_hashes(bw.word_hashes(data, starts, ends), np.array([0, len(starts)]), window)
    hit = np.empty(len(got), dtype=bool)
    for low in range(0, len(got), bw.CHUNK):
        hit[low : low + bw.CHUNK] = np.isin(got[low : low + bw.CHUNK], keys)
    return intervals(hit, window)


#: The columns that remove_repeats() adds.
ADDED = {"n_words": "long", "n_removed": "long", "span_starts": "array<int>", "span_ends": "array<int>", "kept_text": "string", "cut_text": "string"}


@bw.tidied
def _removed(batches: Iterator[pa.RecordBatch], window: int, text_at: int, outputs: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of about a MB of text; what nobody asked for is not made."""
    for batch in batches:
        for low, high, data, at in bw.text_slices(batch.column(text_at)):
            own = batch.slice(low, high - low)
            starts, ends, first = bw.words(data, at, bw.BLANKS)
            n_words, spans = np.diff(first), {}
            for r in np.flatnonzero(np.asarray(own.column(-1).is_valid()) & (n_words >= window)):
                words = slice(first[r], first[r + 1])
                found = _spans(data[at[r] : at[r + 1]], starts[words] - at[r], ends[words] - at[r], np.frombuffer(own.column(-1)[int(r)].as_buffer(), dtype=np.uint64), window)
                if len(found[0]):
                    spans[int(r)] = found
            made = {}
            if "n_words" in outputs:
                made["n_words"] = pa.array(n_words, pa.int64())
            if "n_removed" in outputs:
                gone = np.zeros(len(n_words), dtype=np.int64)
                gone[list(spans)] = [int((e - b).sum()) for b, e in spans.values()]
                made["n_removed"] = pa.array(gone)
            for k, name in enumerate(("span_starts", "span_ends")):
                if name in outputs:
                    made[name] = pa.array([spans[r][k] if r in spans else [] for r in range(len(n_words))], pa.list_(pa.int32()))
            if "kept_text" in outputs:
                none = np.zeros(0, dtype=np.int64)
                made["kept_text"] = pa.array([bw.kept_words(data, starts, ends, first[r], first[r + 1], *spans.get(r, (none, none))) for r in range(len(n_words))], pa.binary()).cast(pa.string())
            if "cut_text" in outputs:
                short = pa.array([_without(data[at[r] : at[r + 1]], starts[first[r] : first[r + 1]] - at[r], *spans[r]) if r in spans else None for r in range(len(n_words))], pa.binary()).cast(pa.string())
                made["cut_text"] = pc.coalesce(short, own.column(text_at).cast(pa.string())) if spans else own.column(text_at).cast(pa.string())
            yield pa.record_batch([*own.columns[:-1], *made.values()], names=[*own.schema.names[:-1], *made])


def _without(data: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """The text without the words of the intervals and without the blanks that follow each of them."""
    edges = np.append(starts, len(data))
    cuts = [0, *np.stack([edges[begin], edges[end]], axis=1).reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = tuple(ADDED)) -> DataFrame:
    """docs with n_words, n_removed, span_starts, span_ends (word intervals), kept_text (kept words joined by one
    space) and cut_text (the text with its own spacing, without the removed intervals), or with some of these.
    An input column with one of these names gives way."""
    outputs = [name for name in ADDED if name in outputs]
    docs = docs.drop(*(name for name in outputs if name in docs.columns))
    hits = repeated_windows(docs, window, id_col, text_col).withColumnsRenamed({"doc": "__hit", "keys": "__keys"})
    own = docs.withColumn("__doc", F.col(id_col).cast("long"))
    joined = own.join(hits, F.col("__doc") == F.col("__hit"), "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__keys")
    schema = widened(docs.schema.fields, {name: ADDED[name] for name in outputs})
    text_at = docs.columns.index(text_col)
    return joined.mapInArrow(lambda it: _removed(it, window, text_at, outputs), schema)
