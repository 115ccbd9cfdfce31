"""Token counts of lines or fields, attributed through the offsets of whole-document encodings.

A document is encoded once. Sections are consecutive character intervals that cover it; the tokens' spans meet them
in an interval join of two sorted lists, and a token that crosses a boundary goes by an explicit rule:

start     to the section that holds its first character;
majority  to the section with most of its bytes, of equal ones the earlier;
every     to each section that it touches (the counts then sum to more than the document's tokens).

Defined cases: null and empty texts or fields have no section; a line ends with its newline, and a last line without
characters is no section; a token without source bytes (the blank put in front) goes to the first section; very long
texts are encoded whole; repeated rows, and rows without an id, are counted each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.sentencepiece_codec import Codec
from fieldloom.llm.store import widened

RULES = ("start", "majority", "every")


def attribute(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them cross a boundary. begins: first byte of each section, ascending;
    a section ends where the next one begins, the last one nowhere."""
    first = np.searchsorted(begins, starts, side="right") - 1
    last = np.maximum(first, np.searchsorted(begins, ends - 1, side="right") - 1)
    crossing = np.flatnonzero(last > first)
    n = len(begins)
    owner = first.copy()
    more: list[int] = []
    for i in crossing if rule != "start" else ():
        sections = np.arange(first[i], last[i] + 1)
        if rule == "every":
            more += sections[1:].tolist()
            continue
        low = np.maximum(begins[sections], starts[i])
        high = np.minimum(np.append(begins[sections[1:]], ends[i]), ends[i])
        owner[i] = sections[np.argmax(high - low)]
    counts = np.bincount(owner, minlength=n) + np.bincount(np.array(more, dtype=np.int64), minlength=n)
    return counts, np.bincount(owner[crossing], minlength=n)


@bw.tidied
def _counted(batches: Iterator[pa.RecordBatch], model: bytes, text_at: int, cuts_at: int | None, keep: list[int], rule: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(model)
    for batch in batches:
        for low, high, data, at in bw.text_slices(batch.column(text_at)):
            _, starts, ends, cuts = codec.encode_many(batch.column(text_at).slice(low, high - low).to_pylist())
            shift = np.repeat(at[:-1], np.diff(cuts))
            full = at[:-1][np.diff(at) > 0]
            if cuts_at is None:
                inner = np.flatnonzero(data == 10) + 1
            else:
                lists = batch.column(cuts_at).slice(low, high - low).to_pylist()
                inner = np.array([at[i] + x for i, own in enumerate(lists) for x in own or ()], dtype=np.int64)
            begins = np.unique(np.concatenate([full, inner[inner < len(data)]]).astype(np.int64))
            if not len(begins):
                continue
            row = np.searchsorted(at, begins, side="right") - 1
            counts, crossing = attribute(starts + shift, ends + shift, begins, rule)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            stop = np.append(begins[1:], len(data))
            new = bw.heads(row)
            section = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            base = chars[at[row]]
            own = pa.array(row + low)
            made = [pa.array(section, pa.int32()), pa.array(chars[begins] - base, pa.int32()), pa.array(chars[stop] - base, pa.int32()), pa.array(counts, pa.int64()), pa.array(crossing, pa.int64())]
            yield pa.record_batch([*(batch.column(i).take(own) for i in keep), *made], names=[*(batch.schema.names[i] for i in keep), *ADDED])


ADDED = {"section": "int", "begin": "int", "end": "int", "n_tokens": "long", "n_crossing": "long"}


def _run(docs: DataFrame, model: str, text_col: str, cuts_col: str | None, rule: str, keep: Sequence[str]) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(model, "rb") as f:
        blob = f.read()
    text_at = docs.columns.index(text_col)
    cuts_at = docs.columns.index(cuts_col) if cuts_col else None
    at = [docs.columns.index(c) for c in keep if c not in ADDED]
    schema = widened([docs.schema[i] for i in at], ADDED)
    return docs.mapInArrow(lambda it: _counted(it, blob, text_at, cuts_at, at, rule), schema)


def count_lines(docs: DataFrame, model: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line of each document: id, section (from 0), begin and end (characters), n_tokens, n_crossing."""
    return _run(docs.select(id_col, text_col), model, text_col, None, rule, [id_col])


def count_fields(rows: DataFrame, model: str, fields: Sequence[str], separator: str = "\n", rule: str = "start", id_col: str = "doc_id") -> DataFrame:
    """The same for fields that are joined and encoded as one text; a separator belongs to the field before it.

    section is the place among the fields of the row that are neither null nor empty.
    """
    parts = F.filter(F.array(*(F.col(f).cast("string") for f in fields)), lambda x: F.length(x) > 0)
    size = len(separator.encode())
    joined = rows.select(id_col, F.array_join(parts, separator).alias("__text"), F.transform(parts, lambda x: F.octet_length(x) + size).alias("__sizes"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("__sizes") - 1), lambda i: F.aggregate(F.slice("__sizes", 1, i), F.lit(0), lambda a, x: a + x))
    ready = joined.withColumn("__cuts", F.when(F.size("__sizes") > 1, cuts).otherwise(F.array().cast("array<int>")))
    return _run(ready, model, "__text", "__cuts", rule, [id_col])
