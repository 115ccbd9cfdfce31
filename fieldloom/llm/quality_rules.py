"""Quality rules as a bitmask ledger.

measure() evaluates every rule once for each document: the measurements and one bit for each rule that fails;
ledger() stores this, without the texts, in the shared folder. Policies are versions of a mask over these bits:
apply_policy() only compares bits, and ablate() gets, from bitwise counts over the ledger, how many documents each rule
rejects alone, among others, or last. No text is read again for a new policy.

Defined cases: a null or empty text has no words, fails the base rules and has 0 in every measurement; very long
texts are measured whole; repeated rows are measured each; a null id is a row like any other; an empty table gives an
empty ledger and an ablation of zeros; extra columns pass unless they bear a ledger name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.store import cut, widened

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word; those of them that equal an earlier line."""
    seen: set[bytes] = set()
    lines = twice = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            lines += 1
            if line in seen:
                twice += 1
            seen.add(line)
    return lines, twice


def _repeat_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the words that lie in a 3-word window found at least twice in the row."""
    n = len(first) - 1
    got, word, row = bw.window_hashes(bw.word_hashes(data, starts, ends), first, 3)
    if not len(got):
        return np.zeros(n, dtype=np.int64)
    order = np.lexsort((got, row))
    new = bw.heads(got[order], row[order])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(got)))
    twice = word[order][np.repeat(size > 1, size)]
    covered = np.zeros(len(starts) + 1, dtype=np.int64)
    for i in range(3):
        covered[twice + i] = 1
    sums = np.concatenate([[0], np.cumsum(covered[:-1])])
    return sums[first[1:]] - sums[first[:-1]]


@bw.tidied
def _measures(batches: Iterator[pa.RecordBatch], text_at: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, at in bw.text_slices(batch.column(text_at)):
            starts, ends, first = bw.words(data, at, bw.BLANKS)
            sums = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~bw.BLANKS[data])])
            marks = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
            raw = data.tobytes()
            lines = np.array([_dup_lines(raw[at[i] : at[i + 1]]) for i in range(high - low)], dtype=np.int64).reshape(-1, 2)
            cols = (np.diff(first), sums[at[1:]] - sums[at[:-1]], marks[at[1:]] - marks[at[:-1]], lines[:, 0], lines[:, 1], _repeat_words(data, starts, ends, first))
            rest = [i for i in range(batch.num_columns) if keep_text or i != text_at]
            kept = [batch.column(i).slice(low, high - low) for i in rest]
            yield pa.record_batch([*kept, *(pa.array(c, pa.int64()) for c in cols)], names=[*(batch.schema.names[i] for i in rest), *MEASURES])


#: Name of each rule and when a document fails it; the place in this list is the bit. New rules go at the end.
RULES: list[tuple[str, Column | str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
]

#: Versions of policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    place = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << place[name] for name in names)


def measure(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The ledger: docs with the measurements and `failures`, a bit for each failed rule."""
    names = [*MEASURES, "failures"]
    docs = docs.drop(*(c for c in names if c in docs.columns and c != text_col))
    rest = [c for c in docs.columns if keep_text or c != text_col]
    schema = widened([docs.schema[c] for c in rest], dict.fromkeys(MEASURES, "long"))
    text_at = docs.columns.index(text_col)
    found = docs.mapInArrow(lambda it: _measures(it, text_at, keep_text), schema)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return found.withColumn("failures", total)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """measure() without the texts, stored: what policies and ablations are computed from."""
    return cut(measure(docs, text_col, keep_text=False), "ledger")


def sole(policy: str | tuple[str, ...], failures: str = "failures") -> Column:
    """The name of the rule of the policy that alone rejects a row, null for rows that none or several reject."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = F.col(failures).bitwiseAND(F.lit(mask(policy)))
    return F.coalesce(*(F.when(bits == mask((name,)), F.lit(name)) for name in names))


def rejects(policy: str | tuple[str, ...], failures: Column | str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) != 0 if isinstance(failures, str) else failures.bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(ledger: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    return ledger.withColumn("kept", ~rejects(policy))


def ablate(ledger: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, that only it rejects, and that would be kept without it."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(tuple(names))
    by_mask = ledger.select(F.col("failures").bitwiseAND(F.lit(whole)).alias("bits")).groupBy("bits").count()
    rows = []
    for name in names:
        bit = mask((name,))
        rows.append(F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("count"))), F.lit(0)).alias("n_fail"), F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("count"))), F.lit(0)).alias("n_only"), F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(whole & ~bit)) == 0, F.col("count"))), F.lit(0)).alias("n_kept_without")))
    return by_mask.agg(F.array(*rows).alias("r")).select(F.inline("r"))
