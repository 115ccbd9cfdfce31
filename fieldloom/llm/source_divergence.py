"""Source divergence audit: how far the words of each source of a language are from those of its other sources.

A sort-based stream: map tasks sort the terms of their documents by (language, term, source, document), and a run-length
scan turns every run of a source into one partial row with its document frequency and count, so a common term leaves
a task once for each source and not once for each document. The partial rows are dealt by (language, term) and sorted
within their partitions by (language, term, source, part); a second scan sums the runs as they pass, keeps one run at a
time, and emits the terms that enough documents of the language hold. Shares of these terms are then compared block by
block of terms: each block emits its partial sums for pairs of sources and its first terms of each source.

All arithmetic is in whole numbers: with c occurrences of a term among n of v kept terms, its share is
p = 1 + floor(10**9 * (c + smooth) / (n + smooth * v)).

Defined cases: a null text, language or source is the empty string; a text without terms still makes its source appear;
a language of which no term is kept has pair rows of value 0; a language with one source has no pair rows; every row is
a document of its own, even if it repeats an id; very long texts are taken whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.store import cut, release

NOT_TERM = bw.separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Partial rows gathered in a map task before they are combined again, and combined rows that it holds at most.
GATHER, HOLD = 400_000, 1_500_000
#: Rows of kept (term, source) that a block of terms is sized for, and shares compared at once.
BLOCK_ROWS, AT_ONCE = 200_000, 1 << 20
SCALE, SMOOTH = 1_000_000_000, 5

PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("part", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])


class _Held:
    """Partial rows of a map task: terms by hash, groups by number, sorted runs summed up."""

    def __init__(self) -> None:
        self.terms: dict[int, bytes] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def number(self, lang: pa.Array, source: pa.Array) -> np.ndarray:
        pairs = zip(lang.to_pylist(), source.to_pylist(), strict=True)
        return np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], dtype=np.int64)

    def add(self, data: np.ndarray, at: np.ndarray, group: np.ndarray) -> None:
        """The terms of the texts of a slice."""
        data = bw.LOWER[data]
        starts, ends, first = bw.words(data, at, NOT_TERM)
        if not len(starts):
            return
        hashes = bw.word_hashes(data, starts, ends)
        row = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
        # Runs of a term in a document, then of a term in a group.
        order = np.lexsort((row, group[row], hashes))
        hashes, row = hashes[order], row[order]
        new = np.flatnonzero(bw.heads(hashes, row))
        n = np.diff(np.append(new, len(row)))
        term = np.flatnonzero(bw.heads(hashes))
        for h, word in zip(hashes[term].tolist(), order[term].tolist(), strict=True):
            if h not in self.terms:
                self.terms[h] = data[starts[word] : ends[word]].tobytes()
        self._push(hashes[new], group[row[new]], np.ones(len(new), dtype=np.int64), n)

    def _push(self, hashes: np.ndarray, group: np.ndarray, docs: np.ndarray, n: np.ndarray) -> None:
        run = np.flatnonzero(bw.heads(hashes, group))
        if len(run):
            self.rows.append((hashes[run], group[run], np.add.reduceat(docs, run), np.add.reduceat(n, run)))
            self.held += len(run)

    def combine(self) -> None:
        hashes, group, docs, n = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((group, hashes))
        self.rows, self.held = [], 0
        self._push(hashes[order], group[order], docs[order], n[order])

    def emit(self, part: int) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self.combine()
        hashes, group, docs, n = self.rows[0]
        known = list(self.groups)
        langs, sources = (pa.array([g[k] for g in known], pa.string()) for k in (0, 1))
        for low in range(0, len(hashes), 50_000):
            cut_ = slice(low, low + 50_000)
            terms = pa.array([self.terms[h] for h in hashes[cut_].tolist()], pa.binary()).cast(pa.string())
            own = pa.array(group[cut_])
            yield pa.record_batch([langs.take(own), terms, sources.take(own), pa.array(np.full(len(terms), part)), pa.array(docs[cut_]), pa.array(n[cut_])], schema=PARTIAL)
        self.__init__()


@bw.tidied
def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: lang, source, text."""
    held, part, last = _Held(), 0, 0
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(k), "") for k in (0, 1))
        group = held.number(lang, source)
        for low, high, data, at in bw.text_slices(batch.column(2)):
            held.add(data, at, group[low:high])
            if held.held - last >= GATHER:
                held.combine()
                last = held.held
        if held.held >= HOLD or len(held.terms) >= HOLD:
            yield from held.emit(part)
            part, last = part + 1, 0
    yield from held.emit(part)


@bw.tidied
def _kept(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (lang, term, source, part): the sums of every source of the terms that enough documents hold.
    Only the run that a batch ends in is carried over."""
    rest: pa.Table | None = None

    def scan(table: pa.Table) -> pa.RecordBatch:
        lang, term, source = (pc.dictionary_encode(table.column(k).combine_chunks()).indices.to_numpy() for k in ("lang", "term", "source"))
        docs, n = (table.column(k).to_numpy() for k in ("docs", "n"))
        run = np.flatnonzero(bw.heads(lang, term, source))
        docs, n, lang, term = np.add.reduceat(docs, run), np.add.reduceat(n, run), lang[run], term[run]
        whole = np.flatnonzero(bw.heads(lang, term))
        often = np.repeat(np.add.reduceat(docs, whole) >= least, np.diff(np.append(whole, len(run))))
        take = pa.array(run[often])
        columns = [table.column(k).combine_chunks().take(take) for k in ("lang", "term", "source")]
        return pa.record_batch([*columns, pa.array(n[often])], names=["lang", "term", "source", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        lang, term = table.column("lang"), table.column("term")
        same = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1]))
        at = pc.index(same, True).as_py()
        if at:
            yield scan(table.slice(0, at))
        rest = _summed(table.slice(at))
    if rest is not None:
        yield scan(rest)


def _summed(run: pa.Table) -> pa.Table:
    """Rows of one term, in order, with one row for each source: what is carried on stays small."""
    source = pc.dictionary_encode(run.column("source").combine_chunks()).indices.to_numpy()
    at = np.flatnonzero(bw.heads(source))
    out = run.take(pa.array(at))
    for name in ("docs", "n"):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(np.add.reduceat(run.column(name).to_numpy(), at)))
    return out


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), by long division: no step leaves 64 bits."""
    above, below = count + SMOOTH, total + SMOOTH * kept
    out, rest = above // below, above % below
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return out + 1


def _block(key: tuple, kept: pa.Table, sources: pa.Table, top: int) -> pa.Table:
    """Of one block of terms of a language: for each pair of sources the sum of the differences of their shares, and
    for each source its first terms. sources: all of the language, with their totals (n) and the language's (all, kept)."""
    lang = key[0].as_py()
    names = sources.column("source").to_pylist()
    total, everything = sources.column("n").to_numpy(), sources.column("all")[0].as_py()
    kept_terms = sources.column("kept")[0].as_py()
    order = {s: k for k, s in enumerate(names)}
    terms = pc.dictionary_encode(kept.column("term").combine_chunks())
    term = terms.indices.to_numpy()
    source = np.array([order[s] for s in kept.column("source").to_pylist()], dtype=np.int64)
    n = kept.column("n").to_numpy()
    sort = np.argsort(term, kind="stable")
    term, source, n = term[sort], source[sort], n[sort]
    of_lang = share(np.bincount(term, n, len(terms.dictionary)).astype(np.int64), np.int64(everything), kept_terms)
    # Pairs: the shares of some terms in all sources at once.
    apart = np.zeros((len(names), len(names)), dtype=np.int64)
    step = max(1, AT_ONCE // len(names))
    for low in range(0, len(terms.dictionary), step):
        high = min(low + step, len(terms.dictionary))
        i, j = np.searchsorted(term, low), np.searchsorted(term, high)
        counts = np.zeros((len(names), high - low), dtype=np.int64)
        counts[source[i:j], term[i:j] - low] = n[i:j]
        shares = share(counts, total[:, None], kept_terms)
        for k in range(len(names)):
            apart[k, k + 1 :] += np.abs(shares[k + 1 :] - shares[k]).sum(axis=1)
    a, b = np.triu_indices(len(names), 1)
    # Terms of which a source has more than the language: the first ones of each source, ties by their bytes.
    more = share(n, total[source], kept_terms) - of_lang[term]
    own = np.flatnonzero(more > 0)
    value, by = more[own], source[own]
    words = terms.dictionary.cast(pa.binary()).to_pylist()
    first = sorted(range(len(own)), key=lambda x: (by[x], -value[x], words[term[own[x]]]))
    rank = np.arange(len(own)) - np.searchsorted(by[first], by[first]) if len(own) else np.zeros(0, dtype=np.int64)
    picked = np.array(first, dtype=np.int64)[rank < top]
    at = pa.array(np.concatenate([a, by[picked]]))
    items = [names[k] for k in b] + [words[term[own[x]]].decode() for x in picked]
    parts = ["pair"] * len(a) + ["term"] * len(picked)
    return pa.table({"lang": pa.array([lang] * len(at), pa.string()), "source": pa.array(names, pa.string()).take(at), "part": pa.array(parts, pa.string()), "item": pa.array(items, pa.string()), "value": pa.array(np.concatenate([apart[a, b], value[picked]]), pa.int64())})


def kept_terms(docs: DataFrame, least: int = 30, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, term, source, n): occurrences of the terms that `least` documents of the language or more hold."""
    partial = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).mapInArrow(_partial, "lang string, term string, source string, part long, docs long, n long")
    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "part")
    return dealt.mapInArrow(lambda it: _kept(it, least), "lang string, term string, source string, n long")


def audit(docs: DataFrame, least: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, every other source of the language; part `term`, the `top`
    terms of which the source has a larger share than the language."""
    kept = cut(kept_terms(docs, least, lang_col, source_col, text_col), "terms")
    release(docs.sparkSession)
    groups = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.count_distinct("term").alias("kept"), F.count("*").alias("rows"))
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    sources = cut(groups.join(by_source.drop("rows"), ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce(blocks, F.lit(0)).cast("int").alias("blocks")), "sources")
    left = kept.join(by_lang.select("lang", blocks.cast("int").alias("blocks")), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "source", "n")
    right = sources.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = cut(left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(lambda key, x, y: _block(key, x, y, top), "lang string, source string, part string, item string, value long"), "divergence")
    one, other = sources.select("lang", "source", "blocks"), sources.select("lang", F.col("source").alias("item"))
    none = one.where("blocks = 0").join(other, "lang").where("source < item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    half = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).union(none)
    pairs = half.union(half.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.union(found.where("part = 'term'").select("lang", "source", "part", "item", "value")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
