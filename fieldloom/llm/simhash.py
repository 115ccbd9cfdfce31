"""SimHash near-duplicates: every pair of fingerprints within a radius, found by tiled exact comparison.

1. Each text becomes a fingerprint: bit by bit the majority of the XXH64 hashes of its word shingles, repeats included.
   Equal fingerprints fall together (one class, its smallest document stands for it).
2. Tiles: of radius + 1 parts of a fingerprint, two fingerprints within the radius have one part in common, so the
   classes are dealt once for each part and meet in the tile of that part's value. This is exact, and tiles grow far
   slower than all classes squared. A tile of many classes is cut by population count, into bands of radius + 1: only
   equal and neighbouring bands can hold partners, so other pairs of its tiles are never made; and further by hash, into
   sides of SIDE classes, so that a task never holds more than a few sides, however hot the tile.
3. Inside a task classes are sorted by population count, and blocks of them are compared by exclusive-or and bit counts
   with those whose counts are near enough. What leaves a task is no list of pairs but a star for each group that it
   found, so that a group of n classes makes n - 1 links there.
4. Links become components by large-star and small-star rounds.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; a null text or one without words
has fingerprint zero and links like any other; very long texts are taken whole, in pieces; rows that repeat an id belong
to one component; rows with a null id get a fingerprint but no component and link nothing; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.components import components
from fieldloom.llm.store import cut, release

#: Words of a text that are hashed at once.
PIECE = 1 << 14
#: Classes on a side of a tile, and classes of small tiles that a task gets together.
SIDE, BUNDLE = 16_384, 16_384
#: Pairs compared at once; classes of a tile up to which neighbours are compared step by step.
AT_ONCE, STEPS = 1 << 20, 32

# Fingerprints


def _votes(data: bytes, starts: np.ndarray, words: int, votes: np.ndarray, seed: int) -> None:
    """Add the bits of the hashes of all shingles of a piece: words joined by one space, each beginning at starts."""
    digest = xxhash.xxh64_intdigest
    n = max(len(starts) - words + 1, 1)
    ends = np.append(starts[words:] - 1, len(data))[:n]
    hashes = np.fromiter((digest(data[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=n)
    votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = 4, seed: int = 42) -> int:
    """Of the words of one text, given by their first and end bytes."""
    n = len(starts)
    if not n:
        return 0
    votes, shingles = np.zeros(64, dtype=np.int64), max(n - words + 1, 1)
    for low in range(0, shingles, PIECE):
        high = min(low + PIECE + words - 1, n)
        piece = b" ".join(data[starts[low] : ends[high - 1]].tobytes().lower().split())
        size = ends[low:high] - starts[low:high] + 1
        _votes(piece, np.cumsum(size) - size, words, votes, seed)
    return int(np.packbits(2 * votes > shingles, bitorder="little").view(np.uint64)[0])


@bw.tidied
def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for low, high, data, at in bw.text_slices(batch.column(1)):
            starts, ends, first = bw.words(data, at, bw.BLANKS)
            out += [fingerprint(data, starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], words) for r in range(high - low)]
        yield pa.record_batch([batch.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["doc", "bits"])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc long, bits long) of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda it: _fingerprints(it, words), "doc long, bits long")


# Tiles


class _Groups:
    """Groups of rows that links have joined so far; a row's label is the least row of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _compare(bits: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, groups: _Groups) -> None:
    """Join the rows of left and right within the radius; both lists are sorted by population count."""
    count = np.bitwise_count(bits).astype(np.int64)
    near = count[right]
    step = max(1, AT_ONCE // max(len(right), 1))
    for low in range(0, len(left), step):
        some = left[low : low + step]
        i = int(np.searchsorted(near, count[some[0]] - radius))
        j = int(np.searchsorted(near, count[some[-1]] + radius, side="right"))
        i = max(i, low) if left is right else i
        if i >= j:
            continue
        close = np.bitwise_count(bits[some][:, None] ^ bits[right[i:j]][None, :]) <= radius
        a, b = np.nonzero(close)
        groups.join(some[a], right[i:j][b])


def _stars(doc: np.ndarray, groups: _Groups) -> pa.Table:
    member = np.flatnonzero(groups.label != np.arange(len(doc)))
    return pa.table({"a": pa.array(doc[groups.label[member]], pa.int64()), "b": pa.array(doc[member], pa.int64())})


def _bundle(table: pa.Table, radius: int) -> pa.Table:
    """Links inside the tiles of one bundle."""
    value, bits, doc = (table.column(c).to_numpy() for c in ("value", "bits", "doc"))
    bits = bits.view(np.uint64)
    order = np.lexsort((bits, np.bitwise_count(bits), value))
    value, bits, doc = value[order], bits[order], doc[order]
    groups = _Groups(len(doc))
    at = np.flatnonzero(bw.heads(value))
    size = np.diff(np.append(at, len(value)))
    small = np.flatnonzero(np.repeat(size <= STEPS, size))
    for d in range(1, int(size[size <= STEPS].max(initial=0))):
        a, b = small[:-d], small[d:]
        same = value[a] == value[b]
        a, b = a[same], b[same]
        close = np.bitwise_count(bits[a] ^ bits[b]) <= radius
        groups.join(a[close], b[close])
    for low, n in zip(at[size > STEPS], size[size > STEPS], strict=True):
        rows = np.arange(low, low + n)
        _compare(bits, rows, rows, radius, groups)
    return _stars(doc, groups)


def _sides(table: pa.Table, radius: int) -> pa.Table:
    """Links between two sides of a hot tile: rows of the lower band with each other and with those of the band above."""
    bits, doc, side, upper = (table.column(c).to_numpy() for c in ("bits", "doc", "side", "upper"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    bits = bits.view(np.uint64)
    order = np.lexsort((bits, np.bitwise_count(bits)))
    bits, doc, side, upper = bits[order], doc[order], side[order], upper[order]
    groups = _Groups(len(doc))
    take = lambda s, u: np.flatnonzero((side == s) & (upper == u))
    _compare(bits, take(i, False), take(j, False), radius, groups)
    _compare(bits, take(i, False), take(j, True), radius, groups)
    if i != j:
        _compare(bits, take(j, False), take(i, True), radius, groups)
    return _stars(doc, groups)


def _parts(bits: Column, radius: int) -> Column:
    """The parts of a fingerprint, as even in width as can be, as an array of (part, value)."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.struct(F.lit(k).alias("part"), F.shiftrightunsigned(bits, edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1).cast("int").alias("value")) for k in range(radius + 1)))


def links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between documents of stored classes (doc, bits) that join all fingerprints within the radius."""
    if not 2 <= radius <= 16:
        raise ValueError("parts of 4 to 21 bits are made: the radius is 2 to 16")
    dealt = classes.select("doc", "bits", F.explode(_parts(F.col("bits"), radius)).alias("p")).select("doc", "bits", "p.part", "p.value")
    # Of a part's values there are 2 ** 22 at most, and only those of hot tiles are kept: N * (radius + 1) / SIDE.
    hot = cut(dealt.groupBy("part", "value").count().where(F.col("count") > SIDE).withColumn("sides", F.ceil(F.col("count") / SIDE).cast("int")).drop("count"), "hot-tiles")
    shape = "a long, b long"
    total = classes.count()
    width = -(-64 // (radius + 1))
    shift = max(0, width - max(0, (total // BUNDLE).bit_length() + 4))
    if hot.limit(1).count() == 0:
        cold, pairs = dealt, None
    else:
        cold = dealt.join(hot, ["part", "value"], "left_anti")
        rows = dealt.join(hot, ["part", "value"]).withColumns({"side": F.pmod(F.xxhash64("bits"), F.col("sides")).cast("int"), "band": F.floor(F.bit_count("bits") / (radius + 1)).cast("int")})
        each = F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda k: F.struct(F.least(k, "side").alias("i"), F.greatest(k, "side").alias("j")))
        wide = rows.withColumn("pair", F.explode(each)).withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True))))
        placed = wide.select("part", "value", (F.col("band") - F.col("upper").cast("int")).alias("band"), "pair.i", "pair.j", "side", "upper", "bits", "doc")
        pairs = placed.groupBy("part", "value", "band", "i", "j").applyInArrow(lambda t: _sides(t, radius), shape)
    found = cold.withColumn("bundle", F.shiftright("value", shift)).groupBy("part", "bundle").applyInArrow(lambda t: _bundle(t, radius), shape)
    return found if pairs is None else found.union(pairs)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits long, component_id) of every row; component: the smallest id reachable by links, itself included."""
    base = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    known = base.where("doc IS NOT NULL")
    classes = cut(known.groupBy("bits").agg(F.min("doc").alias("doc")).select("doc", "bits"), "classes")
    near = links(classes, radius)
    # A repeated id ties the classes of its texts.
    several = known.groupBy("doc").agg(F.min("bits").alias("low"), F.max("bits").alias("high")).where("low < high").select(F.col("doc").alias("own"))
    tied = known.join(several, F.col("doc") == F.col("own"), "left_semi").join(classes.select("bits", F.col("doc").alias("b")), "bits").select(F.col("doc").alias("a"), "b")
    groups = components(near.union(tied).distinct())
    release(docs.sparkSession)
    of_class = classes.join(groups, F.col("doc") == F.col("node"), "left").select(F.col("bits").alias("own"), F.coalesce("component", "doc").alias("component"))
    out = base.join(of_class, F.col("bits") == F.col("own"), "left")
    return out.select(F.col("doc").alias(id_col), "bits", F.when(F.col("doc").isNotNull(), F.col("component")).alias("component_id"))


def hexadecimal(bits: Column) -> Column:
    """16 lowercase digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
