"""Exact similarity join on word shingles: size-banded tiles, bitmap signatures, sorted-array intersection.

Two sets link when 100 * |A and B| >= percent * |A or B|. The join finds the links between different sets that decide
the components, in these steps, none of which makes all pairs of a group:

1. Every text becomes its set of hashed shingles; equal sets fall together (one class, its smallest document stands for
   it), so exact copies are never compared.
2. Quick links: classes that share a minimum hash are compared with the smallest member of that group, a star instead
   of all pairs. This joins most members of large groups of near copies.
3. A total order of the shingles puts rare ones first: three of four hashes are counted over all classes, packed in
   hash blocks. By the prefix principle two similar sets share one of their first n - ceil(n * percent / 100) + 1 shingles.
   Classes with enough shingles that nobody else has need no more work.
4. Tiles: the prefix shingles of the others are grouped by shingle and size band (a band reaches as far as sizes can
   differ), and only classes that the quick links have not joined yet meet there. Tiles of a common shingle are cut
   into blocks, so that no task gets more than two block sides, and their pairs are judged inside the task.
5. Bitmap signatures: the bits in which two parity bitmaps differ bound the overlap from above; what is left is decided
   by intersecting the sorted arrays, which are made anew from the texts of just these classes.

Shingles, sets and classes are known by 64-bit hashes.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; a null text or one without
words is empty and links with nothing; very long texts are compared whole; rows that repeat an id belong to one
component; rows with a null id link with nothing and have a null component; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.components import components
from fieldloom.llm.store import cut, drop, release
from fieldloom.llm.substring_dedup import BLOCKS, _by_doc, _doc_block, _unpack

#: Minimum hashes for the quick links; shingles a hash block is sized for and those gathered before a task emits.
STARS, BLOCK, FLUSH = 4, 1_000_000, 400_000
LOW = np.uint64((1 << 64) - 64)
#: Classes of a shingle up to which its pairs are joined in SQL; classes on a side of a block of larger tiles.
TILE, SIDE = 32, 1_000
#: Keys of a class that travel with each of its tile rows, the smallest ones: by them a pair is passed over in all tiles
#: but the first that both are in. Pairs that share only later keys are found more than once and made distinct.
KEYS = 64
#: Rows of (document, class, two flags) that are broadcast at most, some 40 bytes each.
FEW = 200_000
#: Shingles in this many of SAMPLE classes count as common: they come last in the order and are not counted exactly.
SAMPLE, COMMON = 8_000, 16
#: Common shingles that travel with the tasks at most, the commonest ones: they order the prefixes, whatever they are.
MOST = 200_000


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap that a set of n shingles can have with a similar one."""
    return -(-n * percent // 100)


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted shingles row after row, where each row's begin)."""
    for low, high, data, at in bw.text_slices(column):
        data = bw.LOWER[data]
        starts, ends, first = bw.words(data, at, bw.BLANKS)
        got, _, row = bw.window_hashes(bw.word_hashes(data, starts, ends), first, words, short=True)
        order = np.lexsort((got, row))
        got, row = got[order], row[order]
        new = bw.heads(got, row)
        got, row = got[new], row[new]
        yield low, high, got, np.searchsorted(row, np.arange(high - low + 1))


def set_hash(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set, from sums over its mixed shingles; 0 for the empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(bw.mix(sets ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(at)
    return np.where(n > 0, bw.mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)), np.uint64(0)).view(np.int64)


def width(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set with n shingles: a power of two, for neighbours in size alike or double."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) * 1.5)).astype(np.int64), 64, 4096)


def signature(own: np.ndarray, bits: int) -> bytes:
    """Parity bitmap: each shingle flips one bit."""
    flips = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """The most shingles that sets with these bitmaps can share; the wider bitmap is folded."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


CLASSES = "doc long, cls long, n int, mins array<long>, bitmap binary"


@bw.tidied
def _base(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    salts = bw.mix(np.arange(1, STARS + 1, dtype=np.uint64))
    for batch in batches:
        for low, high, sets, at in shingle_sets(batch.column(1), words):
            n = np.diff(at)
            full = np.flatnonzero(n)
            mins = np.zeros((high - low, STARS), dtype=np.uint64)
            for k, salt in enumerate(salts):
                if len(full):
                    mins[full, k] = np.minimum.reduceat(bw.mix(sets ^ salt), at[full])
            bits = width(n)
            maps = [signature(sets[at[i] : at[i + 1]], int(bits[i])) for i in range(high - low)]
            yield pa.record_batch(
                [batch.column(0).slice(low, high - low), pa.array(set_hash(sets, at)), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * STARS, pa.int32()), pa.array(mins.reshape(-1).view(np.int64))), pa.array(maps, pa.binary())],
                names=["doc", "cls", "n", "mins", "bitmap"],
            )


def _counted(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Three of four shingles, without the common ones."""
    out = (bw.mix(keys) >> np.uint64(62)) != 3
    return out & ~np.isin(keys, common) if len(common) else out


@bw.tidied
def _pack(batches: Iterator[pa.RecordBatch], words: int, common: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """The shingles to count, by hash block, each class once for a flush."""
    keys, owners, held, seen = [], [], 0, set()

    def flush() -> pa.RecordBatch | None:
        k, o = np.concatenate(keys), np.concatenate(owners)
        return _by_doc((k % np.uint64(blocks)).astype(np.int64), o, k, False)

    for batch in batches:
        for _, _, sets, at in shingle_sets(batch.column(1), words):
            cls = set_hash(sets, at)
            fresh = np.array([c != 0 and c not in seen and not seen.add(c) for c in cls.tolist()], dtype=bool)
            owner = np.repeat(cls, np.diff(at))
            take = np.repeat(fresh, np.diff(at)) & _counted(sets, common)
            keys.append(sets[take])
            owners.append(owner[take])
            held += int(take.sum())
            if held >= FLUSH:
                yield flush()
                keys, owners, held, seen = [], [], 0, set()
    if held:
        yield flush()


def _shared(table: pa.Table, blocks: int) -> pa.Table:
    """Of a hash block: the shingles that two classes or more have, packed by blocks of classes. The last six bits of a
    shingle give way to the logarithm of its number of classes, in quarters."""
    cls, keys = _unpack(table)
    order = np.lexsort((cls, keys))
    cls, keys = cls[order], keys[order]
    one = bw.heads(keys, cls)
    cls, keys = cls[one], keys[one]
    at = np.flatnonzero(bw.heads(keys))
    size = np.diff(np.append(at, len(keys)))
    often = np.repeat(size, size)
    more = often > 1
    cls, keys, often = cls[more], keys[more], often[more]
    if not len(cls):
        return table.schema.empty_table()
    part = _doc_block(cls, blocks)
    order = np.lexsort((cls, part))
    cls, keys, often, part = cls[order], keys[order], often[order], part[order]
    at = np.flatnonzero(bw.heads(part, cls))
    own = np.flatnonzero(bw.heads(part))
    by_run = np.append(np.searchsorted(at, own), len(at))
    level = np.minimum(63, 4 * np.log2(often)).astype(np.uint64)
    return pa.table([pa.array(part[own].astype(np.int32)), pa.array(np.full(len(own), True)), bw.binary_rows(cls[at], by_run), bw.binary_rows(np.diff(np.append(at, len(cls))).astype(np.int32), by_run), bw.binary_rows(keys & LOW | level, np.append(own, len(cls)))], schema=table.schema)


def _gather_shared(table: pa.Table) -> pa.Table:
    """One row for each class of a block of classes."""
    cls, keys = _unpack(table)
    order = np.lexsort((keys, cls))
    cls, keys = cls[order], keys[order]
    own = np.flatnonzero(bw.heads(cls))
    return pa.table([pa.array(cls[own]), bw.binary_rows(keys, np.append(own, len(cls)))], names=["cls", "shared"])


def prefix(own: np.ndarray, shared: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set's prefix that another class can have too.

    The order: counted ones by number of classes, then the others, then common ones; equal ones by hash.
    """
    n = len(own)
    rank = np.where(_counted(own, common[:0]), np.uint64(1), np.uint64(1 << 62))
    if len(shared):
        near = np.searchsorted(shared & LOW, own & LOW)
        near[near == len(shared)] = 0
        known = (shared[near] & LOW) == (own & LOW)
        rank = np.where(known, (shared[near] & ~LOW) + np.uint64(2), rank)
    if len(common):
        rank = np.where(np.isin(own, common), np.uint64(1 << 63), rank)
    first = np.lexsort((own, rank))[: n - int(need(np.array(n), percent)) + 1]
    return own[first][rank[first] > 1]


@bw.tidied
def _prefixes(batches: Iterator[pa.RecordBatch], words: int, common: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Columns: text, cls, n, label, shared."""
    for batch in batches:
        for low, high, sets, at in shingle_sets(batch.column(0), words):
            lists, rows = [], []
            own = set_hash(sets, at) == batch.column(1).slice(low, high - low).to_numpy()
            # A prefix that is full of shingles which no other class has makes no key.
            sums = np.concatenate([[0], np.cumsum(_counted(sets, common))])
            n = np.diff(at)
            alone = sums[at[1:]] - sums[at[:-1]] - pc.fill_null(pc.binary_length(batch.column(4).slice(low, high - low)), 0).to_numpy(zero_copy_only=False) // 8
            for i in np.flatnonzero(own & (alone < n - need(n, percent) + 1)):
                blob = batch.column(4)[low + int(i)].as_buffer() if batch.column(4)[low + int(i)].is_valid else b""
                lists.append(prefix(sets[at[i] : at[i + 1]], np.frombuffer(blob, dtype=np.uint64), common, percent))
                rows += [low + int(i)] * len(lists[-1])
            take = pa.array(rows, pa.int64())
            keys = np.concatenate(lists) if lists else np.zeros(0, dtype=np.uint64)
            yield pa.record_batch([pa.array(keys.view(np.int64)), *(batch.column(k).take(take) for k in (1, 2, 3))], names=["key", "cls", "n", "label"])


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow enough overlap. Columns: a, b, na, nb, map_a, map_b."""
    for batch in batches:
        na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        ok = [overlap_bound(x, y, p, q) * (100 + percent) >= percent * (p + q) for x, y, p, q in zip(left, right, na, nb, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _maps(column: pa.ChunkedArray, bits: int) -> np.ndarray:
    """Bitmaps folded to a common width, as rows of 64-bit words."""
    out = np.zeros((len(column), bits // 64), dtype=np.uint64)
    for k, v in enumerate(column.to_pylist()):
        words = np.frombuffer(v, dtype=np.uint64)
        out[k] = np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)
    return out


def _tile(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of one block of a tile whose bitmaps allow enough overlap."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    key = table.column("key")[0].as_py()
    left = np.asarray(table.column("left"))
    if not left.any() or left.all():
        return none
    bits = 8 * min(pc.min(pc.binary_length(table.column("bitmap"))).as_py(), 512)
    maps, n, label, cls = _maps(table.column("bitmap"), bits), *(table.column(c).to_numpy().astype(np.int64) for c in ("n", "label", "cls"))
    lists = table.column("keys").combine_chunks()
    keys, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    found: list[tuple[int, int]] = []
    for low in range(0, len(x), 64):
        part = x[low : low + 64]
        na, nb = n[part][:, None], n[y][None, :]
        ok = (label[part][:, None] != label[y][None, :]) & ((na < nb) | ((na == nb) & (cls[part][:, None] < cls[y][None, :]))) & (100 * na >= percent * nb)
        p, q = np.nonzero(ok)
        p, q = part[p], y[q]
        for at in range(0, len(p), 50_000):
            i, j = p[at : at + 50_000], q[at : at + 50_000]
            apart = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)
            close = (n[i] + n[j] - apart) // 2 * (100 + percent) >= percent * (n[i] + n[j])
            for u, v in zip(i[close], j[close], strict=True):
                both = np.intersect1d(keys[cuts[u] : cuts[u + 1]], keys[cuts[v] : cuts[v + 1]], assume_unique=True)
                if both[0] == key:
                    found.append((int(cls[u]), int(cls[v])))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


@bw.tidied
def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Columns: cls, text, left, right. A row whose document repeats the id with another text is passed over."""
    for batch in batches:
        for low, high, sets, at in shingle_sets(batch.column(1), words):
            own = pa.array(set_hash(sets, at) == batch.column(0).slice(low, high - low).to_numpy())
            cols = [batch.column(i).slice(low, high - low) for i in (0, 2, 3)]
            yield pa.record_batch([*cols, bw.binary_rows(sets, at)], names=["cls", "left", "right", "shingles"]).filter(own)


@bw.tidied
def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that link. Columns: a, b, sets of both."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            near = np.searchsorted(q, p)
            near[near == len(q)] = 0
            both = int((q[near] == p).sum())
            ok.append(100 * both >= percent * (len(p) + len(q) - both))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


class Join:
    """The join over one table; every step is stored in the shared folder."""

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        self.base = cut(self.docs.mapInArrow(lambda it: _base(it, words), CLASSES), "sets")
        one = F.min(F.struct("doc", "mins", "bitmap")).alias("one")
        self.classes = cut(self.base.where("n > 0 AND doc IS NOT NULL").groupBy("cls", "n").agg(one).select("cls", "n", "one.*"), "classes")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b), pairs of classes: those that link, by bitmaps and then by their sorted arrays."""
        percent, words = self.percent, self.words
        side = lambda c: self.classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"map_{c}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", "map_a", "map_b")
        near = cut(near.mapInArrow(lambda it: _close(it, percent), "a long, b long"), "near")
        ids = near.select(F.col("a").alias("cls"), F.lit(1).alias("left"), F.lit(0).alias("right")).union(near.select(F.col("b").alias("cls"), F.lit(0), F.lit(1))).groupBy("cls").agg(F.max("left").alias("left"), F.max("right").alias("right"))
        wanted = cut(self.classes.select("doc", "cls").join(ids, "cls"), "wanted")
        # Few classes go to the texts; beyond the bound the texts are dealt by their ids.
        small = wanted.limit(FEW + 1).count() <= FEW
        texts = self.docs.join(F.broadcast(wanted) if small else wanted, "doc").select("cls", "text", "left", "right")
        sets = cut(texts.mapInArrow(lambda it: _sets(it, words), "cls long, left int, right int, shingles binary"), "arrays")
        release(self.spark)
        both = near.join(sets.where("left = 1").select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.where("right = 1").select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
        found = cut(both.select("a", "b", "set_a", "set_b").mapInArrow(lambda it: _linked(it, percent), "a long, b long").distinct(), "linked")
        drop(near, sets, wanted)
        release(self.spark)
        return found

    def stars(self) -> DataFrame:
        """Pairs of the classes that share a minimum hash: each with the smallest of them."""
        keyed = self.classes.select("cls", "doc", F.posexplode("mins").alias("k", "h"))
        centre = keyed.groupBy("k", "h").agg(F.min(F.struct("doc", "cls")).alias("c"), F.count("*").alias("size")).where("size > 1").select("k", "h", F.col("c.cls").alias("a"))
        return keyed.join(centre, ["k", "h"]).where("a <> cls").select("a", F.col("cls").alias("b")).distinct()

    def labels(self, links: DataFrame) -> DataFrame:
        """(cls, label): equal labels are known to be in one component."""
        least = links.groupBy(F.col("b").alias("cls")).agg(F.min("a").alias("up"))
        first = cut(self.classes.select("cls").join(least, "cls", "left").select("cls", F.coalesce("up", "cls").alias("up")), "labels")
        for _ in range(2):
            above = first.select(F.col("cls").alias("up"), F.col("up").alias("top"))
            again = cut(first.join(above, "up").select("cls", F.col("top").alias("up")), "labels")
            drop(first)
            first = again
        return first.withColumnRenamed("up", "label")

    def common(self) -> np.ndarray:
        """Hashes of the shingles that are common among a sample of classes of fixed size."""
        words = self.words
        last = self.classes.select("cls").orderBy("cls").limit(SAMPLE).agg(F.max("cls")).first()[0]
        if last is None:
            return np.zeros(0, dtype=np.uint64)
        sample = self.classes.where(F.col("cls") <= last).select("doc", "cls").limit(SAMPLE)
        some = self.docs.join(F.broadcast(sample), "doc").select("cls", "text")
        keys = some.mapInArrow(lambda it: _flat(it, words), "key long").groupBy("key").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST).select("key")
        return np.sort(keys.toPandas()["key"].to_numpy(dtype=np.int64).view(np.uint64))

    def candidates(self, labels: DataFrame) -> DataFrame:
        """Pairs of classes with different labels that share a prefix shingle and whose sizes can link."""
        words, percent, common = self.words, self.percent, self.common()
        total = self.classes.agg(F.sum("n")).first()[0] or 0
        blocks = max(8, total * 3 // 4 // BLOCK + 1)
        packed = self.docs.mapInArrow(lambda it: _pack(it, words, common, blocks), BLOCKS)
        answers = cut(packed.groupBy("block").applyInArrow(lambda t: _shared(t, blocks), BLOCKS), "shared")
        release(self.spark)
        shared = answers.groupBy("block").applyInArrow(_gather_shared, "cls long, shared binary")
        # Enough shingles that no other class has, and nothing of the prefix can be shared.
        ready = self.classes.select("cls", "n", "doc").join(labels, "cls").join(shared, "cls", "left")
        rows = self.docs.join(ready, "doc").select("text", "cls", "n", "label", "shared")
        keys = cut(rows.mapInArrow(lambda it: _prefixes(it, words, common, percent), "key long, cls long, n int, label long"), "prefixes")
        drop(answers)
        release(self.spark)
        mixed = keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
        step = float(np.log(100 / percent))
        tiles = cut(keys.join(mixed, "key").withColumn("band", F.floor(F.log("n") / step).cast("int")), "tiles")
        pairs = self._small(tiles.where(F.col("size") <= TILE)).union(self._large(tiles.where(F.col("size") > TILE)))
        self._keys = (keys, tiles)
        return pairs.distinct()

    def _small(self, tiles: DataFrame) -> DataFrame:
        """Pairs of tiles with so few rows that they are simply joined."""
        wide = tiles.withColumn("tile", F.explode(F.array("band", F.col("band") + 1)))
        a = wide.select("key", F.col("tile").alias("at"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
        b = tiles.select("key", F.col("band").alias("at"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
        return a.join(b, ["key", "at"]).where(f"la <> lb AND (na < nb OR (na = nb AND a < b)) AND 100 * na >= {self.percent} * nb").select("a", "b")

    def _large(self, tiles: DataFrame) -> DataFrame:
        """Pairs of larger tiles, cut into blocks: bitmaps are compared inside a task, and only pairs whose bitmaps allow
        enough overlap leave it, as a rule from the first shingle that both share here."""
        percent = self.percent
        own = tiles.groupBy("cls").agg(F.slice(F.sort_array(F.collect_set("key")), 1, KEYS).alias("keys"))
        rows = tiles.join(own, "cls").join(self.classes.select("cls", "bitmap"), "cls")
        blocks = (F.col("size") / SIDE).cast("int") + 1
        placed = rows.withColumn("parts", F.sequence(F.lit(0), blocks - 1)).withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
        left = placed.withColumn("at", F.explode(F.array("band", F.col("band") + 1))).withColumn("j", F.explode("parts")).select("key", "at", F.col("own").alias("i"), "j", F.lit(True).alias("left"), "cls", "n", "label", "bitmap", "keys")
        right = placed.withColumn("i", F.explode("parts")).select("key", F.col("band").alias("at"), "i", F.col("own").alias("j"), F.lit(False).alias("left"), "cls", "n", "label", "bitmap", "keys")
        return left.union(right).groupBy("key", "at", "i", "j").applyInArrow(lambda t: _tile(t, percent), "a long, b long")

    def run(self) -> DataFrame:
        """(doc, cls, n, component) of every row; component: smallest document linked with it, itself included."""
        quick = self.verify(self.stars())
        labels = self.labels(quick)
        rest = self.verify(self.candidates(labels))
        drop(*self._keys)
        doc = self.classes.select("cls", "doc")
        # A repeated id ties the classes of its texts.
        held = self.base.where("n > 0 AND doc IS NOT NULL").select("doc", "cls").distinct()
        several = held.groupBy("doc").agg(F.min("cls").alias("a"), F.count("*").alias("texts")).where("texts > 1").select("doc", "a")
        links = quick.union(rest).union(held.join(several, "doc").where("a <> cls").select("a", F.col("cls").alias("b")))
        named = links.join(doc.withColumnsRenamed({"cls": "a", "doc": "x"}), "a").join(doc.withColumnsRenamed({"cls": "b", "doc": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        groups = components(named)
        of_class = doc.join(groups, doc["doc"] == groups["node"], "left").select("cls", F.coalesce("component", "doc").alias("component"))
        return self.base.join(of_class, "cls", "left").select("doc", "cls", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def _flat(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, sets, _ in shingle_sets(batch.column(1), words):
            yield pa.record_batch([pa.array(sets.view(np.int64))], names=["key"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    out = Join(docs, words, percent, id_col, text_col).run()
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
