"""Token ids as binary shards in training order.

Documents are dealt into sorted ranges of (id, hash of the text, a number that splits a hot id), as many as the bytes
of the texts ask for, and encoded in that order: the number of a sequence is the total of the ranges before plus its
place in its own. A keyed Feistel permutation over the next power of four, walked until it lands below the number of sequences,
gives every sequence its slot: a shuffle of any size that needs no shuffle table and can be computed for any slot.
Range partitions of the slots, one for each shard, assemble records with one fixed stride (compressed, and stored, so
that what came before can go), and then write the shards, which are read in order by seeking, from any slot on.

A record holds its number of ids and `length` ids, all little-endian unsigned integers of `width` bytes; the last
record of a document is filled up with `fill`. Shards are written through pyarrow's file systems (local and shared
paths, hdfs://, s3://, gs://), each beside its place and moved when complete. A shard that is there with the same bytes
is kept, so a second run with the same input, key and folder goes on where the first one ended, and one with another
input or key leaves no stale record and no shard beyond its own. manifest.json, written last, has what a reader needs, and a fingerprint of the
input and key. write_shards() writes; its result is a stored table that later actions only read.

Defined cases: null and empty texts have no sequence; very long texts have as many as they need; repeated rows, and
rows without an id, have sequences of their own; an empty table writes a manifest and no shard; more ids than `width`
can hold, and longer records than it can count, are refused; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm import ranges
from fieldloom.llm.sentencepiece_codec import Codec
from fieldloom.llm.store import cut, drop, qualified, release, shared_dir

ROUNDS = 4
CHUNKS = "block int, first long, doc_ids array<long>, n_tokens binary, ids binary"
#: Bytes of text that a range is sized for, as long as there are no more than RANGES: a number for each of them is held
#: by the driver and sent to the tasks. Ranges are read as a stream, so their size takes no memory.
RANGE_BYTES, RANGES = 24 << 20, 100_000
#: Bytes of chunks that are remembered while a range is encoded, about those of one range; bytes of text encoded at once.
CACHE_BYTES, SLICE_BYTES = 64 << 20, 4 << 20
#: Partitions that shards are assembled in at most; beyond it a partition writes several, one after the other.
PARTS = 20_000
PACKS = "shard int, slots binary, doc_ids array<long>, seqs binary, n_tokens binary, records binary"
PLACES = "doc_id long, seq int, slot long, shard int, byte_offset long, n_tokens int, record_crc32 long"


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of range(n) that the key chooses, applied to the numbers in index."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = bw.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    out = index.astype(np.uint64, copy=True)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> shift, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (bw.mix(right + k) & mask)
        out[walk] = (left << shift) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


@bw.tidied
def _encoded(batches: Iterator[pa.RecordBatch], model: bytes, length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Columns: doc_id, text, in the order of a range. A row for each slice of documents; first: the number of its first
    sequence within the range."""
    codec = Codec(model, CACHE_BYTES)
    if len(codec.surface) > 1 << (8 * width):
        raise ValueError(f"{len(codec.surface)} ids do not fit {width} bytes")
    block, done = TaskContext.get().partitionId(), 0
    blob = lambda x, kind: pa.array([np.ascontiguousarray(x, dtype=kind).tobytes()], pa.binary())
    for batch in batches:
        for low, high, _, _ in bw.text_slices(batch.column(1), SLICE_BYTES):
            ids, _, _, cuts = codec.encode_many(batch.column(1).slice(low, high - low).to_pylist(), spans=False)
            tokens = np.diff(cuts)
            docs = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), batch.column(0).slice(low, high - low))
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([done], pa.int64()), docs, blob(tokens, np.int32), blob(ids, f"<u{width}")], names=["block", "first", "doc_ids", "n_tokens", "ids"])
            done += int((-(-tokens // length)).sum())


def _pack(shard: int, slots: np.ndarray, docs: pa.Array, seqs: np.ndarray, tokens: np.ndarray, records: np.ndarray) -> list:
    blob = lambda x: np.ascontiguousarray(x).tobytes()
    return [shard, blob(slots.astype(np.int64)), docs, blob(seqs.astype(np.int32)), blob(tokens.astype(np.int32)), pa.compress(blob(records), codec="zstd", asbytes=True)]


def _packs(rows: list[list]) -> pa.RecordBatch:
    docs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]), pa.int32()), pa.concat_arrays([r[2] for r in rows]))
    cols = [pa.array([r[0] for r in rows], pa.int32()), *(docs if k == 2 else pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))]
    return pa.record_batch(cols, names=["shard", "slots", "doc_ids", "seqs", "n_tokens", "records"])


@bw.tidied
def _slots(batches: Iterator[pa.RecordBatch], before: dict[int, int], total: int, key: int, length: int, width: int, fill: int, per_shard: int) -> Iterator[pa.RecordBatch]:
    """Records of a slice of documents, packed by shard."""
    kind = np.dtype(f"<u{width}")
    for batch in batches:
        for block, first, docs, tokens, ids in zip(*batch.columns, strict=True):
            tokens, ids = np.frombuffer(tokens.as_buffer(), dtype=np.int32).astype(np.int64), np.frombuffer(ids.as_buffer(), dtype=kind)
            n = -(-tokens // length)
            if not n.sum():
                continue
            row = np.repeat(np.arange(len(n)), n)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            slot = feistel(before[block.as_py()] + first.as_py() + np.arange(len(row)), total, key)
            held = np.minimum(length, tokens[row] - seq * length)
            records = np.full((len(row), length + 1), fill, dtype=kind)
            records[:, 0] = held
            records[:, 1:][np.arange(length) < held[:, None]] = ids
            order = np.argsort(slot, kind="stable")
            shards = slot[order] // per_shard
            own = docs.values.take(pa.array(row[order]))
            cuts = np.append(np.flatnonzero(bw.heads(shards)), len(shards))
            yield _packs([_pack(int(shards[i]), slot[order[i:j]], own.slice(i, j - i), seq[order[i:j]], held[order[i:j]], records[order[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])


def _ends(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Columns: block, first, n_tokens. The number after the last sequence of each slice."""
    for batch in batches:
        sizes = [int((-(-np.frombuffer(x.as_buffer(), dtype=np.int32) // length)).sum()) for x in batch.column(2)]
        yield pa.record_batch([batch.column(0), pa.array(batch.column(1).to_numpy() + np.array(sizes, dtype=np.int64))], names=["block", "end"])


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


SHARD = re.compile(r"shard-\d{6,}\.bin")


def _placed(spark: SparkSession | None, folder: str) -> str:
    """A path without a scheme lies where Spark looks for it."""
    return folder if "://" in folder or folder.startswith("file:") or spark is None else qualified(spark, folder)


def _file_system(folder: str):
    """pyarrow's file system and the path in it; ValueError for a scheme that it doesn't know."""
    folder = _placed(SparkSession.getActiveSession(), folder)
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"shards can't be written to {folder}: {e}") from e


def _stored(where, path: str, data: bytes) -> None:
    """Write data unless the path holds the same bytes."""
    info = where.get_file_info(path)
    if info.is_file and info.size == len(data):
        with where.open_input_stream(path) as f:
            if zlib.crc32(f.read()) == zlib.crc32(data):
                return
    temp = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(temp) as f:
        f.write(data)
    where.move(temp, path)


@bw.tidied
def _assembled(batches: Iterator[pa.RecordBatch], per_shard: int, total: int, length: int, width: int) -> Iterator[pa.RecordBatch]:
    """One row for each shard, in the order of its slots; its packs come in one partition, one after the other."""
    shard, filled = None, 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names) if name != "doc_ids"}
            own = batch.column(2)[i].values
            if row["shard"] != shard:
                if filled:
                    raise ValueError(f"shard {shard} is not complete")
                shard = row["shard"]
                size = min(per_shard, total - shard * per_shard)
                docs, known, seqs, held, records = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros((size, length + 1), f"<u{width}")
            at = np.frombuffer(row["slots"], dtype=np.int64) - shard * per_shard
            docs[at], known[at] = own.fill_null(0).to_numpy(), np.asarray(own.is_valid())
            seqs[at], held[at] = np.frombuffer(row["seqs"], dtype=np.int32), np.frombuffer(row["n_tokens"], dtype=np.int32)
            records[at] = _records(row, len(at), length, width)
            filled += len(at)
            if filled == size:
                yield _packs([_pack(shard, np.arange(size) + shard * per_shard, pa.array(docs, mask=~known), seqs, held, records)])
                filled = 0
    if filled:
        raise ValueError(f"shard {shard} is not complete")


def _records(row: dict, n: int, length: int, width: int) -> np.ndarray:
    data = pa.decompress(row["records"], decompressed_size=n * (length + 1) * width, codec="zstd", asbytes=True)
    return np.frombuffer(data, dtype=f"<u{width}").reshape(-1, length + 1)


@bw.tidied
def _written(batches: Iterator[pa.RecordBatch], folder: str, per_shard: int, length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Write each shard; a row for each of its sequences."""
    where, base = _file_system(folder)
    stride = (length + 1) * width
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names) if name != "doc_ids"}
            slots = np.frombuffer(row["slots"], dtype=np.int64)
            data = _records(row, len(slots), length, width).tobytes()
            _stored(where, f"{base}/{shard_name(row['shard'])}", data)
            crcs = [zlib.crc32(data[k * stride : (k + 1) * stride]) for k in range(len(slots))]
            yield pa.record_batch(
                [batch.column(2)[i].values, pa.array(np.frombuffer(row["seqs"], np.int32)), pa.array(slots), pa.array(np.full(len(slots), row["shard"], np.int32)), pa.array(slots % per_shard * stride), pa.array(np.frombuffer(row["n_tokens"], np.int32)), pa.array(crcs, pa.int64())],
                names=["doc_id", "seq", "slot", "shard", "byte_offset", "n_tokens", "record_crc32"],
            )


def write_shards(docs: DataFrame, model: str, folder: str | None = None, key: int = 1, length: int = 256, width: int = 2, fill: int = 0, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; a row for each sequence: where it is and the CRC of its record.

    folder: one that the driver and all executors share, by default a new one in the shared folder of the session.
    """
    spark = docs.sparkSession
    if length >= 1 << (8 * width):
        raise ValueError(f"{length} ids can't be counted in {width} bytes")
    folder = _placed(spark, folder or f"{shared_dir(spark)}/fieldloom-shards-{uuid.uuid4().hex}").rstrip("/")
    where, base = _file_system(folder)
    where.create_dir(base, recursive=True)
    if where.get_file_info(f"{base}/manifest.json").is_file:  # no reader takes a folder that is being written for whole
        where.delete_file(f"{base}/manifest.json")
    with open(model, "rb") as f:
        blob = f.read()
    apart = F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), apart.alias("apart"), F.col(text_col).alias("text"))
    one = slim.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.sum(F.xxhash64("doc_id", "hash").cast("decimal(38,0)")).alias("mark")).first()
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("apart").asc()]
    dealt = slim.repartitionByRange(min(RANGES, max(ranges.LEAST, (one["size"] or 0) // RANGE_BYTES)), *order).sortWithinPartitions(*order)
    encoded = cut(dealt.select("doc_id", "text").mapInArrow(lambda it: _encoded(it, blob, length, width), CHUNKS), "ids", "zstd")
    release(spark)
    # The total of each range is the end of its last slice: a row for each range on the driver and with the tasks.
    ends = encoded.select("block", "first", "n_tokens").mapInArrow(lambda it: _ends(it, length), "block int, end long").groupBy("block").agg(F.max("end").alias("end")).orderBy("block").collect()
    before, total = {}, 0
    for r in ends:
        before[r.block] = total
        total += r.end
    stride = (length + 1) * width
    per_shard = max(1, shard_bytes // stride)
    shards = -(-total // per_shard)
    packs = encoded.mapInArrow(lambda it: _slots(it, before, total, key, length, width, fill, per_shard), PACKS)
    parts = max(1, min(shards, PARTS))
    dealt = packs.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard")
    whole = cut(dealt.mapInArrow(lambda it: _assembled(it, per_shard, total, length, width), PACKS), "shards", "uncompressed")
    drop(encoded)
    release(spark)
    places = cut(whole.mapInArrow(lambda it: _written(it, folder, per_shard, length, width), PLACES), "places")
    drop(whole)
    # One listing shows what is there, and what an earlier, larger run has left.
    there = {x.base_name: x.size for x in where.get_file_info(fs.FileSelector(base)) if SHARD.fullmatch(x.base_name)}
    found = sum(there.pop(shard_name(k), None) == stride * min(per_shard, total - k * per_shard) for k in range(shards))
    if found < shards:
        raise OSError(f"{shards - found} of {shards} shards are not to be seen in {folder}: it must be shared by the driver and all executors")
    for name in there:
        where.delete_file(f"{base}/{name}")
    about = {"sequences": total, "shards": shards, "per_shard": per_shard, "length": length, "width": width, "fill": fill, "stride": stride, "key": key, "documents": one["n"], "fingerprint": f"{one['mark'] or 0}", "model_crc32": zlib.crc32(blob)}
    with where.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(about, indent=1).encode())
    places._fieldloom_folder = folder
    return places


def manifest(folder: str) -> dict:
    where, base = _file_system(folder)
    with where.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def read_slots(folder: str, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of ids of n records in training order from slot first on (fewer at the end): reading goes on
    anywhere by seeking."""
    about = manifest(folder)
    where, base = _file_system(folder)
    per_shard, stride, length = about["per_shard"], about["stride"], about["length"]
    n, parts = max(0, min(n, about["sequences"] - first)), [np.zeros((0, length + 1), dtype=f"<u{about['width']}")]
    while n > 0:
        want = min(n, per_shard - first % per_shard)
        with where.open_input_file(f"{base}/{shard_name(first // per_shard)}") as f:
            f.seek(first % per_shard * stride)
            parts.append(np.frombuffer(f.read(want * stride), dtype=parts[0].dtype).reshape(-1, length + 1))
        first, n = first + want, n - want
    whole = np.concatenate(parts)
    return whole[:, 1:], whole[:, 0]
