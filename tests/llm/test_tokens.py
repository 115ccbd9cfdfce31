"""op1, op5, op8 and op9 against brute force."""

import hashlib
import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fieldloom.llm import sharding, token_counts, token_shards
from fieldloom.llm.sentencepiece_codec import CharMap, Codec, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = ["", " ", "  a", "a  b ", None, "\n\n x\t y", "▁", "a▁b ▁ c▁▁", "日本語 é̂", "🙂🙃 ok", "<s> </s> <0x41>", "x" * 3000, " " * 300, "ab " * 20000, "The cat.\nThe cat."]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(ODD)] + [(3, ODD[3], None, None)], "doc_id long, text string, ids string, n_tokens int")


def test_ids_and_text_equal_the_library(odd):
    rows = encode(odd.select("doc_id", "text"), MODEL).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        ids = LIBRARY.encode(r.text or "")
        assert r.ids == ids and r.decoded == LIBRARY.decode(ids)
        raw = (r.text or "").encode()
        assert r.starts == [0, *r.ends[:-1]][: len(ids)] and (not ids or r.ends[-1] == len(raw))


def test_own_merges_equal_the_library():
    codec = Codec(open(MODEL, "rb").read())
    for t in ODD:
        if t:
            ids, starts, ends = codec.encode(t)
            assert ids == LIBRARY.encode(t) and codec.decode(ids) == LIBRARY.decode(ids)
            assert ends[-1] == len(t.encode())


def test_ids_without_spans_and_with_a_small_cache():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    texts = ["a few  words", None, "", " ▁ blank sign", "ÄÖ 漢字 and \U0001f600"]
    whole, small = Codec(model), Codec(model, 1)
    ids, starts, ends, cuts = whole.encode_many(texts)
    for codec in (whole, small, small):
        own, no_starts, no_ends, own_cuts = codec.encode_many(texts, spans=False)
        assert own.tolist() == ids.tolist() and own_cuts.tolist() == cuts.tolist() and len(no_starts) == len(no_ends) == 0
    assert len(starts) == len(ends) == len(ids) > 0


def test_decode_of_broken_bytes():
    codec = Codec(open(MODEL, "rb").read())
    for ids in ([codec.bytes[0xE2], codec.bytes[0x82]], [codec.bytes[0xFF], *LIBRARY.encode("a")], [1, *LIBRARY.encode("ab"), 2], []):
        assert codec.decode(ids) == LIBRARY.decode(ids)


def test_clashing_columns_and_decode(odd):
    out = encode(odd, MODEL)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "starts", "ends", "decoded"]
    again = decode(out, MODEL).collect()
    assert all(r.decoded == LIBRARY.decode(LIBRARY.encode(r.text or "")) for r in again)


def _trie(keys):
    """A double array built naively: one node after the other, at the first offset that is free."""
    pool, values = b"", {}
    for k, v in keys.items():
        values[k.encode()] = len(pool)
        pool += v.encode() + b"\0"
    units, used = {0: 0}, {0}

    def place(node, prefix):
        kids = sorted({k[len(prefix)] for k in values if len(k) > len(prefix) and k.startswith(prefix)})
        leaf = prefix in values
        base = 1
        while any((node ^ base ^ c) in used for c in [*kids, *([0] if leaf else [])]):
            base += 1
        units[node] = units[node] | base << 10 | (0x100 if leaf else 0)
        if leaf:
            used.add(node ^ base)
            units[node ^ base] = 0x80000000 | values[prefix]
        for c in kids:
            used.add(node ^ base ^ c)
            units[node ^ base ^ c] = c
        for c in kids:
            place(node ^ base ^ c, prefix + bytes([c]))

    place(0, b"")
    array = [units.get(i, 0) for i in range(max(units) + 257)]
    return struct.pack(f"<I{len(array)}I", 4 * len(array), *array) + pool


def test_longest_prefix_and_alignment():
    codec = Codec(open(MODEL, "rb").read())
    codec.map = CharMap(_trie({"ﬁ": "fi", "a": "A", "ab": "X", "é": "", "　": " "}))
    codec.plain = False
    norm, at = codec.normalise("abaﬁ é　c")
    assert norm == "▁XAfi▁▁c"
    assert at == [0, 0, 2, 3, 3, 6, 9, 12, 13]
    ids, starts, ends = codec.encode("abaﬁ é　c")
    assert ids == LIBRARY.encode("XAfi  c") and ends[-1] == 13 and starts == [0, *ends[:-1]]
    codec.squeeze = True
    assert codec.normalise("  c  a ")[0] == "▁c▁A"


def test_shards_by_bytes(spark, odd):
    rows = sharding.shard_by_bytes(odd.select("doc_id", "text"), shards=4).orderBy("position").collect()
    assert sorted(r.doc_id for r in rows) == sorted([*range(len(ODD)), 3])
    total, done = sum(r.size for r in rows), 0
    slots = {}
    for i, r in enumerate(rows):
        raw = (ODD[r.doc_id] or "").encode()
        assert r.position == i and r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert r.shard == done * 4 // total and r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        done += r.size
    assert sharding.shard_by_bytes(odd.where("doc_id < 0")).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 256, 1000, 4097):
        got = token_shards.feistel(np.arange(n), n, 5)
        assert sorted(got) == list(range(n))
    assert (token_shards.feistel(np.arange(1000), 1000, 5) != token_shards.feistel(np.arange(1000), 1000, 6)).any()


def test_shards_hold_every_sequence_and_resume(spark, odd, tmp_path):
    folder = str(tmp_path / "out")
    made = token_shards.write_shards(odd, MODEL, folder=folder, length=16, shard_bytes=680)
    rows = made.collect()
    want = []
    for i, t in [*enumerate(ODD), (3, ODD[3])]:
        ids = LIBRARY.encode(t or "")
        want += [(i, k // 16, ids[k : k + 16]) for k in range(0, len(ids), 16)]
    assert sorted(r.slot for r in rows) == list(range(len(want)))
    read, held = token_shards.read_slots(folder, 0, len(rows) + 9)
    assert len(read) == len(rows) and token_shards.manifest(folder)["per_shard"] == 20
    assert sorted((r.doc_id, r.seq, read[r.slot][: held[r.slot]].tolist()) for r in rows) == sorted(want)
    assert all(held[r.slot] == r.n_tokens and r.byte_offset == r.slot % 20 * 34 for r in rows)
    record = lambda r: np.concatenate([held[r.slot : r.slot + 1], read[r.slot]]).tobytes()
    assert all(zlib.crc32(record(r)) == r.record_crc32 for r in rows)
    assert (token_shards.read_slots(folder, 33, 50)[0] == read[33:83]).all()
    stamp = lambda: {f: os.stat(os.path.join(folder, f)).st_mtime_ns for f in os.listdir(folder) if f != "manifest.json"}
    before = stamp()
    os.remove(os.path.join(folder, token_shards.shard_name(1)))
    token_shards.write_shards(odd, MODEL, folder=folder, length=16, shard_bytes=680)
    again = stamp()
    assert again.keys() == before.keys() and sum(again[f] != before[f] for f in before) == 1
    assert (token_shards.read_slots(folder, 0, len(rows))[0] == read).all()
    # Fewer sequences: the shards of the larger run go, and a partition may write several.
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_shards, "PARTS", 2)
        few = token_shards.write_shards(odd.where("doc_id IS NOT NULL").limit(3), MODEL, folder=f"file:{folder}", length=16, shard_bytes=100)
    names = sorted(x for x in os.listdir(folder) if x.endswith(".bin"))
    assert names == [token_shards.shard_name(k) for k in range(token_shards.manifest(folder)["shards"])]
    assert len(token_shards.read_slots(folder, 0, 10**6)[0]) == few.count()
    token_shards.write_shards(odd, MODEL, folder=folder, length=16, shard_bytes=680)
    # Another key: every record is new, none is stale; counting the result writes nothing.
    other = token_shards.write_shards(odd, MODEL, folder=folder, key=2, length=16, shard_bytes=680)
    read, held = token_shards.read_slots(folder, 0, len(rows))
    after = stamp()
    assert all(zlib.crc32(record(r)) == r.record_crc32 for r in other.collect()) and stamp() == after


def test_no_and_one_hot_id(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    folder = f"file:{tmp_path}/none"
    assert token_shards.write_shards(empty, MODEL, folder=folder).count() == 0 and token_shards.manifest(folder)["shards"] == 0
    assert len(token_shards.read_slots(folder, 0, 5)[0]) == 0
    hot = spark.createDataFrame([(None if i % 2 else 7, f"text {i % 3}") for i in range(60)], "doc_id long, text string")
    rows = token_shards.write_shards(hot, MODEL, folder=str(tmp_path / "hot"), length=2, shard_bytes=60).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and sum(r.doc_id is None for r in rows) * 2 == len(rows)
    with pytest.raises(ValueError):
        token_shards.write_shards(hot, MODEL, folder="nosuch://x/y")
    with pytest.raises(ValueError):
        token_shards.write_shards(hot, MODEL, length=1 << 16)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids array<int>")
    assert encode(empty, MODEL).count() == 0 and decode(empty, MODEL).count() == 0
    assert token_counts.count_lines(empty, MODEL).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_line_counts(odd, rule):
    rows = token_counts.count_lines(odd, MODEL, rule=rule).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    codec = Codec(open(MODEL, "rb").read())
    for i, t in enumerate(ODD):
        if not t:
            assert i not in by
            continue
        lines = [x for x in t.split("\n")]
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        _, starts, ends = codec.encode(t)
        edge = np.cumsum([0, *(len(x.encode()) for x in lines)])
        counts = [0] * len(lines)
        for s, e in zip(starts, ends):
            over = [max(0, min(e, edge[k + 1]) - max(s, edge[k])) for k in range(len(lines))]
            first = max(k for k in range(len(lines)) if edge[k] <= s)
            if rule == "every" and any(over):
                for k, o in enumerate(over):
                    counts[k] += o > 0
            else:
                counts[over.index(max(over)) if rule == "majority" and any(over) else first] += 1
        own = sorted(by[i], key=lambda r: r.section)[: len(lines)]
        assert [r.n_tokens for r in own] == counts
        assert [t[r.begin : r.end] for r in own] == lines


def test_field_counts(spark):
    rows = spark.createDataFrame([(1, "The cat", None, "sat."), (2, None, "", None), (3, "é", "日本", "x y")], "id long, a string, b string, c string")
    out = token_counts.count_fields(rows, MODEL, ["a", "b", "c"], id_col="id").orderBy("id", "section").collect()
    assert [(r.id, r.section) for r in out] == [(1, 0), (1, 1), (3, 0), (3, 1), (3, 2)]
    assert sum(r.n_tokens for r in out if r.id == 1) == len(LIBRARY.encode("The cat\nsat."))
    assert sum(r.n_tokens for r in out if r.id == 3) == len(LIBRARY.encode("é\n日本\nx y"))


def test_query_digests(spark):
    from fieldloom.llm.queries import op1_sentencepiece

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_sentencepiece(spark, sf).collect():
        ids = LIBRARY.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
        assert r.bytes_covered == len(texts[r.doc_id].encode())


def test_query_of_texts_without_pieces(odd, tmp_path):
    from fieldloom.llm.queries import op1_sentencepiece

    rows = [(i, t) for i, t in enumerate(ODD)]
    odd.sparkSession.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op1_sentencepiece(odd.sparkSession, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        assert (found[i].n_tokens, found[i].bytes_covered) == (len(ids), len((t or "").encode()))
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
