"""SentencePiece encoding and decoding that keeps the offsets of the source.

The normaliser walks the model's compiled character map (a double-array trie over UTF-8 bytes and a pool of
replacements), always takes the longest prefix and records which source bytes each normalised character came from.
BPE merges then run inside chunks that no piece of the vocabulary can cross (blanks and what follows them), and every
piece is projected through that alignment to a span of source bytes.

Where the map is empty, a chunk of the source is a chunk of the normalised text. Different chunks are then normalised,
merged and aligned together as numpy columns, once for as long as a task remembers them (CACHE_BYTES); texts look
their chunks up. The library itself is used for nothing but reading the model file.

Defined cases: a null or empty text gives no pieces and decodes to the empty string; a character outside the
vocabulary becomes its byte pieces, each with its own byte as span (unknown id if the model has none); the spans of a
text are contiguous and cover it (what the map deletes belongs to the piece before, or at the start to the first one).
Models with user-defined, unused or suffix-blank pieces are refused with ValueError.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fieldloom.llm import bytewords as bw
from fieldloom.llm.store import widened

BLANK = "▁"
NONE = float("-inf")
#: Bytes of remembered chunks in a task, each with some CACHE_EACH bytes besides its text; characters beyond which
#: merges use a heap; chunks of about one length that are merged one by one; bytes of text encoded at once.
CACHE_BYTES, CACHE_EACH, LONG, FEW, SLICE = 32 << 20, 80, 256, 6, 2 << 20
#: Chunks of these many characters, blank included, or fewer are merged together.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 48, LONG)


class CharMap:
    """The compiled character map: longest-prefix lookup of replacements."""

    def __init__(self, blob: bytes):
        self.units: Sequence[int] = ()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, str] | None:
        """Length of the longest key that the text has at this byte, and what replaces it."""
        units, best = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.pool.index(0, best[1])
        return best[0], self.pool[best[1] : end].decode()


class Pairs:
    """A map from long keys to numbers, looked up for whole columns: each level is a table of one number for a slot; keys
    whose slot is taken go to the next, smaller level, and the slot says so."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(4, int(len(keys) * 8).bit_length())
            slot = self._slot(keys, bits)
            _, first = np.unique(slot, return_index=True)
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            held, number, more = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=bool)
            held[slot[first]], number[slot[first]], more[slot[rest]] = keys[first], values[first], True
            self.levels.append((bits, held, number, more))
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        mixed = keys.astype(np.uint64)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those without one."""
        out = np.full(len(keys), -1, dtype=np.int32)
        live = None
        for bits, held, number, more in self.levels:
            slot = self._slot(keys, bits)
            hit = held[slot] == keys
            if live is None:
                out[hit] = number[slot[hit]]
                live = np.flatnonzero(more[slot] & ~hit)
            else:
                out[live[hit]] = number[slot[hit]]
                rest = more[slot] & ~hit
                live, keys = live[rest], keys[rest]
                if len(live):
                    continue
                break
            if not len(live):
                break
            keys = keys[live]
        return out


class Codec:
    """An encoder and decoder for one model, given as the bytes of its file. cache_bytes: of the chunks it remembers."""

    def __init__(self, model: bytes, cache_bytes: int = CACHE_BYTES):
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.cache_bytes = cache_bytes
        m = proto.ModelProto()
        m.ParseFromString(model)
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != 2 or kinds & {4, 5} or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without user-defined, unused or suffix-blank pieces are supported")
        spec = m.normalizer_spec
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharMap(spec.precompiled_charsmap)
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_ids = set(self.bytes.values())
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("a piece has a blank inside")
        of_byte = {i: b for b, i in self.bytes.items()}
        unk = (m.trainer_spec.unk_surface if m.trainer_spec.HasField("unk_surface") else " ⁇ ").encode()
        self.surface = [bytes([of_byte[i]]) if i in of_byte else b"" if p.type == 3 else unk if p.type == 2 else p.piece.replace(BLANK, " ").encode() for i, p in enumerate(m.pieces)]
        self.table = pa.array(self.surface, pa.large_binary())
        # Without a map, chunks of the source are chunks of the normalised text.
        self.plain = not self.map.units and not self.squeeze and self.escape and self.prefix and bool(self.bytes)
        self.doubled = any(p.startswith(2 * BLANK) for p in self.score)
        if self.plain:
            self._columns(m.pieces)
        self._forget()

    def _columns(self, pieces: Sequence) -> None:
        """Tables for merging many chunks at once. A symbol is the id of a piece, or `top` and a code point."""
        self.top = len(pieces)
        best = np.array([-p.score if p.type == 1 else np.inf for p in pieces])
        self.rank = np.unique(best, return_inverse=True)[1].astype(np.int32)
        self.first_symbol = np.arange(0x110000, dtype=np.int32) + self.top
        for p, i in self.ids.items():
            if len(p) == 1:
                self.first_symbol[ord(p)] = i
        symbol = lambda x: self.ids.get(x, self.top + ord(x) if len(x) == 1 else None)
        keys, merged = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 21 | b)
                    merged.append(i)
        self.pairs = Pairs(np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int32))
        self.chars = np.array([len(p.piece) for p in pieces], dtype=np.int32)
        self.byte_piece = np.array([self.bytes[b] for b in range(256)], dtype=np.int32)

    # Normalisation

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text (blanks escaped) and for each character, and the end, its first source byte."""
        raw = text.encode()
        out: list[str] = []
        at: list[int] = []
        i = 0
        while i < len(raw):
            hit = self.map.longest(raw, i) if self.map.units else None
            if hit:
                size, new = hit
            else:
                lead = raw[i]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[i : i + size].decode()
            for c in new:
                if not (self.squeeze and c == " " and (not out or out[-1] == " ")):
                    out.append(c)
                    at.append(i)
            i += size
        while self.squeeze and out and out[-1] == " ":
            out.pop()
            at.pop()
        if self.prefix and out:
            out.insert(0, " ")
            at.insert(0, 0)
        if at:
            at[0] = 0
        at.append(len(raw))
        blank = BLANK if self.escape else " "
        return "".join(out).replace(" ", blank), at

    # Merges

    def merge(self, chars: list[str]) -> list[str]:
        """Best score first, of equal ones the leftmost."""
        if len(chars) > LONG:
            return self._merge_long(chars)
        score = self.score
        pairs = [score.get(a + b, NONE) for a, b in zip(chars, chars[1:])]
        while pairs:
            best = max(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            chars[i : i + 2] = [chars[i] + chars[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score.get(chars[i - 1] + chars[i], NONE)
            if i < len(pairs):
                pairs[i] = score.get(chars[i] + chars[i + 1], NONE)
        return chars

    def _merge_long(self, chars: list[str]) -> list[str]:
        score, n = self.score, len(chars)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part: list[str | None] = list(chars)
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := chars[i] + chars[i + 1]) in score]
        heapify(heap)
        while heap:
            _, i, p = heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (q := part[a] + part[b]) in score:
                    heappush(heap, (-score[q], a, q))
        return [p for p in part if p is not None]

    def pieces(self, chunk: str) -> list[tuple[int, int, int]]:
        """(id, characters before its end, bytes before its end or -1) of a normalised chunk's pieces; a byte piece
        inside a character ends at that byte of it."""
        out, done = [], 0
        for p in self.merge(list(chunk)):
            done += len(p)
            found = self.ids.get(p)
            if found is not None:
                out.append((found, done, -1))
            elif self.bytes:
                raw = p.encode()
                out += [(self.bytes[b], done - 1 if k + 1 < len(raw) else done, k + 1 if k + 1 < len(raw) else -1) for k, b in enumerate(raw)]
            else:
                out.append((self.unknown, done, -1))
        return out

    # Whole texts

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids, first source byte and end source byte of each piece."""
        norm, at = self.normalise(text)
        ids, ends, base = [], [], 0
        for chunk in re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", norm):
            for i, chars, inner in self.pieces(chunk):
                ids.append(i)
                end = at[base + chars]
                ends.append(end if inner < 0 else min(end + inner, at[base + chars + 1]))
            base += len(chunk)
        if ends:
            ends[-1] = at[-1]
        return ids, [0, *ends[:-1]][: len(ids)], ends

    def decode(self, ids: Sequence[int]) -> str:
        raw = b"".join(self.surface[i] for i in ids)
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and first not in self.byte_ids and (self.prefix or self.squeeze) and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_bytes(raw)

    @staticmethod
    def _decode_bytes(raw: bytes) -> str:
        """Each byte that belongs to no whole character becomes U+FFFD."""
        out, i = [], 0
        while i < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + size].decode())
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)

    # Many texts at once, for models with an empty character map

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.flat_ends = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.cuts, self.sizes = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @staticmethod
    def normalise_many(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks (each without the blank before it): code points with escaped blanks and one put in front, the byte
        of the chunk at which each ends, and where each chunk's code points begin (and the last end)."""
        codes = np.frombuffer((" " + " ".join(chunks)).encode("utf-32-le"), dtype=np.uint32) if " " not in "".join(chunks) else None
        size = np.array([len(c) + 1 for c in chunks], dtype=np.int64)
        if codes is None:
            codes = np.frombuffer("".join(f" {c}" for c in chunks).encode("utf-32-le"), dtype=np.uint32)
        first = np.concatenate([[0], np.cumsum(size)])
        width = 1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF)
        width[first[:-1]] = 0
        ends = np.cumsum(width, dtype=np.int64)
        ends -= np.repeat(ends[first[:-1]], size)
        return np.where(codes == 0x20, np.uint32(ord(BLANK)), codes), ends, first

    def merge_many(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges in rows of symbols (the first `size` of each): the symbols, and how many each row has left. In each
        round every row that can merges its best pair, of equal ones the leftmost."""
        n, width = symbols.shape
        left = size.copy()
        none = np.int32(len(self.rank))
        ranked = np.append(self.rank, none)
        out, live = symbols, np.arange(n)
        own = symbols.astype(np.int64)
        rank = np.empty((n, max(width - 1, 0)), dtype=np.int32)
        for k in range(width - 1):
            both = np.flatnonzero(size > k + 1)
            rank[:, k] = none
            rank[both, k] = ranked[self.pairs.find(own[both, k] << 21 | own[both, k + 1])]
        while len(live) and rank.shape[1]:
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            go = rank[row, at] < none
            if not go.all():
                out[live[~go], : own.shape[1]] = own[~go]
                live, own, rank, at = live[go], own[go], rank[go], at[go]
                row = row[: len(live)]
            if not len(live):
                break
            own[row, at] = self.pairs.find(own[row, at] << 21 | own[row, at + 1])
            left[live] -= 1
            cols = np.arange(own.shape[1] - 1)
            own = np.where(cols <= at[:, None], own[:, :-1], own[:, 1:])
            cols = cols[:-1]
            rank = np.where(cols < at[:, None], rank[:, :-1], rank[:, 1:])
            some = np.flatnonzero(at + 1 < left[live])
            rank[some, at[some]] = ranked[self.pairs.find(own[some, at[some]] << 21 | own[some, at[some] + 1])]
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = ranked[self.pairs.find(own[some, at[some] - 1] << 21 | own[some, at[some]])]
        if len(live):
            out[live, : own.shape[1]] = own
        return out, left

    def _learn(self, new: list[str]) -> np.ndarray:
        """Number chunks that are not known yet (each without the blank before it)."""
        if self.held > self.cache_bytes:
            raise MemoryError("the caller forgets chunks beyond cache_bytes")
        codes, ends, first = self.normalise_many(new)
        size = np.diff(first)
        flat, flat_ends, counts, order = [self.flat], [self.flat_ends], [], []
        widths = np.array([*WIDTHS, max(int(size.max()), LONG + 1)])
        kind = np.searchsorted(widths, size)
        for width, rows in ((widths[k], np.flatnonzero(kind == k)) for k in np.unique(kind)):
            order.append(rows)
            if width > LONG or len(rows) < FEW:
                for r in rows:
                    found = self.pieces("".join(map(chr, codes[first[r] : first[r + 1]])))
                    own = ends[first[r] : first[r + 1]]
                    flat.append(np.array([x[0] for x in found], dtype=np.int32))
                    flat_ends.append(np.array([own[c - 1] if b < 0 else (own[c - 1] if c else 0) + b for _, c, b in found], dtype=np.int32))
                    counts.append(np.array([len(found)]))
                continue
            at = np.minimum(first[rows][:, None] + np.arange(width), len(codes) - 1)
            symbols, left = self.merge_many(self.first_symbol[codes[at]], size[rows])
            whole = np.arange(width) < left[:, None]
            got = symbols[whole]
            known = got < self.top
            done = np.zeros(symbols.shape, dtype=np.int64)
            done[whole] = np.where(known, self.chars[np.minimum(got, self.top - 1)], 1)
            last = np.cumsum(done, axis=1)[whole] - 1
            row = np.repeat(np.arange(len(rows)), left)
            end = ends[first[rows][row] + last]
            if known.all():
                flat.append(got.astype(np.int32))
                flat_ends.append(end.astype(np.int32))
                counts.append(left)
                continue
            # Characters outside the vocabulary become one piece for each byte.
            point = np.where(known, 0, got - self.top)
            wide = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
            many = np.repeat(np.arange(len(got)), wide)
            nth = np.arange(len(many)) - np.repeat(np.cumsum(wide) - wide, wide)
            raw = np.frombuffer("".join(map(chr, point[~known])).encode(), dtype=np.uint8)
            ids = got[many].astype(np.int32)
            ids[~known[many]] = self.byte_piece[raw]
            flat.append(ids)
            flat_ends.append((end[many] - np.where(known[many], 0, wide[many] - 1 - nth)).astype(np.int32))
            counts.append(np.bincount(row[many], minlength=len(rows)))
        order = np.concatenate(order)
        number = np.empty(len(new), dtype=np.int64)
        number[order] = np.arange(len(self.sizes), len(self.sizes) + len(new))
        self.known.update(zip(new, number.tolist(), strict=True))
        self.flat, self.flat_ends = np.concatenate(flat), np.concatenate(flat_ends)
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(np.concatenate(counts))])
        sizes = ends[first[1:] - 1][order]
        self.sizes = np.concatenate([self.sizes, sizes])
        self.held += int(sizes.sum()) + CACHE_EACH * len(new)
        return number

    def _chunks(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each chunk of the texts, and where each text's chunks begin (and the last end)."""
        if any(t and (t[0] == " " or "  " in t) for t in texts) and self.doubled:
            lists = [_KEYS(" " + t) if t else [] for t in texts]
            count = np.array([len(x) for x in lists], dtype=np.int64)
            keys = pa.array([k for x in lists for k in x], pa.large_string())
        else:
            full = np.array([bool(t) for t in texts], dtype=bool)
            lists = pc.split_pattern(pa.array([t for t in texts if t], pa.large_string()), " ")
            count = np.zeros(len(texts), dtype=np.int64)
            count[full] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            keys = lists.flatten()
        coded = keys.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # a tenth of the time of to_pylist()
        if self.held > self.cache_bytes:
            self._forget()
        number = np.fromiter(map(self.known.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn([names[i] for i in new.tolist()])
        return number[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, dtype=np.int64), np.concatenate([[0], np.cumsum(count)])

    def encode_many(self, texts: Sequence[str | None], spans: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts, ends of all texts' pieces, and where each text's pieces begin (and the last end). Without spans
        the starts and ends are left out (empty)."""
        alone = [bool(t) and (not self.plain or BLANK in t) for t in texts]
        if any(alone):
            ids, starts, ends, cuts = self.encode_many([None if a else t for t, a in zip(texts, alone, strict=True)]) if self.plain else (*[np.zeros(0, dtype=np.int32)] * 3, np.zeros(len(texts) + 1, dtype=np.int64))
            rows = [self.encode(t) if a else (ids[cuts[i] : cuts[i + 1]], starts[cuts[i] : cuts[i + 1]], ends[cuts[i] : cuts[i + 1]]) for i, (t, a) in enumerate(zip(texts, alone, strict=True))]
            none = np.zeros(0, dtype=np.int32)
            return *(np.concatenate([np.asarray(r[k], dtype=np.int32) for r in rows]) if spans or not k else none for k in range(3)), np.cumsum([0, *(len(r[0]) for r in rows)])
        chunk, first = self._chunks(texts)
        count = self.cuts[chunk + 1] - self.cuts[chunk]
        token = np.concatenate([[0], np.cumsum(count)])
        take = np.arange(token[-1]) + np.repeat(self.cuts[chunk] - token[:-1], count)
        ids = self.flat[take]
        cuts = token[first]
        if not spans:
            return ids, np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), cuts
        # Where each chunk's text begins: after the chunks before it and one blank between two.
        size = self.sizes[chunk] + 1
        begin = np.cumsum(size) - size
        begin -= np.repeat(np.append(begin, 0)[first[:-1]], np.diff(first))
        ends = (self.flat_ends[take] + np.repeat(begin, count)).astype(np.int32)
        starts = np.empty_like(ends)
        starts[1:] = ends[:-1]
        starts[cuts[:-1][np.diff(cuts) > 0]] = 0
        return ids, starts, ends, cuts

    def decode_many(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        parts = self.table.take(pa.array(ids))
        raw, at = parts.buffers()[2], np.frombuffer(parts.buffers()[1], dtype=np.int64)[parts.offset : parts.offset + len(parts) + 1]
        data = memoryview(raw) if raw is not None else memoryview(b"")
        out = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                out.append("")
                continue
            own = bytes(data[at[low] : at[high]])
            if own[:1] == b" " and int(ids[low]) not in self.byte_ids and (self.prefix or self.squeeze):
                own = own[1:]
            try:
                out.append(own.decode())
            except UnicodeDecodeError:
                out.append(self.decode(ids[low:high].tolist()))
        return out


#: Chunks of a text with a blank put in front: each without its first blank.
_KEYS: Callable[[str], list[str]] = re.compile(" ( *[^ ]*)").findall


#: The columns that encode() and decode() add.
ADDED = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "string"}


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(total, total[low] + SLICE, side="right")) - 1)
        yield low, min(high, len(size))
        low = min(high, len(size))


@bw.tidied
def _encoded(batches: Iterator[pa.RecordBatch], model: bytes, text_at: int, keep: list[int], outputs: list[str]) -> Iterator[pa.RecordBatch]:
    codec = Codec(model)
    for batch in batches:
        for low, high in _slices(batch.column(text_at)):
            ids, starts, ends, cuts = codec.encode_many(batch.column(text_at).slice(low, high - low).to_pylist())
            lists = {"ids": ids, "starts": starts, "ends": ends}
            made = {name: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(lists[name], pa.int32())) if name in lists else pa.array(codec.decode_many(ids, cuts), pa.string()) for name in outputs}
            yield pa.record_batch([*(batch.column(i).slice(low, high - low) for i in keep), *made.values()], names=[*(batch.schema.names[i] for i in keep), *made])


def encode(docs: DataFrame, model: str, text_col: str = "text", outputs: Sequence[str] = tuple(ADDED), keep_text: bool = True) -> DataFrame:
    """docs with ids, starts, ends (source bytes of each piece) and decoded (the ids decoded again), or some of these.

    model: path of the SentencePiece model on the driver. An input column with one of the names gives way.
    """
    outputs = [name for name in ADDED if name in outputs]
    docs = docs.drop(*(name for name in outputs if name in docs.columns and name != text_col))
    with open(model, "rb") as f:
        blob = f.read()
    text_at = docs.columns.index(text_col)
    keep = [i for i in range(len(docs.columns)) if keep_text or i != text_at]
    schema = widened([docs.schema[i] for i in keep], {name: ADDED[name] for name in outputs})
    return docs.mapInArrow(lambda it: _encoded(it, blob, text_at, keep, outputs), schema)


def _decoded(batches: Iterator[pa.RecordBatch], model: bytes, ids_at: int) -> Iterator[pa.RecordBatch]:
    codec = Codec(model)
    for batch in batches:
        texts = [codec.decode(x) if x is not None else "" for x in batch.column(ids_at).to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """rows with decoded, the text of their ids (null: empty)."""
    rows = rows.drop("decoded")
    with open(model, "rb") as f:
        blob = f.read()
    ids_at = rows.columns.index(ids_col)
    return rows.mapInArrow(lambda it: _decoded(it, blob, ids_at), widened(rows.schema.fields, {"decoded": "string"}))
