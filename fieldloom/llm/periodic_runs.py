"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a text are refined into classes of equal factors of length 1, 2, 3 and so on. Of the children of a class
all but the largest one are used to refine the next length (the smaller-half rule), so n words take n log n steps.
Neighbours of a class at a distance equal to the length mark a square with a primitive root; squares at successive
positions merge into a run. All texts of a slice are refined together, length by length, in numpy arrays.

A run of exponent `power` or more has power - 1 members or more in each of its classes, so smaller classes are dropped
at once; that loses no run, and common words of plain prose die out after a few lengths.

Defined cases: a null text, an empty one or one of blanks has no words and no runs; very long texts are taken whole;
rows are judged one by one, so repeated rows get equal results; an empty table gives no rows; an input column with the
name of an output gives way. Words are known by 64-bit hashes within their text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm import bytewords as bw
from fieldloom.llm.store import widened

#: Bytes of text refined together: the lengths are walked through once for all of them.
SLICE_BYTES = 4 << 20
#: The columns that find_runs() adds.
ADDED = {"n_words": "long", "run_starts": "array<int>", "run_lengths": "array<int>", "run_periods": "array<int>", "collapsed_text": "string"}


class _Gaps:
    """Positions by the distance to the next member of their class, handed out in the order of the distances. An entry
    that is no longer true is left in and passed over when it is handed out."""

    def __init__(self) -> None:
        self.near: dict[int, list[np.ndarray]] = {}
        self.far: defaultdict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.top = 1  # the first distance that is not near

    def add(self, gaps: np.ndarray, at: np.ndarray) -> None:
        if not len(gaps):
            return
        power = np.frexp(gaps.astype(np.float64))[1]
        for k in np.unique(power):
            some = power == k
            if 1 << (int(k) - 1) < self.top:
                self._spread(gaps[some], at[some])
            else:
                self.far[int(k)].append((gaps[some], at[some]))

    def _spread(self, gaps: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(gaps, kind="stable")
        gaps, at = gaps[order], at[order]
        cuts = np.flatnonzero(bw.heads(gaps))
        for gap, part in zip(gaps[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
            self.near.setdefault(gap, []).append(part)

    def take(self, gap: int) -> np.ndarray | None:
        while gap >= self.top:
            self.top *= 2
            held = self.far.pop(self.top.bit_length() - 1, None)
            if held:
                self._spread(np.concatenate([g for g, _ in held]), np.concatenate([p for _, p in held]))
        found = self.near.pop(gap, None)
        return None if found is None else np.unique(np.concatenate(found))


def _longer(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n values."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
    out[: len(a)] = a
    return out


class _Classes:
    """Classes of positions with equal factors of the current length. Class 0 is dead; so is any with too few members.

    Members of a class lie in one piece of `arena`, in ascending order, with holes where members have left, and are
    linked with their neighbours by `after` and `before` (0: none).
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, power: int, least_members: int):
        rows = len(first) - 1
        count = np.diff(first)
        self.least, n = least_members, len(hashes) + rows + 1
        self.row_at = first + np.arange(rows + 1) + 1  # a place of its own before each row ends the row before it
        row = np.repeat(np.arange(rows, dtype=np.int32), count)
        place = np.arange(len(hashes), dtype=np.int32) + row + np.int32(1)
        self.longest = np.zeros(n, dtype=np.int32)  # the largest period that counts, by position
        self.longest[place] = (count // power).astype(np.int32)[row]
        own = hashes ^ bw.mix(row.astype(np.uint64) + np.uint64(1))
        del row
        order = np.argsort(own)
        own = own[order]
        begin = np.flatnonzero(bw.heads(own))
        del own
        size = np.diff(np.append(begin, len(order)))
        alive = size >= least_members
        number = np.cumsum(alive)
        keep = np.repeat(np.where(alive, number, 0), size)
        # Members by class and place.
        packed = np.sort(keep[keep > 0] * n + place[order[keep > 0]])
        del order, keep, place
        cls, self.arena = (packed // n).astype(np.int32), (packed % n).astype(np.int32)
        del packed
        self.of = np.zeros(n, dtype=np.int32)
        self.of[self.arena] = cls
        self.size = np.concatenate([[0], size[alive]]).astype(np.int32)
        ends = np.cumsum(self.size)
        self.low, self.high = (ends - self.size).astype(np.int64), ends.astype(np.int64)
        self.classes, self.used = len(self.size), len(self.arena)
        self.after, self.before = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        self._link(self.arena, cls)
        self.split = np.arange(1, n, dtype=np.int32)  # every class of length 1 is new

    def _link(self, at: np.ndarray, group: np.ndarray) -> None:
        """Make the places neighbours of each other where their groups are alike."""
        if not len(at):
            return
        same = group[1:] == group[:-1]
        self.after[at[:-1]] = np.where(same, at[1:], 0)
        self.before[at[1:]] = np.where(same, at[:-1], 0)
        self.after[at[-1]] = self.before[at[0]] = 0

    def gaps(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the next member that squares of this length or more can have, and their places."""
        gap = self.after[at] - at
        useful = (gap >= length) & (gap <= self.longest[at]) & (self.size[self.of[at]] >= self.least)
        return gap[useful], at[useful]

    def squares(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those of the places at which a square of this root length begins."""
        return at[(self.after[at] - at == length) & (self.size[self.of[at]] >= self.least)]

    def _members(self, classes: np.ndarray) -> list[np.ndarray]:
        """All members of the classes."""
        if not len(classes):
            return []
        size = self.high[classes] - self.low[classes]
        at = np.arange(size.sum()) + np.repeat(self.low[classes] - (np.cumsum(size) - size), size)
        at, owner = self.arena[at], np.repeat(classes, size)
        return [at[self.of[at] == owner]]

    def refine(self, length: int) -> np.ndarray:
        """From this length to the next one. Returns the places whose next neighbour may have changed."""
        at = self.split - np.int32(1)
        at = at[(self.size[self.of[at]] >= self.least) & (self.longest[at] > length)]
        self.split = at
        if not len(at):
            return at
        at.sort()
        old, new = self.of[at], self.of[at + 1]
        new = np.where(self.size[new] >= self.least, new, 0)
        order = np.argsort(old.astype(np.int64) * self.classes + new, kind="stable")
        at, old, new = at[order], old[order], new[order]
        begin = np.flatnonzero(bw.heads(old, new))
        count = np.diff(np.append(begin, len(at))).astype(np.int32)
        parent, into = old[begin], new[begin]
        family = np.flatnonzero(bw.heads(parent))
        rest = self.size[parent[family]] - np.add.reduceat(count, family)
        # Places whose next word is in some dead class are not one class: they are never spared.
        weight = np.where(into > 0, count, 0)
        largest = np.maximum.reduceat(weight, family)
        number = np.cumsum(bw.heads(parent)) - 1  # of the family, for each group
        # One group that is the whole class: nothing to split, unless its members die.
        whole = (rest[number] == 0) & (count == self.size[parent]) & (into > 0)
        if whole.any():
            stays = np.repeat(~whole, count)
            kept = ~whole
            at, old = at[stays], old[stays]
            parent, into, count, number, weight = parent[kept], into[kept], count[kept], number[kept], weight[kept]
            if not len(at):
                self.split = at
                return at
        begin = np.cumsum(count) - count
        # Out of the lists of the classes that keep members: runs of neighbours leave together.
        leaves = np.repeat(rest[number] > 0, count)
        changed = [at]
        if leaves.any():
            gone = at[leaves]
            order = np.argsort(old[leaves].astype(np.int64) * len(self.of) + gone)
            gone = gone[order]
            head = np.ones(len(gone), dtype=bool)
            head[1:] = self.after[gone[:-1]] != gone[1:]
            left = self.before[gone[head]]
            right = self.after[gone[np.append(np.flatnonzero(head)[1:] - 1, len(gone) - 1)]]
            self.after[left], self.before[right] = right, left
            self.after[0] = self.before[0] = 0
            changed.append(left[left > 0])
        # New classes; groups that are too small, or whose next word is alone, die.
        lives = (count >= self.least) & (into > 0)
        made = int(lives.sum())
        group = np.where(lives, self.classes + np.cumsum(lives) - 1, 0).astype(np.int32)
        self.size, self.low, self.high = (_longer(a, self.classes + made) for a in (self.size, self.low, self.high))
        first = bw.heads(parent)
        parents, own = parent[first], number[first]
        self.size[parents] = rest[own]
        ids = group[lives]
        self.size[ids] = count[lives]
        each = np.repeat(group, count)
        self.of[at] = each
        moved = at[each > 0]
        self.arena = _longer(self.arena, self.used + len(moved))
        self.arena[self.used : self.used + len(moved)] = moved
        self.high[ids] = self.used + np.cumsum(count[lives])
        self.low[ids] = self.high[ids] - count[lives]
        self.classes += made
        self.used += len(moved)
        self._link(at, np.repeat(np.arange(len(count)), count))
        # The smaller halves: all that moved, without the largest group where that is larger than what stayed.
        spared = np.flatnonzero((weight == largest[number]) & (weight > rest[number]))
        spared = spared[bw.heads(number[spared])]
        small = np.ones(len(count), dtype=bool)
        small[spared] = False
        stayed = parents[(largest[own] > rest[own]) & (rest[own] > 0)]
        self.split = np.concatenate([at[np.repeat(small, count)], *self._members(stayed)])
        return np.concatenate(changed)


def runs(hashes: np.ndarray, first: np.ndarray, power: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start (word number in the row), length and period of all maximal runs of max(least, power * period) words or
    more, by row, start and period. first: for each row (and the end) the index of its first word."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(hashes):
        parts = _Classes(hashes, first, power, max(2, power - 1))
        gaps, length = _Gaps(), 1
        gaps.add(*parts.gaps(parts.arena, 1))
        while True:
            at = gaps.take(length)
            if at is not None and len(at := parts.squares(at, length)):
                head = np.ones(len(at), dtype=bool)
                head[1:] = at[1:] != at[:-1] + 1
                begin = np.flatnonzero(head)
                long = np.diff(np.append(begin, len(at))) + 2 * length - 1
                enough = long >= max(least, power * length)
                found.append((at[begin[enough]], long[enough], np.full(int(enough.sum()), length)))
            changed = parts.refine(length)
            length += 1
            if not len(parts.split):
                break
            gaps.add(*parts.gaps(changed, length))
        if found:
            at, long, period = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
            row = np.searchsorted(parts.row_at, at, side="right") - 1
            start = at - parts.row_at[row]
            order = np.lexsort((period, start, row))
            return row[order], start[order], long[order], period[order]
    none = np.zeros(0, dtype=np.int64)
    return none, none, none, none


def dropped(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ascending intervals of the words that some run of one text holds after its first period."""
    begin, end = start + period, start + length
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:] - 1, len(end) - 1)] if len(at) else end


@bw.tidied
def _found(batches: Iterator[pa.RecordBatch], text_at: int, power: int, least: int, outputs: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, at in bw.text_slices(batch.column(text_at), SLICE_BYTES):
            starts, ends, first = bw.words(data, at, bw.BLANKS)
            row, start, length, period = runs(bw.word_hashes(data, starts, ends), first, power, least)
            cuts = np.searchsorted(row, np.arange(high - low + 1))
            made = {"n_words": pa.array(np.diff(first), pa.int64())}
            for name, values in (("run_starts", start), ("run_lengths", length), ("run_periods", period)):
                made[name] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))
            if "collapsed_text" in outputs:
                texts = []
                for r in range(high - low):
                    own = slice(cuts[r], cuts[r + 1])
                    gone = dropped(start[own], length[own], period[own])
                    texts.append(bw.kept_words(data, starts, ends, first[r], first[r + 1], *gone))
                made["collapsed_text"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch([*batch.slice(low, high - low).columns, *(made[name] for name in outputs)], names=[*batch.schema.names, *outputs])


def find_runs(docs: DataFrame, power: int = 4, least: int = 6, text_col: str = "text", outputs: Sequence[str] = tuple(ADDED)) -> DataFrame:
    """docs with n_words, run_starts, run_lengths, run_periods (all runs, by start and then period, in words) and
    collapsed_text (the words that no run repeats, joined by one space), or with some of these."""
    if power < 2:
        raise ValueError("a run repeats its period at least twice")
    outputs = [name for name in ADDED if name in outputs]
    docs = docs.drop(*(name for name in outputs if name in docs.columns))
    schema = widened(docs.schema.fields, {name: ADDED[name] for name in outputs})
    text_at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _found(it, text_at, power, least, outputs), schema)
