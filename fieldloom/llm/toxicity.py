"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Each word enters as a learned word vector and the mean of the learned vectors of its character n-grams (prefixes and
inner n-grams, word edges marked), so that words never seen in training still have their character input. Two gated
recurrent layers read a window of words from both ends, attention pools their states, and a document takes the highest
of all its overlapping windows, one from every word on, calibrated with the logarithm of their number.

Everything is trained in numpy on the driver. Each round, every toxic document trains its best window and every clean
one its best and a random one; the first choice goes by the log-odds of words. Words and n-grams of fewer than `LEAST`
training documents have no vector, and a share `DROPPED` of the word vectors is left out at random while training.

Scoring reads neighbouring windows together: at step t all windows of a stretch of text take the inputs of the words t
places on, which is a shifted view of one table, so the cost is that of the recurrence alone.

At most `max_docs` labelled rows (smallest hash of the id first) are brought to the driver, and `max_bytes` of text: a
text that does not fit what is left of these is passed over, the rows after it are not.

Defined cases: null and empty texts are one empty window; very long texts are scored whole; rows that repeat an id are
scored each, and of their texts the shortest, then the first, trains; a null id is scored but never trains; a training
set with a single class gives every document the share of its class; repeated labels of a document count once (toxic
wins), null labels not at all; extra columns pass, and those named like an output give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytewords as bw
from fieldloom.llm.store import widened

WINDOW, HIDDEN, WORD_SIZE, CHAR_SIZE = 16, 4, 8, 8
INPUTS = WORD_SIZE + CHAR_SIZE
#: Training documents that a word or n-gram needs for a vector of its own; share of word vectors dropped in training.
LEAST, DROPPED = 3, 0.2
#: Distinct words that a task remembers; windows scored at once.
CACHE, AT_ONCE = 200_000, 2048
_WORDS = re.compile(r"[^\W\d_]+").findall


def grams(word: str) -> list[str]:
    """Prefixes (up to eight characters) and inner n-grams (four characters) of the word with marked edges."""
    marked = f"^{word}$"
    return [marked[:n] for n in range(3, min(9, len(marked)))] + [f"~{marked[i : i + 4]}" for i in range(1, len(marked) - 4)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """p: per direction W (inputs to gates), U (state to gates), b; v attention; w, c output. Gates: update, reset, state."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        p: dict[str, np.ndarray] = {}
        for d in "fb":
            p[f"W{d}"] = rng.normal(0, 0.3, (INPUTS, 3 * HIDDEN))
            p[f"U{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
            p[f"b{d}"] = np.zeros(3 * HIDDEN)
        p["v"], p["w"], p["c"] = rng.normal(0, 0.3, 2 * HIDDEN), rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
        return Network({k: x.astype(np.float32) for k, x in p.items()})

    def _read(self, d: str, x: np.ndarray, mask: np.ndarray):
        """States of one direction, and what the way back needs. x: (step, window, inputs)."""
        steps, n, _ = x.shape
        u, h = self.p[f"U{d}"], np.zeros((n, HIDDEN), dtype=x.dtype)
        gates = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        states, trail = np.empty((steps, n, HIDDEN), dtype=x.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            trail.append((t, h, z, r, c, hu[:, 2 * HIDDEN :], m))
            h = states[t] = h + m * (1 - z) * (c - h)
        return states, trail

    def forward(self, x: np.ndarray, mask: np.ndarray):
        """Logits of windows and what backward() needs. x: (step, window, inputs); mask: (step, window)."""
        hf, tf = self._read("f", x, mask)
        hb, tb = self._read("b", x, mask)
        h = np.concatenate([hf, hb], axis=2)
        s = np.where(mask > 0, h @ self.p["v"], -1e9)
        s -= s.max(axis=0)
        a = np.exp(s) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = (a[:, :, None] * h).sum(axis=0)
        return pooled @ self.p["w"] + self.p["c"], (h, a, pooled, tf, tb)

    def backward(self, x: np.ndarray, dlogit: np.ndarray, held) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of x."""
        h, a, pooled, tf, tb = held
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"], g["c"] = pooled.T @ dlogit, np.array([dlogit.sum()], dtype=x.dtype)
        dpool = dlogit[:, None] * self.p["w"]
        along = (h * dpool).sum(axis=2)
        ds = a * (along - (a * along).sum(axis=0))
        g["v"] = np.einsum("tnh,tn->h", h, ds)
        dh = a[:, :, None] * dpool + ds[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        for d, trail, own in (("f", tf, dh[:, :, :HIDDEN]), ("b", tb, dh[:, :, HIDDEN:])):
            u, carry = self.p[f"U{d}"], np.zeros((x.shape[1], HIDDEN), dtype=x.dtype)
            for t, before, z, r, c, hc, m in reversed(trail):
                dn = own[t] + carry
                dz = -dn * m * (c - before)
                dc = dn * m * (1 - z) * (1 - c * c)
                dr = dc * hc
                dpre = np.concatenate([dz * z * (1 - z), dr * r * (1 - r), dc], axis=1)
                du = np.concatenate([dpre[:, : 2 * HIDDEN], dc * r], axis=1)
                g[f"W{d}"] += x[t].T @ dpre
                g[f"b{d}"] += dpre.sum(axis=0)
                g[f"U{d}"] += before.T @ du
                dx[t] += dpre @ self.p[f"W{d}"].T
                carry = dn * (1 - m * (1 - z)) + du @ u.T
        return g, dx

    # Scoring: one column for each window.

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Inputs of the gates of both directions, a column for each row of x; those of update and reset negated."""
        sign = np.repeat(np.array([-1, -1, 1], dtype=np.float32), HIDDEN)[:, None]
        return {d: np.ascontiguousarray((x @ self.p[f"W{d}"] + self.p[f"b{d}"]).T * sign) for d in "fb"}

    def logits(self, step, mask: np.ndarray | None, n: int) -> np.ndarray:
        """Logits of n windows. step(d, t): the gates' inputs of direction d at step t, a column for each window;
        mask: (step, window) or None where all windows are full."""
        with np.errstate(over="ignore"):
            return self._logits(step, mask, n)

    def _logits(self, step, mask: np.ndarray | None, n: int) -> np.ndarray:
        seen, told = np.zeros((WINDOW, n), dtype=np.float32), np.zeros((WINDOW, n), dtype=np.float32)
        zr, c, one = np.empty((2 * HIDDEN, n), dtype=np.float32), np.empty((HIDDEN, n), dtype=np.float32), np.float32(1)
        sign = np.repeat(np.array([-1, -1, 1], dtype=np.float32), HIDDEN)[:, None]
        for k, d in enumerate("fb"):
            own = slice(k * HIDDEN, (k + 1) * HIDDEN)
            # One product gives what the state means to attention and output, and what it gives to the next step.
            u = np.concatenate([self.p[f"U{d}"].T * sign, self.p["v"][None, own], self.p["w"][None, own]])
            h, hu = np.zeros((HIDDEN, n), dtype=np.float32), np.zeros((3 * HIDDEN + 2, n), dtype=np.float32)
            z, r, state = zr[:HIDDEN], zr[HIDDEN:], hu[2 * HIDDEN : 3 * HIDDEN]
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g = step(d, t)
                np.add(g[: 2 * HIDDEN], hu[: 2 * HIDDEN], out=zr)
                np.exp(zr, out=zr)
                np.add(zr, one, out=zr)
                np.reciprocal(zr, out=zr)
                np.multiply(r, state, out=c)
                np.add(c, g[2 * HIDDEN :], out=c)
                np.tanh(c, out=c)
                np.subtract(c, h, out=c)
                np.subtract(one, z, out=z)
                if mask is not None:
                    z *= mask[t]
                np.multiply(c, z, out=c)
                np.add(h, c, out=h)
                np.matmul(u, h, out=hu)
                seen[t] += hu[-2]
                told[t] += hu[-1]
        if mask is not None:
            seen[mask == 0] = -1e9
        seen -= seen.max(axis=0)
        np.exp(seen, out=seen)
        if mask is not None:
            seen *= mask
        return (seen * told).sum(axis=0) / np.maximum(seen.sum(axis=0), 1e-9) + self.p["c"][0]


@dataclass
class Model:
    words: dict[str, int]
    grams: dict[str, int]
    word_vectors: np.ndarray
    gram_vectors: np.ndarray
    network: Network | None
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float = 0.5

    def inputs(self, words: list[str]) -> np.ndarray:
        """A row for each word: its vector (zeros if unknown) and the mean of its known n-grams' vectors."""
        own = np.array([self.words.get(w, -1) for w in words], dtype=np.int64)
        get = self.grams.get
        lists = [[k for k in map(get, grams(w)) if k is not None] for w in words]
        return _inputs(own, *_flat(lists), self.word_vectors, self.gram_vectors)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k for x in lists for k in x], dtype=np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])


def _sums(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of rows[cuts[i]:cuts[i + 1]]."""
    out = np.zeros((len(cuts) - 1, rows.shape[1]), dtype=rows.dtype)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        out[some] = np.add.reduceat(rows, cuts[some], axis=0)
    return out


def _inputs(own: np.ndarray, flat: np.ndarray, cuts: np.ndarray, word_vectors: np.ndarray, gram_vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(own), INPUTS), dtype=np.float32)
    out[own >= 0, :WORD_SIZE] = word_vectors[own[own >= 0]]
    out[:, WORD_SIZE:] = _sums(gram_vectors[flat], cuts) / np.maximum(np.diff(cuts), 1)[:, None]
    return out


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word (within the row) of all overlapping windows; a row without words has one, empty."""
    n = np.maximum(1, counts - WINDOW + 1)
    row = np.repeat(np.arange(len(counts)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _steps(number: np.ndarray, first: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step, window) word numbers and mask."""
    step = np.arange(WINDOW)[:, None]
    mask = start + step < np.diff(first)[row]
    at = np.where(mask, first[:-1][row] + start + step, 0)
    return (number[at] if len(number) else at), mask.astype(np.float32)


def window_logits(net: Network, inputs: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The logit of each of windows(). inputs: by word number."""
    counts = np.diff(first)
    row, start = windows(counts)
    out = np.empty(len(row), dtype=np.float32)
    tables = net.tables(inputs if len(inputs) else np.zeros((1, INPUTS), dtype=np.float32))
    full = counts[row] >= WINDOW
    # All places of the whole stretch are read; those near the end of a row are no windows of it.
    place = (first[:-1][row] + start)[full]
    got = np.empty(max(0, len(number) - WINDOW + 1), dtype=np.float32)
    if len(place):
        for low in range(0, len(got), AT_ONCE):
            n = min(AT_ONCE, len(got) - low)
            own = {d: np.take(g, number[low : low + n + WINDOW - 1], axis=1) for d, g in tables.items()}
            got[low : low + n] = net.logits(lambda d, t: own[d][:, t : t + n], None, n)  # noqa: B023
        out[full] = got[place]
    short = np.flatnonzero(~full)
    for low in range(0, len(short), AT_ONCE):
        part = short[low : low + AT_ONCE]
        words, mask = _steps(number, first, row[part], start[part])
        out[part] = net.logits(lambda d, t: np.take(tables[d], words[t], axis=1), mask, len(part))  # noqa: B023
    return out


def _top(logit: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Index of the highest window of each row; every row has one."""
    order = np.lexsort((-logit, row))
    return order[np.flatnonzero(bw.heads(row[order]))]


class _Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, g in grads.items():
            g = np.clip(g, -5, 5)
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)


class _Sparse:
    """Vectors that learn with a rate of their own, by the squares of all their gradients so far."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.seen = vectors, np.full(len(vectors), 1e-6, dtype=np.float32)

    def step(self, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
        if not len(rows):
            return
        order = np.argsort(rows, kind="stable")
        cuts = np.flatnonzero(bw.heads(rows[order]))
        own, g = rows[order][cuts], np.add.reduceat(grads[order], cuts, axis=0)
        self.seen[own] += (g * g).mean(axis=1)
        self.vectors[own] -= rate * g / np.sqrt(self.seen[own])[:, None]


def _numbers(lists: Iterator[list[str]], labels: np.ndarray) -> tuple[dict[str, int], list[np.ndarray], np.ndarray]:
    """Keys, their numbers row by row, and for each key the rows of label 0 and 1 that hold it."""
    keys: dict[str, int] = {}
    rows = [np.array([keys.setdefault(k, len(keys)) for k in own], dtype=np.int64) for own in lists]
    counts = np.zeros((len(keys), 2), dtype=np.int64)
    for own, y in zip(rows, labels, strict=True):
        counts[np.unique(own), y] += 1
    return keys, rows, counts


def train(texts: list[str], labels: np.ndarray, seed: int = 7, rounds: int = 3, epochs: int = 4, rate: float = 0.02) -> Model:
    labels = np.asarray(labels, dtype=np.int64)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    none = np.zeros((0, WORD_SIZE), dtype=np.float32)
    if not n1 or not n0:
        return Model({}, {}, none, none, None, constant=float(n1 > 0) if n1 + n0 else 0.0)
    rng = np.random.default_rng(seed)
    vocabulary, numbers, counts = _numbers((_WORDS(t.lower()) if t else [] for t in texts), labels)
    names = list(vocabulary)
    size = np.array([len(x) for x in numbers])
    first = np.concatenate([[0], np.cumsum(size)])
    number = np.concatenate(numbers)
    odds = np.log((counts[:, 1] + 1) / (n1 + 2)) - np.log((counts[:, 0] + n0 / n1) / (n0 + 2 * n0 / n1))
    # n-grams by documents: those of a document's different words.
    gram_numbers, of_word = {}, []
    for w in names:
        of_word.append(np.array([gram_numbers.setdefault(k, len(gram_numbers)) for k in grams(w)], dtype=np.int64))
    held = np.zeros(len(gram_numbers), dtype=np.int64)
    for own in numbers:
        if len(own):
            held[np.unique(np.concatenate([of_word[j] for j in np.unique(own)]))] += 1
    kept = held >= LEAST
    place = np.where(kept, np.cumsum(kept) - 1, -1)
    flat, cuts = _flat([[g for g in place[x].tolist() if g >= 0] for x in of_word])
    del of_word
    known = counts.sum(axis=1) >= LEAST
    own = np.where(known, np.cumsum(known) - 1, -1)
    word_vectors, gram_vectors = (rng.normal(0, 0.1, (n, k)).astype(np.float32) for n, k in ((int(known.sum()), WORD_SIZE), (int(kept.sum()), CHAR_SIZE)))
    word_step, gram_step = _Sparse(word_vectors), _Sparse(gram_vectors)
    net = Network.fresh(rng)
    adam = _Adam(net.p)
    row, start = windows(size)
    sums = np.concatenate([[0], np.cumsum(np.maximum(odds, 0)[number])])
    begin = first[:-1][row] + start
    logit = (sums[np.minimum(begin + WINDOW, first[1:][row])] - sums[begin]).astype(np.float32)
    clean = np.flatnonzero(labels == 0)
    low, high = np.searchsorted(row, clean), np.searchsorted(row, clean, side="right")
    for r in range(rounds):
        chosen = np.concatenate([_top(logit, row), low + rng.integers(0, high - low)])
        target = np.concatenate([labels, np.zeros(len(clean), dtype=np.int64)]).astype(np.float32)
        weight = np.where(target > 0, min(4.0, len(clean) / n1), 1.0).astype(np.float32)
        pace = 1.0 if r + 1 < rounds else 0.3
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), 256):
                part = order[at : at + 256]
                words, mask = _steps(number, first, row[chosen[part]], start[chosen[part]])
                used, where = np.unique(words, return_inverse=True)
                many = cuts[used + 1] - cuts[used]
                spans = np.arange(many.sum()) + np.repeat(cuts[used] - (np.cumsum(many) - many), many)
                mine = np.where(rng.random(len(used)) < DROPPED, -1, own[used])
                x = _inputs(mine, flat[spans], np.concatenate([[0], np.cumsum(many)]), word_vectors, gram_vectors)[where.reshape(words.shape)] * mask[:, :, None]
                out, trail = net.forward(x, mask)
                d = ((_sigmoid(out) - target[part]) * weight[part] / len(part)).astype(np.float32)
                grads, dx = net.backward(x, d, trail)
                adam.step(grads, rate * pace)
                dx *= mask[:, :, None]
                total = np.zeros((len(used), INPUTS), dtype=np.float32)
                for k in range(INPUTS):
                    total[:, k] = np.bincount(where.reshape(-1), weights=dx[:, :, k].reshape(-1), minlength=len(used))
                some = mine >= 0
                word_step.step(mine[some], total[some, :WORD_SIZE], 5 * rate * pace)
                each = np.repeat(total[:, WORD_SIZE:] / np.maximum(many, 1)[:, None], many, axis=0)
                gram_step.step(flat[spans], each, 5 * rate * pace)
        logit = window_logits(net, _inputs(own, flat, cuts, word_vectors, gram_vectors), number, first)
    top = logit[_top(logit, row)]
    calibration = _platt(np.stack([top, np.log(np.bincount(row, minlength=len(size))), np.ones(len(size))], axis=1), labels)
    return Model({w: int(k) for w, k in zip(names, own, strict=True) if k >= 0}, {g: int(place[i]) for g, i in gram_numbers.items() if kept[i]}, word_vectors, gram_vectors, net, calibration)


def _platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, lightly regularised."""
    b = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * (b - np.array([1.0, 0, 0])))
        b = b + np.clip(step, -1, 1)
    return b


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.inputs = np.zeros((0, INPUTS), dtype=np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        if m.network is None:
            return np.full(len(texts), m.constant)
        words, first = [], [0]
        for t in texts:
            if t:
                words += _WORDS(t.lower())
            first.append(len(words))
        if len(self.known) > CACHE:
            self._forget()
        new = list(set(words).difference(self.known))
        self.known.update(zip(new, range(len(self.inputs), len(self.inputs) + len(new)), strict=True))
        self.inputs = np.concatenate([self.inputs, m.inputs(new)])
        number = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        # Only the words of this batch go through the input layer.
        used, at = np.unique(number, return_inverse=True)
        logit = window_logits(m.network, self.inputs[used], at, np.array(first))
        n = np.maximum(1, np.diff(first) - WINDOW + 1)
        top = np.maximum.reduceat(logit, np.cumsum(n) - n) if len(n) else logit
        return _sigmoid(np.stack([top, np.log(n), np.ones(len(n))], axis=1) @ m.calibration)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 3_000, max_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on documents that have a label."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_docs)
    text = F.struct(F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), "text")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("h", "id", "y").agg(F.min(text).alias("t")).select("h", "id", "y", "t.*")
    left, ids = max_bytes, []
    for x in found.select("h", "id", "size").orderBy("h", "id").collect():
        if x["size"] <= left:
            left -= x["size"]
            ids.append(x["id"])
    rows = found.where(F.col("id").isin(ids)).orderBy("h", "id").select("text", "y").toPandas()
    return train([t or "" for t in rows["text"]], (rows["y"].to_numpy() > 0).astype(np.int64) if len(rows) else np.zeros(0, dtype=np.int64))


ADDED = {"score": "double", "predicted": "int"}


@bw.tidied
def _scored(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, keep: list[int]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        for low, high, _, _ in bw.text_slices(batch.column(text_at)):
            got = scorer.score(batch.column(text_at).slice(low, high - low).to_pylist())
            yield pa.record_batch([*(batch.column(i).slice(low, high - low) for i in keep), pa.array(got, pa.float64()), pa.array(got >= 0.5).cast(pa.int32())], names=[*(batch.schema.names[i] for i in keep), *ADDED])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score and predicted; input columns with these names give way."""
    docs = docs.drop(*(c for c in ADDED if c in docs.columns and c != text_col))
    text_at = docs.columns.index(text_col)
    keep = [i for i in range(len(docs.columns)) if keep_text or i != text_at]
    return docs.mapInArrow(lambda it: _scored(it, model, text_at, keep), widened([docs.schema[i] for i in keep], ADDED))
