"""Words and hashes in chunks: boundaries, long words, and the memory of very long texts."""

import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import bytewords as bw


def found(texts, gaps=bw.BLANKS, k=3):
    out = []
    for low, high, data, at in bw.text_slices(pa.array(texts), 200):
        starts, ends, first = bw.words(data, at, gaps)
        words = [data[s:e].tobytes() for s, e in zip(starts, ends)]
        own = bw.word_hashes(data, starts, ends)
        got, word, row = bw.window_hashes(own, first, k, short=True)
        out += [(low + int(r), tuple(words[w : min(w + k, first[r + 1])]), int(h)) for h, w, r in zip(got, word, row)]
    return out


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunks_do_not_show(monkeypatch, chunk):
    r = random.Random(chunk)
    texts = ["".join(r.choice("ab \n\té") for _ in range(r.choice([0, 1, 5, 60, 400]))) for _ in range(60)] + ["x" * 500, None, "", " ", "a", "a b", " a b c d "]
    want = found(texts)
    expect = []
    for i, t in enumerate(texts):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        expect += [(i, tuple(words[j : j + 3])) for j in range(max(len(words) - 2, len(words) > 0))]
    assert [(i, w) for i, w, _ in want] == expect
    monkeypatch.setattr(bw, "CHUNK", chunk)
    assert found(texts) == want
    by = {}
    for _, words, h in want:
        assert by.setdefault(words, h) == h
    assert len(set(by.values())) == len(by)


LONG = """
import resource, numpy as np, pyarrow as pa
from fieldloom.llm import bytewords as bw
size = 64 << 20
text = pa.array([(b"word and other text, " * (size // 21))], pa.large_binary()).cast(pa.large_string())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _, _, data, at in bw.text_slices(text):
    starts, ends, first = bw.words(data, at, bw.BLANKS)
    hashes = bw.word_hashes(data, starts, ends)
    got, word, row = bw.window_hashes(hashes, first, 5, short=True)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_very_long_text_takes_a_few_times_its_size():
    took = int(subprocess.run([sys.executable, "-c", LONG], capture_output=True, check=True, text=True).stdout)
    assert took < 640
