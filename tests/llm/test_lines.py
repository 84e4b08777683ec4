"""Line dedup against brute force, and its hash."""

import random
from collections import defaultdict

import numpy as np
import pytest

from bitext.llm import line_hash

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANK).translate(LOWER)


def brute(rows, chars, docs):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars and d is not None:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= docs and d != max(holders[key(x)]))]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(frame, rows, **more):
    return sorted((tuple(r) for r in line_hash.dedup_lines(frame(rows), **more).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h, f = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 32, n, np.uint32)
    if n > 10:
        h[1], f[1] = h[0], f[0] + np.uint32(1)  # 64 bits agree, the others differ
    index = line_hash.Index(*line_hash.build_index(h, f))
    assert sorted(index.numbers(h, f).tolist()) == list(range(n))


@pytest.mark.parametrize("shard_keys", [1 << 17, 40])
def test_lines_equal_brute_force(frame, shard_keys):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcé Z") for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    rows = [(i, "\n".join(rng.choice(pool).join(("", rng.choice(["", " ", "\t", "\r", "\x0b"])))
                          for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    rows += [(200 + i, "The very common header line\n" * 3 + pool[i % 7]) for i in range(150)]  # a hot line
    rows += [(None, "the very common header line\nown"), (None, pool[3]), (7, rows[7][1]), (7, "the VERY common header line "),
             (7, None), (8, ""), (900, "\n\n \n"), (901, "\n".join(pool * 300)), (902, "é" * 12), (903, "é" * 11)]
    rows += [(910 + i, "é" * 12 + "\n" + "é" * 11) for i in range(5)]
    rng.shuffle(rows)
    assert found(frame, rows, min_chars=12, min_docs=3, shard_keys=shard_keys) == brute(rows, 12, 3)


def test_only_null_ids_hold_a_key(frame):
    rows = [(None, "a line that is long enough")] * 6 + [(None, None), (1, "x")]
    assert found(frame, rows, min_chars=10, min_docs=2) == brute(rows, 10, 2)


def test_empty(frame):
    assert found(frame, []) == []
