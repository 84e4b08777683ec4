"""Collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from bitext.llm import phrase_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, low, longest, top):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[2] if len(r) > 2 and r[2] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    some = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= low}
    inside = Counter()
    for (lang, w), a in some.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]] = max(inside[lang, w[i:i + k]], a)
    out = []
    for lang in n:
        found = []
        for (x, w), a in some.items():
            if x == lang and 100 * inside[x, w] < 100 * a:
                score, k = min((1000 * a * n[x] // (f[x, w[:k]] * f[x, w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), f[x, w[:k]], f[x, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def found(frame, rows, **more):
    return sorted(tuple(r) for r in phrase_counts.collocations(frame(rows), **more).collect())


@pytest.mark.parametrize("shards,bits", [(1, 1 << 20), (3, 1 << 20), (3, 1 << 9)])
def test_collocations_equal_brute_force(frame, shards, bits, monkeypatch):
    monkeypatch.setattr(phrase_counts, "HELD", 500)
    rng = random.Random(6)
    ends = [" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "\x0b", "-"]
    stock = ["In the middle of the night", "a b a b a b", "Ä É words der welt", "one two three four five six"]

    def text(n):
        return "".join(rng.choice(stock if rng.random() < .3 else "abcdefgh") + rng.choice(ends) for _ in range(n))
    rows = [(i, text(rng.randrange(40)), rng.choice(["en", "de", None, "und"])) for i in range(200)]
    rows += [(1000 + i, "a copy of one text, which is found often", "en") for i in range(100)]  # a hot group
    rows += [(None, None, "en"), (1, "", None), (2, " ,. \n", "fr"), (3, "x " * 30_000, "en"), (3, rows[3][1], "en"), (3, rows[3][1], "en")]
    want = brute(rows, 12, 5, 40)
    assert found(frame, rows, top=40, min_count=12, shards=shards, bits=bits) == want
    assert len({r[0] for r in want}) == 3


def test_shorter_phrases_only(frame):
    rows = [(i, "a b c d e. b c d", "en") for i in range(30)]
    assert found(frame, rows, min_count=5, longest=3) == brute(rows, 5, 3, 2000)


def test_empty(frame):
    assert found(frame, []) == []
    assert found(frame, [(1, None, "en"), (2, "too few words", "en")]) == []
