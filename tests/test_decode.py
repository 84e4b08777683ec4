"""Beam search, language model and sub-words against plain versions."""

import itertools
import math
import random
from collections import Counter

import pytest

from bitext.operators import decode, subwords
from bitext.operators.lexicon import top_k, translate_tokens
from tests import refimpl as R

TEXTS = [(1, "a b a"), (2, "b a"), (3, ""), (4, None), (5, "A, b! c"), (6, "b a")]


def plain_model(texts):
    counts = Counter()
    for _, t in texts:
        w = R.tokens(t or "")
        if w:
            counts.update(zip(["<s>", *w], [*w, "</s>"]))
    seen, own = Counter(), Counter()
    for (a, b), n in counts.items():
        seen[a] += n
        own[b] += n
    size = sum(own.values()) + len(own) + 1
    out = {(a, b): math.log(n / seen[a]) for (a, b), n in counts.items()}
    out |= {(None, b): math.log((n + 1) / size) for b, n in own.items()}
    return out, -math.log(size)


def test_language_model(spark):
    got = decode.fit_language_model(spark.createDataFrame(TEXTS, "k long, t string"), "t").collect()
    want, _ = plain_model(TEXTS)
    assert {(r.context, r.word) for r in got} == set(want)
    assert all(math.isclose(r.logp, want[r.context, r.word], abs_tol=1e-12) for r in got)


def every_path(lattice, known, weight):
    """All translations by descending score."""
    out = []
    for path in itertools.product(*lattice):
        score, before = 0.0, "<s>"
        for w, p, own in path:
            score += p + weight * known.get((before, w), math.log(decode.BACKOFF) + own)
            before = w
        score += weight * known.get((before, "</s>"), math.log(decode.BACKOFF) + known.get((None, "</s>"), 0.0))
        out.append((" ".join(w for w, _, _ in path), score))
    return sorted(out, key=lambda x: -x[1])


def test_wide_beam_finds_the_best_of_all_paths():
    rng = random.Random(1)
    for n in range(1, 6):
        lattice = [[(f"w{rng.randrange(6)}", -rng.random(), -3 * rng.random()) for _ in range(3)] for _ in range(n)]
        known = {(a, b): -2 * rng.random() for a in ["<s>", *(f"w{i}" for i in range(6))]
                 for b in [*(f"w{i}" for i in range(6)), "</s>"] if rng.random() < .5} | {(None, "</s>"): -1.0}
        got, want = decode.beam_search(lattice, known, 3**n, 0.5), every_path(lattice, known, 0.5)
        assert [round(s, 9) for _, s in got] == [round(s, 9) for _, s in want]
        assert got[0][0] == want[0][0]


@pytest.fixture(scope="module")
def lexicon(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", f"t{j}", rng.random()) for i in range(8) for j in range(8) if rng.random() < .8]
    return spark.createDataFrame([*rows, ("s1", "t0", 0.0)], "src_token string, tgt_token string, p double")


ROWS = [(1, "s1 s2 s3"), (2, "s4 unknown s5 s1 s2"), (3, ""), (4, None), (5, "s7"), (6, "s1 s2 s3")]


def test_beam_of_one_without_model_is_word_for_word(spark, lexicon):
    df = spark.createDataFrame(ROWS, "k long, t string")
    got = {r.k: r.translation for r in decode.beam_rows(df, "k", "t", lexicon, None, beam=1).collect()}
    want = {r.k: r.translation for r in translate_tokens(df, "k", "t", lexicon).collect()}
    assert got == want


def test_beam_translate_equals_all_paths(spark, lexicon):
    df = spark.createDataFrame(ROWS, "k long, t string")
    texts = [(i, " ".join(f"t{(i * j) % 8}" for j in range(5))) for i in range(9)] + [(20, "unknown t1")]
    model = decode.fit_language_model(spark.createDataFrame(texts, "k long, t string"), "t")
    known, unseen = plain_model(texts)
    best = {}
    for r in top_k(lexicon, 3).orderBy("rank").collect():
        best.setdefault(r.src_token, []).append((r.tgt_token, math.log(max(r.p, 1e-12)), known.get((None, r.tgt_token), unseen)))
    got = {}
    for r in decode.beam_translate(df, "k", "t", lexicon, model, beam=400, candidates=3).orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append((r.translation, r.score))
    assert set(got) == {1, 2, 5, 6}
    for k, t in ROWS:
        if k in got:
            want = every_path([best.get(w, [(w, 0.0, unseen)]) for w in t.split()], known, decode.LM_WEIGHT)
            assert [round(s, 7) for _, s in got[k]] == [round(s, 7) for _, s in want]
            assert got[k][0][0] == want[0][0]


def test_search_holds_one_text_at_a_time():
    """A text's positions and bigrams are rows, so that a batch of rows has a
    bounded size; texts may be cut by batches anywhere."""
    import pyarrow as pa
    rng = random.Random(8)
    texts, rows = {}, []
    for k in (*range(7), None):
        lattice = [[(w, -rng.random(), -rng.random()) for w in rng.sample("abcdef", rng.randrange(1, 4))] for _ in range(rng.randrange(1, 6))]
        known = {(x, y): -rng.random() for x in ["<s>", *"abc"] for y in [*"abcdef", "</s>"]} if k is not None else {}
        texts[k] = decode.beam_search(lattice, known | {(None, "</s>"): -2.0}, 3, 0.5)
        rows += [(k, i, *map(list, zip(*c)), None, None, None) for i, c in enumerate(lattice)]
        rows += [(k, None, None, None, None, c, n, lp) for (c, n), lp in known.items()]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.string(), pa.float64()]
    whole = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["k", "_i", "_w", "_p", "_u", "_c", "_n", "_l"])
    for size in (1, 3, 50, 10_000):
        found = list(decode._search("k", 3, 0.5, -2.0)(iter(whole.slice(a, size) for a in range(0, len(rows), size))))
        got = [r for b in found for r in b.to_pylist()]
        assert [(r["k"], r["rank"], r["translation"], r["score"]) for r in got] == [
            (k, i + 1, *x) for k, xs in texts.items() for i, x in enumerate(xs)]


def test_subwords_round_trip_and_second_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    texts = ["", "Hello  world\n\t", "né <|endoftext|> 北京 🙂", "x" * 5000, " ".join(map(str, range(3000)))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "k long, t string")
    got = {r.k: r for r in subwords.encode_subwords(df, "t", "ids").withColumn("back", subwords.subword_text("ids")).collect()}
    assert [got[i].back for i in range(len(texts) + 1)] == [*texts, ""]
    import public_tokenizers as P
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [got[i].ids for i in range(len(texts))] == [other.encode_ordinary(t) for t in texts]


def test_subword_pairs_are_padded_and_masked(spark):
    df = spark.createDataFrame([(1, "one two three four", "one"), (2, None, "one two three four five six seven")],
                               "k long, s string, t string")
    r = subwords.encode_subword_pairs(df, "s", "t", 6, 50257, 50256).orderBy("k").collect()
    assert [len(x[c]) for x in r for c in ("input_ids", "labels", "attention_mask")] == [6] * 6
    assert r[0].attention_mask == [1, 1, 1, 1, 1, 0] and r[0].labels[2:] == [-100] * 4
    assert r[1].input_ids[0] == 50256 and r[1].attention_mask == [1, 0, 0, 0, 0, 0] and r[1].labels[-1] == 50256


def test_large_vocabulary_files_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(subwords, "MAX_FILE_BYTES", 3)
    (tmp_path / "v.json").write_text("four")
    with pytest.raises(ValueError):
        subwords.read_vocabulary(str(tmp_path / "v.json"))


def test_subwords_work_on_bounded_pieces():
    import pandas as pd
    texts = pd.Series(["ab " * 50, None, "", "x" * 900, *["word "] * 300])
    pieces = list(subwords._pieces(texts, 200))
    assert pd.concat(pieces).index.tolist() == texts.index.tolist()
    assert all(sum(len(x or "") for x in p) <= 200 + max(len(x or "") for x in p) for p in pieces)
    assert max(len(p) for p in pieces if len(p.iloc[-1] or "") == 5) <= 41


def test_subword_columns_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(subwords, "PIECE", 64)
    rows = [(i, None if i % 7 == 0 else f"Größe {i} " * (i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    got = {r.k: r.back for r in subwords.encode_subwords(df, "t", "ids").withColumn("back", subwords.subword_text("ids")).collect()}
    assert got == {k: t or "" for k, t in rows}
