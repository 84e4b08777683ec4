"""Operators on documents against brute force, and their defined edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bitext.llm import (column_bwt, docstats, es_mixing, license_scan, lsa_decontam, maglev, odd_sketch,
                        pairwise_quality, risk_rules, string_kernel)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (5, "é #$ x\n\nx\nx"),
        (6, "a b c a b c a b"), (7, "word " * 30_000)]


def text(rng, n, vocab=2000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


# ------------------------------------------------------------------ counts, rules
def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:]))
    often, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force():
    rng = random.Random(1)
    texts = [t for _, t in EDGE] + ["".join(rng.choice("ab é\n#| ") for _ in range(rng.randrange(300))) for _ in range(200)]
    found = docstats.counts(pa.array(texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(found[c][i]) for c in names) for i in range(len(texts))] == [brute_counts(t) for t in texts]


def test_binomial_bound():
    assert risk_rules.binomial_cdf(2, 10, 0.3) == pytest.approx(
        sum(math.comb(10, i) * 0.3 ** i * 0.7 ** (10 - i) for i in range(3)))
    assert risk_rules.binomial_cdf(5, 5, 0.1) == 1.0
    assert risk_rules.certified([0, 0, 30], 500, 0.02, 0.01) == 2
    assert risk_rules.certified([0], 20, 0.02, 0.01) == 0  # too few labels to certify


def test_rules_edges_and_certified_cutoff(spark, frame):
    rng = random.Random(2)
    good = [(100 + i, text(rng, 80), "en") for i in range(900)]
    junk = [(5000 + i, " ".join(w + "%%%" for w in text(rng, 80).split()), "en") for i in range(50)]
    docs = frame([*EDGE, *good, *junk])
    labels = spark.createDataFrame([(d[0], 1) for d in good] + [(d[0], 0) for d in junk] + [(None, 1), (9, None), (10**9, 1)],
                                   "doc_id long, quality int")
    out = risk_rules.quality_verdicts(docs, labels).collect()
    assert len(out) == len(EDGE) + 950
    by = {r.doc_id: r for r in out}
    assert all(by[d[0]].kept for d in good) and not any(by[d[0]].kept for d in junk)
    assert by[1].n_words == 0 and by[1].base_failed and by[7].base_failed and not by[7].kept
    assert by[5000].rejected_by == ["symbols_per_word"]
    kept = risk_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in good}
    none = risk_rules.quality_verdicts(docs, labels.limit(0)).collect()
    assert all(r.kept for r in none if not r.base_failed)
    assert risk_rules.quality_verdicts(docs.limit(0), labels).count() == 0


# ------------------------------------------------------------------ near duplicates
def brute_groups(rows, k, num=80):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for i, t in rows:
        if i is not None:
            w = WORD.findall((t or "").translate(low))
            sets[i] = {tuple(w[j: j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,block_rows", [(2, 20_000), (5, 7)])
def test_near_duplicates_equal_brute_force(frame, k, block_rows):
    rng = random.Random(k)
    rows = list(EDGE) + [(8, "ONE"), (9, "a B"), (10, "A b")]
    base = text(rng, 150).split()
    for i in range(120):  # copies with more and more edits: similarities on both sides of the bound
        w = list(base)
        for _ in range(rng.randrange(1 + i // 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(500 + i, text(rng, 60)) for i in range(60)]
    out = odd_sketch.near_duplicates(frame(rows), words=k, block_rows=block_rows).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == brute_groups(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_no_task_gets_all_of_a_bucket(frame, monkeypatch, tmp_path):
    rng = random.Random(17)
    base, rows = text(rng, 200).split(), []
    for i in range(400):  # pages of one template, similarity about 0.7; every tenth has a near copy
        w = list(base)
        for j in rng.sample(range(200), 9):
            w[j] = f"p{i}x{j}"
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            w[rng.randrange(200)] = "edit"
            rows.append((1000 + i, " ".join(w)))
    real = odd_sketch._rest

    def counting(*args):
        inner, folder = real(*args), str(tmp_path)

        def run(batches):
            held = list(batches)
            often = Counter()
            for b in held:
                often.update(zip(*(b.column(c).to_pylist() for c in ("key", "tile" if "tile" in b.schema.names else "block"))))
            if often:
                with open(f"{folder}/{random.SystemRandom().random()}", "w") as out:
                    out.write(str(max(often.values())))
            yield from inner(iter(held))
        return run

    monkeypatch.setattr(odd_sketch, "_rest", counting)
    out = odd_sketch.near_duplicates(frame(rows), words=2, block_rows=20).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_groups(rows, 2)
    most = max(int(f.read_text()) for f in tmp_path.iterdir())
    assert 20 < most <= 80, most  # two blocks of about 20 rows


def test_bitmap_seldom_drops_a_link():
    rng, k, bits, n = np.random.default_rng(18), odd_sketch.BANDS * odd_sketch.ROWS, odd_sketch.SKETCH_BITS, 100_000
    most_bits = int(bits / 2 * (1 - math.exp(-4 * k * (1 - (0.8 - odd_sketch.SKETCH_SLACK)) / bits)))
    flips = np.repeat(np.arange(n), 2 * rng.binomial(k, 0.2, n)) * bits  # each minimum that differs flips two bits
    odd = np.bincount(flips + rng.integers(0, bits, len(flips)), minlength=n * bits).reshape(n, bits) & 1
    assert (odd.sum(axis=1) > most_bits).sum() <= 3


def test_near_duplicates_empty(frame):
    assert odd_sketch.near_duplicates(frame([])).count() == 0
    assert odd_sketch.near_duplicates(frame([(1, None), (2, "")])).count() == 2


# ------------------------------------------------------------------ repeated byte strings
def brute_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    starts = Counter(b[i: i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if starts[b[i: i + length]] > 1:
                gone[i: i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("max_group,chunk", [(100_000, 32_768), (3, 20)])
def test_repeats_equal_brute_force(frame, max_group, chunk):
    rng = random.Random(3)
    passage, texts = text(rng, 30), [t for _, t in EDGE] + ["ab" * 90, "For " * 60, "é" * 45]
    for _ in range(60):
        texts.append(text(rng, 20, 50) + rng.choice([" ", passage[: rng.randrange(len(passage))]]) + text(rng, 15, 50))
    texts += texts[-5:]
    out = column_bwt.remove_repeats(frame(list(enumerate(texts))), length=24, key=7, max_group=max_group, chunk=chunk).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts, 24)


def test_planted_passages_of_over_50_words(frame):
    """At the contract's length: a passage that two documents share goes when
    it has 400 bytes, whatever its words; n_bytes is the size before."""
    rng = random.Random(21)
    passages = [text(rng, n) for n in (51, 55, 60, 65, 70, 80, 100, 150)]
    texts = [text(rng, rng.randrange(80, 300)) for _ in range(24)]
    for p in passages * 2:
        texts.append("\n".join((text(rng, 70), p, text(rng, 70))))
    out = column_bwt.remove_repeats(frame(list(enumerate(texts)))).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts, column_bwt.LENGTH)
    assert all(got[i][1] == 0 and got[i][0] == len(texts[i]) for i in range(24))
    long = [len(p) >= column_bwt.LENGTH for p in passages]
    assert [got[24 + i][1] > 0 for i in range(16)] == long * 2 and 0 < sum(long) < len(long)


def brute_shared(texts, words):
    """Number of words in a run of ``words`` words that another row has too."""
    rows = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    grams = [[tuple(w[i: i + words]) for i in range(len(w) - words + 1)] for w in rows]
    owners = Counter(x for g in grams for x in set(g))
    return [len({j for i, x in enumerate(g) if owners[x] > 1 for j in range(i, i + words)}) for g in grams]


@pytest.mark.parametrize("max_group,chunk", [(100_000, 32_768), (3, 20)])
def test_shared_passages_equal_brute_force(frame, max_group, chunk):
    rng = random.Random(4)
    passage = text(rng, 40)
    texts = [t for _, t in EDGE] + ["x " * 90, "a b " * 60, "a b\t" * 30, passage + " . " + passage]
    for _ in range(60):
        part = passage[: rng.randrange(len(passage))]
        texts.append(text(rng, 20, 50) + " " + rng.choice([part, part.upper(), part.replace(" ", " \n ")]) + " " + text(rng, 15, 50))
    texts += texts[-5:] + [f"{t} {t}" for t in [text(rng, 40, 5000)]]
    docs = frame(list(enumerate(texts)))
    got = {r.doc_id: r for r in column_bwt.remove_repeats(
        docs, length=24, key=7, max_group=max_group, chunk=chunk, words=12).collect()}
    want = brute_shared(texts, 12)
    assert [got[i].n_shared_words for i in range(len(texts))] == want and 0 in want and want[-1] == 0
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == brute_cut(texts, 24)


def test_shared_passages_of_over_50_words_are_told(frame, tmp_path):
    """op3 tells every document with a passage of over 50 words that another
    has, also one of fewer than 400 bytes, which stays in the text."""
    rng = random.Random(22)
    passages = [text(rng, n) for n in (50, 51, 55, 60, 80, 150)]
    texts = [text(rng, rng.randrange(80, 300)) for _ in range(12)] + [
        "\n".join((text(rng, 70), p, text(rng, 70))) for p in passages * 2]
    frame(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in column_bwt.op3(frame([]).sparkSession, str(tmp_path)).collect()}
    assert [got[i].n_shared_words for i in range(24)] == [0] * 12 + [0, 51, 55, 60, 80, 150] * 2
    assert [tuple(got[i])[1:5] for i in range(24)] == brute_cut(texts, column_bwt.LENGTH)
    assert any(got[i].n_shared_words and not got[i].n_removed for i in range(12, 24))


def test_segments_of_an_anchor_are_counted(frame):
    """A header that one text has many times, between neighbours that differ,
    counts once a segment; equal segments of a periodic text count as two."""
    rng = random.Random(5)
    header = "=" * 4 + "Kq7" + "=" * 4
    many = "".join(header + text(rng, 6, 50) for _ in range(40))
    rows = [(i, i, i, t) for i, t in enumerate([many, "ab" * 300, text(rng, 40, 5000)])]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "h", "g", "text"])
    found = next(column_bwt._survey(24, 7)([batch])).column(5).to_pylist()
    sent = [len([x for x in b.column(6) if x.is_valid]) for b in column_bwt._segments(24, 7)([
        pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([t]), pa.array([[x["anchor"] for x in f]])],
                                   names=["h", "g", "text", "wanted"]) for (*_, t), f in zip(rows, found)])]
    total = [sum(x["n"] for x in f) for f in found]
    assert total[0] == sent[0] and max(x["n"] for x in found[0]) >= 30
    assert sent[1] <= total[1] <= 4 and total[2] == sent[2]


def test_bitmap_keeps_every_wanted_text(spark):
    rng = random.Random(6)
    hs = [rng.randrange(-1 << 63, 1 << 63) for _ in range(2000)] + [-1, 0, 1, column_bwt.BITS - 1, column_bwt.BITS, -column_bwt.BITS]
    docs = spark.createDataFrame([(h, 0, str(h)) for h in hs], "h long, g long, text string")
    some = docs.filter("abs(h % 10) = 1 or h in (0, -1, 1) or h % {0} in (0, {1})".format(column_bwt.BITS, column_bwt.BITS - 1))
    want = {r.h for r in some.collect()}
    kept = [tuple(r) for r in column_bwt._perhaps_in(docs, some).collect()]
    assert want <= {h for h, *_ in kept} and len(kept) < len(want) + 20 and len(kept) == len(set(kept))
    assert all(t == str(h) for h, _, t in kept)
    assert column_bwt._perhaps_in(docs, some.limit(0)).count() == 0


def test_repeats_empty(frame):
    assert column_bwt.remove_repeats(frame([])).count() == 0
    assert [r.n_removed for r in column_bwt.remove_repeats(frame([(None, None), (1, "x")])).collect()] == [0, 0]


# ------------------------------------------------------------------ decontamination
def test_copies_certify_nothing(spark, frame):
    """Rows of one id, and copies of one text, count once in a holdout."""
    rng = random.Random(12)
    junk = [(5000 + i, " ".join(w + "%%%" for w in text(rng, 80).split()), "en") for i in range(50)]
    one = text(rng, 80)
    labels = spark.createDataFrame([(i, 1) for i in range(900)] + [(d[0], 0) for d in junk], "doc_id long, quality int")
    for good in ([(7, one, "en")] * 900, [(i, one, "en") for i in range(900)], [(i % 100, text(rng, 80), "en") for i in range(900)]):
        counted = risk_rules.count_documents(frame([*good, *junk]))
        assert risk_rules.calibrate(counted, labels) == []
    good = [(i, text(rng, 80), "en") for i in range(900)]
    once = risk_rules.calibrate(risk_rules.count_documents(frame([*good, *junk])), labels)
    more = risk_rules.calibrate(risk_rules.count_documents(frame([*good, *good, *good[:1] * 500, *junk])), labels)
    assert once == more and once[0]["symbols_per_word"] is not None


def test_leaks(spark, frame):
    rng = random.Random(4)
    items = [(i, text(rng, 30, 5000)) for i in range(20)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    docs = [(i, text(rng, 400, 5000)) for i in range(100, 160)] + EDGE
    docs += [(200 + i, text(rng, 100, 5000) + " " + t.upper() + ". " + text(rng, 90, 5000)) for i, t in items[:8]]
    para = items[9][1].split()
    para[3:20:2] = ["other"] * 9  # 70 % of its words in order, its end word for word
    docs.append((50, text(rng, 70, 5000) + " " + " ".join(para) + " " + text(rng, 70, 5000)))
    found = lsa_decontam.find_leaks(frame(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(200 + i, i) for i in range(8)} | {(50, 9)}
    assert all(r.coverage == 1.0 for r in found if r.doc_id >= 200)
    blocks = lsa_decontam.find_leaks(frame(docs), bench, block_chars=1500).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == {(r.doc_id, r.item_id) for r in found}
    rest = lsa_decontam.without_leaks(frame(docs), bench)
    assert rest.count() == len(docs) - 9
    assert lsa_decontam.find_leaks(frame(docs), bench.limit(0)).count() == 0
    assert lsa_decontam.find_leaks(frame([]), bench).count() == 0


def test_short_and_unspaced_leaks(spark, frame, monkeypatch):
    rng = random.Random(14)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    kana = "".join(chr(0x3042 + rng.randrange(60)) for _ in range(6))
    items = [(0, "what is the capital of w77 land"), (1, han), (2, kana), (3, "w5 w6"), (4, "w5 w6"), (5, text(rng, 30))]
    bench = spark.createDataFrame([*items, (6, None), (7, " .,! ")], "item_id long, text string")
    other = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    docs = [(10, text(rng, 50) + " What is the capital, of w77 LAND? " + text(rng, 50)), (11, other + han + other),
            (12, other[:20] + kana + "。" + other[20:]), (13, "x w5 w6 y"), (14, "w5 w7 w6"), (15, "what is the w capital of w77 land"),
            (16, other), (17, items[5][1]), (18, None), (19, ""), (13, "x w5 w6 y")]
    found = sorted((r.doc_id, r.item_id, r.lcs, *((r.first_word, r.end_word) if r.lcs < 8 else ())) for r in lsa_decontam.find_leaks(frame(docs), bench).collect())
    assert found == [(10, 0, 7, 50, 57), (11, 1, 40), (12, 2, 6, 20, 26), *[(13, 3, 2, 1, 3)] * 2,
                     *[(13, 4, 2, 1, 3)] * 2, (17, 5, 30)]
    rest = {r.doc_id for r in lsa_decontam.without_leaks(frame(docs), bench).collect()}
    assert rest == {13, 14, 15, 16, 18, 19}  # two words are no leak to remove a document for
    only = bench.filter("item_id in (0, 3)")  # no item long enough for the latent space
    assert {(r.doc_id, r.item_id) for r in lsa_decontam.find_leaks(frame(docs), only).collect()} == {(10, 0), (13, 3)}


def test_whole_places_equal_brute_force():
    rng = np.random.default_rng(3)
    items = [(i, rng.integers(0, 4, rng.integers(1, 8)).astype(np.int32)) for i in range(300)]
    index = lsa_decontam.short_index(items)
    for n in (0, 1, 5, 60, 300):
        ids = rng.integers(-1, 4, n).astype(np.int32)
        want = {}
        for j, (_, w) in enumerate(items):
            at = next((k for k in range(n - len(w) + 1) if np.array_equal(ids[k: k + len(w)], w)), None)
            if at is not None:
                want[j] = at
        assert lsa_decontam.whole_places(ids, items, index) == want


def test_leaks_of_frequent_words(spark, frame):
    rng = random.Random(14)
    items = [(i, text(rng, 40, 5000)) for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, text(rng, 200, 5000)) for i in range(100, 160)]
    hot = text(rng, 80, 5000) + " " + items[0][1] + " " + text(rng, 80, 5000)
    docs += [(1000 + i, hot) for i in range(100)]  # every word of item 0 is in a tenth of the passages
    docs += [(10, text(rng, 90, 5000) + " " + items[0][1] + " " + text(rng, 70, 5000))]
    cut = items[0][1].split()
    del cut[4::5]  # 32 of 40 words
    docs += [(11, text(rng, 50, 5000) + " " + " ".join(cut) + " " + text(rng, 70, 5000))]
    found = lsa_decontam.find_leaks(frame(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, 0) for d in [10, 11, *range(1000, 1100)]}


def test_recall_against_brute_force(spark, frame, monkeypatch):
    """The cosine search alone, more items than RANK, short and long ones."""
    rng = random.Random(16)
    sizes = [rng.randrange(15, 60) for _ in range(280)] + [rng.randrange(1000, 3000) for _ in range(20)]
    items = [(i, text(rng, n, 5000)) for i, n in enumerate(sizes)]
    assert len(items) > lsa_decontam.RANK
    docs = [(i, text(rng, 200, 5000)) for i in range(1000, 1100)]
    for i, t in items[::10] + items[-20:]:
        docs.append((2000 + i, text(rng, rng.randrange(200), 5000) + " " + t + " " + text(rng, 90, 5000)))
        w = t.split()
        for j in rng.sample(range(len(w)), len(w) // 6):
            w[j] = f"w{rng.randrange(5000)}"
        docs.append((5000 + i, text(rng, rng.randrange(200), 5000) + " " + " ".join(w) + " " + text(rng, 90, 5000)))
    words = {i: t.split() for i, t in items}
    brute = set()
    for d, t in docs:
        seq = t.split()
        for i, w in words.items():
            if len(set(w) & set(seq)) < 0.5 * len(set(w)):
                continue
            masks = {}
            for k, x in enumerate(w):
                masks[x] = masks.get(x, 0) | 1 << k
            if lsa_decontam.lcs(masks, len(w), seq) >= 0.8 * len(w):
                brute.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in lsa_decontam.find_leaks(frame(docs), bench).collect()}
    assert brute and brute <= whole
    monkeypatch.setattr(lsa_decontam, "seed_index", no_seeds)
    found = {(r.doc_id, r.item_id) for r in lsa_decontam.find_leaks(frame(docs), bench).collect()}
    for long in (False, True):
        part = {(d, i) for d, i in brute if (sizes[i] >= 1000) == long}
        print("cosine recall, long items" if long else "cosine recall, short items", len(part & found), len(part))
        assert len(part & found) >= 0.9 * len(part)


def no_seeds(items, n_terms, coverage):
    """An index in which no item has runs."""
    return np.array([n_terms ** lsa_decontam.SEED], np.uint64), np.zeros(0, np.int64), np.ones(len(items), np.int64)


def test_seeds_find_every_cut_copy():
    rng = np.random.default_rng(15)
    items = [(i, rng.integers(0, 400, int(rng.integers(8, 300)), np.int32)) for i in range(60)]
    index = lsa_decontam.seed_index(items, 400, 0.8)
    group, want = [], []
    for i, (_, ids) in enumerate(items):
        ids = ids.copy()
        gone = rng.permutation(len(ids))[: len(ids) - math.ceil(0.8 * len(ids))]
        if i % 2:
            ids[gone] = -1
        else:
            ids = np.delete(ids, gone)
        before = rng.integers(-1, 400, int(rng.integers(0, 200)), np.int32)
        group.append((i, np.concatenate((before, ids, rng.integers(-1, 400, 90, np.int32)))))
        want.append(len(before))
    halves = [max(1, -(-len(v) // lsa_decontam.HALF)) for _, v in group]
    base = np.concatenate(([0], np.cumsum(halves)))
    found = set(zip(*(c.tolist() for c in lsa_decontam.seeded(group, base, items, index, 400))))
    for i, (_, ids) in enumerate(items):
        places = [p - base[i] for p, item in found if item == i and base[i] <= p < base[i + 1]]
        assert any(abs(p * lsa_decontam.HALF - want[i]) <= len(ids) + lsa_decontam.HALF for p in places)
    few = lsa_decontam.seeded(group, base, items, index, 400, most_hits=50)
    assert found == set(zip(*(c.tolist() for c in few)))


def test_lcs():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert lsa_decontam.lcs(masks, len(a), b) == row[-1]
        pairs = license_scan.align(a, b, 0, band=20)
        assert len(pairs) == row[-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


# ------------------------------------------------------------------ licences
def test_licences(frame):
    rng = random.Random(6)
    mit = license_scan.TEMPLATES["mit-permission"]
    near = mit.replace("free of charge", "free of any charge").replace("merge, ", "")
    docs = [*EDGE, (20, text(rng, 50) + " " + mit + " " + text(rng, 50)), (21, near), (22, text(rng, 300)),
            (23, "All rights reserved. x All rights reserved.")]
    found = license_scan.scan_licenses(frame(docs)).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {20, 21, 23} and len(by[23]) == 2
    assert by[20][0].template == "mit-permission" and by[20][0].coverage == 1.0
    assert 0.9 < by[21][0].coverage < 1 and len(by[21][0].spans) >= 2
    whole = docs[-4][1].lower().encode()[by[20][0].start_byte: by[20][0].end_byte].decode()
    assert whole.startswith("permission is hereby") and whole.endswith("the software")
    assert license_scan.scan_licenses(frame([])).count() == 0


# ------------------------------------------------------------------ classifiers
def test_quality_scores(spark, frame):
    rng = random.Random(7)
    good = [(i, text(rng, 60)) for i in range(100, 300)]
    bad = [(i, " ".join([f"w{rng.randrange(9)}"] * 60)) for i in range(300, 400)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    out = {r.doc_id: r for r in pairwise_quality.score_documents(frame([*EDGE, *good, *bad]), labels, F.col("doc_id") % 5 == 0).collect()}
    assert all(out[i].predicted == 1 for i, _ in good) and all(out[i].predicted == 0 for i, _ in bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values()) and 1 in out
    flat = pairwise_quality.score_documents(frame(EDGE), labels.limit(0), F.col("doc_id") % 5 == 0).collect()
    assert len(flat) == len(EDGE) and {r.score for r in flat} == {0.5}


def test_languages(frame):
    from pyspark.sql import functions as F
    rng = random.Random(8)
    sound = {"aa": "abcde ", "bb": "vwxyz ", "cc": "áéíóú "}
    docs = [(i, "".join(rng.choice(sound[lang]) for _ in range(80)), lang) for i, lang in enumerate([*sound] * 40, 100)]
    docs += [(1, None, "aa"), (2, "", "aa"), (3, "12 34 !", "bb"), (4, "abba", None), (4, "abba", None)]
    out = string_kernel.identify(frame(docs), F.col("doc_id") % 4 == 1).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == lang for i, _, lang in docs[:120])
    assert [by[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "aa"]
    assert {r.lang_pred for r in string_kernel.identify(frame(docs), F.lit(True)).collect()} == {"und"}
    assert string_kernel.identify(frame([]), F.lit(False)).count() == 0


# ------------------------------------------------------------------ mixing, sharding
def test_language_sample_is_bounded(frame, monkeypatch):
    """The collected sample keeps its bound, and a text repeated often trains once."""
    from pyspark.sql import functions as F
    rng = random.Random(18)
    seen = []
    fit = string_kernel.fit_ridge
    monkeypatch.setattr(string_kernel, "fit_ridge", lambda x, langs, n: seen.append(Counter(langs)) or fit(x, langs, n))
    docs = [(i, " ".join(rng.choice(("abc", "bcd", "dea", "eab")) + str(rng.randrange(10**6)) for _ in range(5)), "aa")
            for i in range(3000)]
    docs += [(9000, "vw xyz zz", "bb")] * 3000 + [(9001 + i, "vw xyz", "bb") for i in range(2000)]
    docs += [(20_000 + i, "áéí óú " + "éíóúá"[i] * 3, "cc") for i in range(5)]
    out = string_kernel.identify(frame(docs), F.lit(False), per_language=100).collect()
    assert len(out) == len(docs) and seen == [Counter({"aa": 100, "bb": 2, "cc": 5})]
    assert all(r.lang_pred == "bb" for r in out if 9000 <= r.doc_id < 20_000)


def test_mix(frame):
    rng = random.Random(9)
    docs = [(i, text(rng, rng.randrange(1, 40)), "en", rng.choice(["a", "b", "b", "b", "c", None])) for i in range(600)]
    docs += [(1000, None, "en", "d"), (1001, "", "en", "d"), (None, "x y", "en", "a"), (5, docs[5][1], "en", docs[5][3])]
    out = es_mixing.mix(frame(docs), ranges=16).collect()
    assert len(out) == len(docs)
    size = Counter()
    for _, t, _, s in docs:
        size[s] += len((t or "").split())
    names, left = sorted((s for s in size if s), key=str) + [None], 1.5 * sum(size.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:  # share by weight, fix what exceeds twice its source, share the rest
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * size[s]]
        for s in over or free:
            target[s] = 2.0 * size[s] if over else share[s]
        left -= sum(2 * size[s] for s in over)
        free -= set(over) if over else free
    source = {(size[s], round(target[s], 3)): s for s in names}
    taken = Counter()
    for r in out:
        s = source[r.source_size, round(r.target, 3)]
        taken[s] += r.taken
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 20 for s in names)
    assert sorted(map(str, out)) == sorted(map(str, es_mixing.mix(frame(docs)).collect()))
    assert es_mixing.mix(frame([])).count() == 0


def test_maglev(frame):
    names = maglev.shard_names(10)
    owner = maglev.lookup_table(names, 1009)
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    fewer = maglev.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 9)
    assert moved < 0.15 * 1009
    for bad in (1000, 1 << 21):
        with pytest.raises(ValueError):
            maglev.lookup_table(names, bad)
    out = maglev.place(frame(EDGE), names, 1009).collect()
    assert len(out) == len(EDGE)
    for r in out:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, owner[slot])
    assert maglev.place(frame([]), names).count() == 0


def test_pairwise_quality_learns_from_every_labelled_document(spark, frame, monkeypatch):
    """The differences hold each labelled training document, however many there are."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(pairwise_quality, "SAMPLE_ROWS", 10, raising=False)
    rows = [(i, ("fine words of a text, number " if i % 3 else "$$ ## ") * 8 + str(i)) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    seen, fit = [], pairwise_quality.fit_weights
    monkeypatch.setattr(pairwise_quality, "fit_weights", lambda d, *a: seen.append(d.count()) or fit(d, *a))
    out = pairwise_quality.score_documents(frame(rows), labels, F.col("doc_id") % 5 == 0).collect()
    assert seen == [96 * pairwise_quality.OPPONENTS]
    assert len(out) == 120 and all(r.predicted == int(r.doc_id % 3 > 0) for r in out)
    train = sorted(r.score for r in out if not r.held_out)
    assert train[31] < pairwise_quality.THRESHOLD <= train[32]  # 32 bad ones train
