"""Benchmark decontamination by latent semantic retrieval (operator 6).

1. Words of benchmark passages are the terms.  Every document becomes its
   sequence of term numbers (-1: another word), written once.
2. Terms are weighted by their inverse frequency over all passages of all
   documents; no term weighs nothing, however frequent.
3. A randomised SVD of the benchmark's TF-IDF passages (a range finder with a
   power step, each product A'(A x) one Spark job over the passages) gives the
   latent space.
4. Overlapping passages of every document are projected into it, and their
   cosines with the passages of all benchmark items (cut in the same way) taken
   as one matrix product a block; an item has the cosine of its best passage.
   Places that share enough runs of SEED words with an item are candidates too,
   whatever their cosine: if COVERAGE of an item stands in a text in order, with
   the other words replaced or left out, they share at least that many runs.
5. Candidates are checked on words: the longest common subsequence must cover
   COVERAGE of the item, or PARAPHRASE of it when the item's answer (its last
   words) also stands in the passage word for word.

The benchmark is worked through in blocks of BLOCK_CHARS characters, so what
is broadcast is bounded whatever its size; documents are never broadcast.

6. Items of fewer than MIN_WORDS words are too short for coverage to mean
   anything: they are found where all their words stand one after another, by
   the hash of the sequence, then word for word; their cosine is null.

Cases: null and empty texts match nothing, nor do items without a word;
repeated documents or items are reported each; an empty benchmark gives an
empty result.  Words ignore case and ASCII punctuation; a character of a script
without spaces (Han, kana, Thai, Lao, Khmer, Burmese) is a word of its own.
``without_leaks`` keeps documents whose only finds are items of fewer than
``least_words`` words (REMOVE_WORDS): one to three words are found in texts that
never saw the benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.session import materialize

from . import textkit as tk
from .registry import query, table

#: Words of half a passage; passages overlap by one half.
HALF = 32
RANK, OVERSAMPLE = 256, 16
MIN_COSINE = 0.4
MIN_WORDS, REMOVE_WORDS = 8, 4
COVERAGE, PARAPHRASE = 0.8, 0.6
ANSWER_SHARE = 0.25
BLOCK_CHARS = 4_000_000
#: Words that a task projects at a time.
SLICE_WORDS = 8192
#: Words of a run that is looked up, and runs found that a task holds at a time.
SEED, SEED_HITS = 3, 1 << 20

LEAK = "doc_id long, item_id long, cosine double, lcs long, coverage double, answer boolean, first_word long, end_word long"
_NAMES = ["doc_id", "item_id", "cosine", "lcs", "coverage", "answer", "first_word", "end_word"]
_KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]


def _ids(vocab: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not len(vocab):
        return np.full(len(words), -1, np.int32)
    at = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
    return np.where(vocab[at] == words, at, -1).astype(np.int32)


def _number(vocab):
    def run(batches):
        terms = vocab.value
        for batch in batches:
            data, off = tk.plain_utf8(tk.apart(batch.column(1)))
            out = []
            for lo, hi in tk.slices(off):
                part, o = data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
                starts, ends, at = tk.pieces(part, o, tk.SPACE)
                ids = _ids(terms, tk.piece_hashes(part, starts, ends))
                out += [ids[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])
    return run


def _sequences(batch):
    """(row, its term numbers) of a batch of (doc_id, ids)."""
    for i, v in enumerate(batch.column(1)):
        yield i, np.frombuffer(v.as_buffer(), np.int32) if v.is_valid else np.zeros(0, np.int32)


def _frequencies(n_terms: int):
    def run(batches):
        df, passages = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            for _, ids in _sequences(batch):
                passages += -(-len(ids) // (2 * HALF))
                at = np.flatnonzero(ids >= 0)
                seen = np.unique(at // (2 * HALF) * n_terms + ids[at]) % n_terms
                np.add.at(df, seen, 1)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()),
                                          pa.array(np.append(df[some], passages), pa.int64())], names=["term", "df"])
    return run


def _cuts(ids: np.ndarray) -> list[np.ndarray]:
    """The overlapping passages of a text."""
    return [ids[s: s + 2 * HALF] for s in range(0, max(len(ids) - HALF, 1), HALF)]


def _products(model):
    """Partial A'(A x) over this task's passages, as rows (term, vector)."""
    def run(batches):
        weight, x = model.value
        total = np.zeros_like(x)
        for batch in batches:
            for _, ids in _sequences(batch):
                for cut in _cuts(ids):
                    terms, tf = np.unique(cut, return_counts=True)
                    keep = terms >= 0
                    terms, row = terms[keep], (tf[keep] * weight[terms[keep]])
                    row /= max(np.linalg.norm(row), 1e-12)
                    total[terms] += row[:, None] * (row @ x[terms])
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([r.tobytes() for r in total[used]], pa.binary())], names=["term", "v"])
    return run


def _summed(batches):
    """Adds up vectors of equal terms; rows are sorted by term."""
    term, vec = None, None
    for batch in batches:
        out_t, out_v = [], []
        for t, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = np.frombuffer(v.as_buffer(), np.float64)
            if t == term:
                vec = vec + v
                continue
            if term is not None:
                out_t.append(term)
                out_v.append(vec.tobytes())
            term, vec = t, v
        yield pa.RecordBatch.from_arrays([pa.array(out_t, pa.int32()), pa.array(out_v, pa.binary())], names=["term", "v"])
    if term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([term], pa.int32()), pa.array([vec.tobytes()], pa.binary())],
                                         names=["term", "v"])


def latent_space(passages: DataFrame, weight: np.ndarray, n_passages: int, rank: int = RANK) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the leading right singular vectors
    of the passages' TF-IDF matrix."""
    spark = passages.sparkSession

    def product(x: np.ndarray) -> np.ndarray:
        model = spark.sparkContext.broadcast((weight, x))
        rows = (passages.mapInArrow(_products(model), "term int, v binary").repartition("term")
                .sortWithinPartitions("term").mapInArrow(_summed, "term int, v binary").collect())
        out = np.zeros_like(x)
        for r in rows:
            out[r["term"]] = np.frombuffer(r["v"], np.float64)
        return out

    width = min(rank + OVERSAMPLE, n_passages, len(weight))
    q = np.linalg.qr(product(np.random.default_rng(0).standard_normal((len(weight), width))))[0]
    y = product(q)
    values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    lead = np.argsort(values)[::-1][:rank]
    lead = lead[values[lead] > 1e-9]
    return q @ turn[:, lead]


def lcs(masks: dict[int, int], n: int, seq) -> int:
    """Longest common subsequence of ``seq`` and an item of n words, given the
    item's positions of each word as bits (one machine word operation a step)."""
    full = (1 << n) - 1
    v = full
    for w in seq:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _runs(ids: np.ndarray, at: np.ndarray, n_terms: int) -> np.ndarray:
    """A number for the SEED terms from each place ``at`` on; numbers of other
    runs are equal only if n_terms ** SEED exceeds 64 bits."""
    code = np.zeros(len(at), np.uint64)
    for i in range(SEED):
        code = code * np.uint64(n_terms) + ids[at + i].astype(np.uint64)
    return code


def seed_index(items, n_terms: int, coverage: float):
    """(runs, sorted; keys run x item, sorted; runs that a copy of each item
    shares with it at least, if ``coverage`` of its words stand in order)."""
    runs = [np.unique(_runs(ids, np.arange(len(ids) - SEED + 1), n_terms)) for _, ids in items]
    owner = np.repeat(np.arange(len(items)), [len(r) for r in runs])
    flat, rank = np.unique(np.concatenate(runs), return_inverse=True)
    n = np.array([len(ids) for _, ids in items])
    lost = np.floor(n - coverage * n + 1e-9).astype(np.int64)
    return flat, np.sort(rank * len(items) + owner), np.maximum(n - lost - (SEED - 1) * (lost + 1), 1)


def seeded(group, base, items, index, n_terms: int, most_hits: int = SEED_HITS):
    """Arrays (passage, item) of the places in some documents that share enough
    runs with an item; ``base``: number of each document's first passage."""
    flat, keys, need = index
    ids = np.concatenate([v for _, v in group])
    sizes = [len(v) for _, v in group]
    doc, begin = np.repeat(np.arange(len(group)), sizes), np.concatenate(([0], np.cumsum(sizes)))
    known = ids >= 0
    known[max(0, len(known) - SEED + 1):] = False
    for i in range(1, SEED):
        known[:-i] &= (ids[i:] >= 0) & (doc[i:] == doc[:-i])
    at = np.flatnonzero(known)
    code = _runs(ids, at, n_terms)
    rank = np.minimum(np.searchsorted(flat, code), len(flat) - 1)
    at, rank = at[flat[rank] == code], rank[flat[rank] == code]
    n_items, length = len(items), np.array([len(v) for _, v in items])
    total = int((np.searchsorted(keys, (rank + 1) * n_items) - np.searchsorted(keys, rank * n_items)).sum())
    parts = max(1, -(-total // most_hits))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for part in range(parts):  # ranges of items
        a, b = part * n_items // parts, (part + 1) * n_items // parts
        lo, hi = np.searchsorted(keys, rank * n_items + a), np.searchsorted(keys, rank * n_items + b)
        count = hi - lo
        post = np.arange(count.sum()) + np.repeat(lo - np.cumsum(count) + count, count)
        item, place = keys[post] % n_items, np.repeat(at, count)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        last = np.arange(len(item)) + need[item] - 1
        first = np.flatnonzero(last < len(item))
        last = last[first]
        one = (item[first] == item[last]) & (doc[place[first]] == doc[place[last]])
        one &= place[last] - place[first] <= length[item[first]] + 2 * HALF
        first = first[one]
        d = doc[place[first]]
        out.append((base[d] + (place[first] - begin[d]) // HALF, item[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _holds(part: np.ndarray, answer: np.ndarray) -> bool:
    n = len(answer)
    if not n or len(part) < n:
        return False
    return any(np.array_equal(part[s: s + n], answer) for s in np.flatnonzero(part[: len(part) - n + 1] == answer[0]))


def short_index(items) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (hashes of the items of so many words, sorted; their numbers)."""
    out: dict[int, list] = {}
    for i, (_, ids) in enumerate(items):
        out.setdefault(len(ids), []).append((int(tk.windows(ids.astype(np.uint64), len(ids))[0]), i))
    return {n: tuple(np.array(c, t) for c, t in zip(zip(*sorted(v)), (np.uint64, np.int64))) for n, v in out.items()}


def whole_places(ids: np.ndarray, items, index) -> dict[int, int]:
    """Item number -> the first place where all its words stand in ``ids``."""
    found: dict[int, int] = {}
    known = np.concatenate(([0], np.cumsum(ids < 0)))
    for n, (codes, numbers) in index.items():
        here = np.flatnonzero(known[n:] == known[:-n]) if len(ids) >= n else []
        if not len(here):
            continue
        code = tk.windows(ids.astype(np.uint64), n)[here]
        lo, hi = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            at = int(here[k])
            for j in numbers[lo[k]: hi[k]].tolist():
                if j not in found and np.array_equal(ids[at: at + n], items[j][1]):
                    found[j] = at
    return found


def _search_short(model):
    def run(batches):
        items, index = model.value
        for batch in batches:
            of, rows = batch.column(0).to_pylist(), []
            for i, ids in _sequences(batch):
                for j, at in sorted(whole_places(ids, items, index).items()):
                    n = len(items[j][1])
                    rows.append((of[i], items[j][0], None, n, 1.0, True, at, at + n))
            columns = list(zip(*rows)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_NAMES)
    return run


def _search(model, coverage: float, paraphrase: float, min_cosine: float):
    def run(batches):
        project, items, targets, index = model.value  # terms x rank; (id, ids); their passages x rank; runs of items
        first_cut = np.cumsum([0] + [len(_cuts(ids)) for _, ids in items])[:-1]
        here = np.zeros(len(project) + 1, bool)  # the last place is that of other words (-1)
        masks = []
        for _, ids in items:
            m: dict[int, int] = {}
            for i, w in enumerate(ids.tolist()):
                m[w] = m.get(w, 0) | 1 << i
            masks.append(m)

        def check(ids, item, at, cosine):
            """The item in the passage at half ``at``, or None."""
            item_id, want = items[item]
            n = len(want)
            lo, hi = max(0, at * HALF - n), min(len(ids), (at + 2) * HALF + n)
            part = ids[lo:hi]
            here[part] = True
            bound = np.count_nonzero(here[want])
            here[part] = False
            if bound < paraphrase * n:  # no common subsequence can be longer
                return None
            found = lcs(masks[item], n, part[part >= 0].tolist())
            if found < paraphrase * n:
                return None
            answer = _holds(part, want[n - max(1, int(n * ANSWER_SHARE)):])
            if found < coverage * n and not answer:
                return None
            inside = np.flatnonzero(np.isin(part, want))
            return (item_id, cosine, found, found / n, answer, lo + int(inside[0]), lo + int(inside[-1]) + 1)

        def leaks(group):
            """Hits of some documents (row, ids), projected together."""
            halves = [max(1, -(-len(ids) // HALF)) for _, ids in group]
            base = np.concatenate(([0], np.cumsum(halves)))
            z = np.zeros((base[-1], project.shape[1]), np.float32)
            where, terms = [], []
            for (_, ids), b in zip(group, base):
                at = np.flatnonzero(ids >= 0)
                where.append(b + at // HALF)
                terms.append(ids[at])
            where, terms = np.concatenate(where), np.concatenate(terms)
            if not len(where):
                return
            first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            z[where[first]] = np.add.reduceat(project[terms], first, axis=0)
            both = z.copy()
            both[:-1] += z[1:]
            ends = base[1:] - 1
            both[ends] = z[ends]
            norm = np.linalg.norm(both, axis=1)
            some = np.flatnonzero(norm > 1e-6)
            cosine = both[some] @ targets.T / norm[some, None]
            if len(targets) > len(items):
                cosine = np.maximum.reduceat(cosine, first_cut, axis=1)
            w, j = np.nonzero(cosine >= min_cosine)
            row, item = seeded(group, base, items, index, len(project))
            found = np.unique(np.concatenate((some[w] * len(items) + j, row * len(items) + item)))
            row, item = found // len(items), found % len(items)
            at = np.minimum(np.searchsorted(some, row), max(len(some) - 1, 0))
            cosine = np.where(some[at] == row, cosine[at, item], 0.0) if len(some) else np.zeros(len(row))
            doc = np.searchsorted(base, row, "right") - 1
            best: dict[tuple[int, int], tuple] = {}
            for k in np.lexsort((row, -cosine, item, doc)).tolist():  # best cosine first
                d, j = int(doc[k]), int(item[k])
                old = best.get((d, j))
                if old and old[2] == len(items[j][1]):
                    continue  # whole already
                hit = check(group[d][1], j, int(row[k] - base[d]), float(cosine[k]))
                if hit and (old is None or (hit[2], hit[1]) > (old[2], old[1])):
                    best[d, j] = hit
            for (d, _), hit in best.items():
                yield group[d][0], hit

        for batch in batches:
            ids_of, rows, group, held = batch.column(0).to_pylist(), [], [], 0
            for row in _sequences(batch):
                if group and held + len(row[1]) > SLICE_WORDS:
                    rows += leaks(group)
                    group, held = [], 0
                group.append(row)
                held += len(row[1])
            if group:
                rows += leaks(group)
            columns = list(zip(*[(ids_of[i], *hit) for i, hit in rows])) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_NAMES)
    return run


def _block_leaks(docs: DataFrame, bench: DataFrame, rank: int, coverage: float, paraphrase: float,
                 min_cosine: float) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = bench.orderBy("item_id", "text").collect()
    words = tk.plain_words([r["text"] for r in rows])
    vocab = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
    worded = [(r["item_id"], _ids(vocab, w)) for r, w in zip(rows, words) if len(w)]
    items = [i for i in worded if len(i[1]) >= MIN_WORDS]
    short = [i for i in worded if len(i[1]) < MIN_WORDS]
    if not worded:
        return spark.createDataFrame([], LEAK)
    terms = sc.broadcast(vocab)
    numbered = materialize(docs.mapInArrow(_number(terms), "doc_id long, ids binary"), "lsa-ids")
    whole = numbered.mapInArrow(_search_short(sc.broadcast((short, short_index(short)))), LEAK) if short else None
    if not items:
        return whole
    passages = materialize(bench.select("item_id", "text").mapInArrow(_number(terms), "doc_id long, ids binary"), "lsa-items")

    counts = {r["term"]: r["df"] for r in numbered.mapInArrow(_frequencies(len(vocab)), "term int, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()}
    n = counts.pop(-1, 0)
    df = np.zeros(len(vocab))
    df[list(counts)] = list(counts.values())
    weight = np.log((n + 1) / (df + 1)) + 1.0

    basis = latent_space(passages, weight, sum(max(1, -(-len(i) // HALF)) for _, i in items), rank)
    project = (weight[:, None] * basis).astype(np.float32)
    targets = np.array([project[cut].sum(axis=0) for _, i in items for cut in _cuts(i)])
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)
    model = sc.broadcast((project, items, targets, seed_index(items, len(vocab), coverage)))
    found = numbered.mapInArrow(_search(model, coverage, paraphrase, min_cosine), LEAK)
    return found if whole is None else found.unionByName(whole)


def find_leaks(docs: DataFrame, bench: DataFrame, rank: int = RANK, coverage: float = COVERAGE,
               paraphrase: float = PARAPHRASE, min_cosine: float = MIN_COSINE,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id,
    item_id, cosine, lcs (words), coverage of the item, answer (found word for
    word), first_word and end_word of the place."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = bench.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"),
                                                    F.col("text").cast("string").alias("text"))
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        part = _block_leaks(docs, bench.filter(block == b) if blocks > 1 else bench, rank, coverage, paraphrase, min_cosine)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, bench: DataFrame, least_words: int = REMOVE_WORDS, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found; items of fewer
    than ``least_words`` words do not count."""
    leaks = find_leaks(docs, bench, **options).filter(F.col("lcs") >= least_words)
    bad = materialize(leaks.select(F.col("doc_id").alias("_leak")).distinct(), "lsa-leaks")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_leak"]), "left_anti")


@query("op6_lsa_decontam")
def op6(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
