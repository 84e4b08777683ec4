"""Lexicon, translation, round-trip, pivot and augmentation plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS_CLASS
from ..operators import metrics as M
from ..operators.decode import BACKOFF, LEAST_P, LM_WEIGHT, beam_rows, beam_translate, fit_language_model
from ..operators.lexicon import BAND, BEAM, fit_lexicon, fit_lexicons, top_k
from ..operators.pairs import clean_pairs, turn_chains, turn_pairs
from ..operators.similarity import dense_cosine, token_cosine, with_token_cosine
from ..operators.split import SEED, TEST_SIZE, split_exact
from ..operators.sketch import BINS, merge_sketches, score_sketch, sketch_quantiles, sketch_threshold
from ..operators.synth import THRESHOLD, augment, compose_pivot, gate_blank, gate_stats
from ..operators.translate import map_rows, translate
from ..operators.wordvec import fit_sentence_vectors, vector_similarity
from ..session import materialize
from ..sources.tables import load_table
from . import sqlparts as S
from .encoding import pairs_of
from .registry import query

EM_ITERS = 5


def lexicons(spark: SparkSession, data_dir: str, iterations: int = EM_ITERS, best: int | None = None):
    """Forward (user→assistant) and backward lexicons from the conversation pairs."""
    return fit_lexicons(pairs_of(spark, data_dir), "pair_id", "src", "tgt", iterations, BAND, best=best)


def _em(prefix, src, tgt, iters=EM_ITERS):
    return S.em_ctes(prefix, "pairs", "pair_id", src, tgt, iters, BAND)


_FWD_SQL, _FWD = _em("fw", "src", "tgt")
_BWD_SQL, _BWD = _em("bw", "tgt", "src")


@query("fit_lexicon", sql=f"""
WITH {S.turn_pairs_cte()},
{_FWD_SQL}
SELECT e AS src_token, f AS tgt_token, round(p, 6) AS p FROM {_FWD}
""")
def q_fit_lexicon(spark: SparkSession, data_dir: str) -> DataFrame:
    """IBM Model 1 over whole turn texts."""
    pairs = pairs_of(spark, data_dir)
    lex = fit_lexicon(pairs, "pair_id", "src", "tgt", EM_ITERS, BAND)
    return lex.select("src_token", "tgt_token", F.round("p", 6).alias("p"))


@query("lexicon_top_k", sql=f"""
WITH {S.turn_pairs_cte()},
{_FWD_SQL}
SELECT src_token, tgt_token, rank, p FROM (
  SELECT e AS src_token, f AS tgt_token, round(p, 6) AS p,
         row_number() OVER (PARTITION BY e ORDER BY round(p, 9) DESC, f ASC) AS rank FROM {_FWD})
WHERE rank <= {BEAM}
""")
def q_lexicon_top_k(spark: SparkSession, data_dir: str) -> DataFrame:
    """The best translations of every source word (as many as the beam is wide)."""
    best = top_k(fit_lexicon(pairs_of(spark, data_dir), "pair_id", "src", "tgt", EM_ITERS, BAND, best=BEAM), BEAM)
    return best.select("src_token", "tgt_token", F.col("rank").cast("long").alias("rank"), F.round("p", 6).alias("p"))


@query("lexicon_translate", sql=f"""
WITH {S.turn_pairs_cte()},
{_FWD_SQL},
{S.best_cte('best', _FWD)},
{S.translate_cte('tr', 'pairs', 'pair_id', 'src', 'best')}
SELECT p.pair_id, p.src, t.translation FROM pairs p JOIN tr t ON t.pair_id = p.pair_id
""")
def q_lexicon_translate(spark: SparkSession, data_dir: str) -> DataFrame:
    pairs = pairs_of(spark, data_dir)
    lex = fit_lexicon(pairs, "pair_id", "src", "tgt", EM_ITERS, BAND, best=1)
    return translate(pairs.select("pair_id", "src"), "src", lex, "translation", key="pair_id")


_LM_SQL = S.language_model_ctes("lm", "pairs", "tgt")


@query("language_model", sql=f"""
WITH {S.turn_pairs_cte()},
{_LM_SQL}
SELECT context, word, count, round(logp, 6) AS logp FROM lm
""")
def q_language_model(spark: SparkSession, data_dir: str) -> DataFrame:
    """Bigrams with back-off of the target side of the pairs."""
    model = fit_language_model(pairs_of(spark, data_dir), "tgt")
    return model.select("context", "word", "count", F.round("logp", 6).alias("logp"))


@query("lexicon_beam", sql=f"""
WITH RECURSIVE {S.turn_pairs_cte()},
{_FWD_SQL},
{_LM_SQL},
{S.beam_ctes('bm', 'pairs', 'pair_id', 'src', _FWD, 'lm', BEAM, LM_WEIGHT, BACKOFF, LEAST_P)}
SELECT pair_id, CAST(rank AS INTEGER) AS rank, translation, round(score, 6) AS score FROM bm
""")
def q_lexicon_beam(spark: SparkSession, data_dir: str) -> DataFrame:
    """The five best translations of each source text, with the beam of five."""
    pairs = pairs_of(spark, data_dir)
    lex = fit_lexicon(pairs, "pair_id", "src", "tgt", EM_ITERS, BAND, best=BEAM)
    best = beam_translate(pairs, "pair_id", "src", lex, fit_language_model(pairs, "tgt"))
    return best.select("pair_id", "rank", "translation", F.round("score", 6).alias("score"))


_DOCS = "docs AS (SELECT doc_id, lang, text FROM documents)"
_ROUND_TRIP_SQL = f"""{S.turn_pairs_cte()},
{_FWD_SQL},
{_BWD_SQL},
{S.best_cte('bf', _FWD)},
{S.best_cte('bb', _BWD)},
{_DOCS},
{S.translate_cte('fwd', 'docs', 'doc_id', 'text', 'bf')},
synth AS (SELECT d.doc_id, d.lang, d.text, f.translation AS synthetic FROM docs d JOIN fwd f ON f.doc_id = d.doc_id),
{S.translate_cte('back', 'synth', 'doc_id', 'synthetic', 'bb')},
rt AS (SELECT s.doc_id AS pair_id, s.lang, s.text, s.synthetic, b.translation AS back
       FROM synth s JOIN back b ON b.doc_id = s.doc_id),
{S.token_cosine_cte('rsim', 'rt', 'text', 'back')},
scored AS (SELECT r.pair_id AS doc_id, r.lang, r.text, r.synthetic, s.similarity
           FROM rt r JOIN rsim s ON s.pair_id = r.pair_id)"""


def round_trip_docs(spark: SparkSession, data_dir: str, beam: int | None = None) -> DataFrame:
    """Documents → forward translation → back translation → token cosine of
    original and back translation → ``(doc_id, lang, text, synthetic, similarity)``.
    With ``beam`` both translations are beam searches with language models of
    the two sides of the pairs; without, word for word."""
    fwd, bwd = lexicons(spark, data_dir, best=1 if beam is None else BEAM)  # all that the translations read
    if beam is not None:
        pairs = pairs_of(spark, data_dir)
        to, fro = (fit_language_model(pairs, side) for side in ("tgt", "src"))
        docs = load_table(spark, data_dir, "documents").select("doc_id", "lang", "text")
        synth = materialize(beam_rows(docs, "doc_id", "text", fwd, to, "synthetic", beam=beam), "rt-forward")
        back = beam_rows(synth, "doc_id", "synthetic", bwd, fro, "back", beam=beam)
        return synth.join(with_token_cosine(back, "doc_id", "text", "back").select("doc_id", "similarity"), "doc_id")
    docs = load_table(spark, data_dir, "documents").select("doc_id", "lang", "text")
    # the forward output is read twice (result, back-translation input):
    # written once so the forward translation runs once
    synth = materialize(translate(docs, "text", fwd, "synthetic", key="doc_id"), "rt-forward")
    back = translate(synth.select("doc_id", "synthetic"), "synthetic", bwd, "back", key="doc_id")
    sims = with_token_cosine(docs.join(back, "doc_id"), "doc_id", "text", "back").select("doc_id", "similarity")
    return synth.join(sims, "doc_id")


@query("round_trip", sql=f"""
WITH {_ROUND_TRIP_SQL}
SELECT doc_id, lang, CASE WHEN similarity >= {THRESHOLD} THEN synthetic ELSE '' END AS synthetic,
       round(similarity, 6) AS similarity
FROM scored
""")
def q_round_trip(spark: SparkSession, data_dir: str) -> DataFrame:
    """The generator job: translate the monolingual corpus, translate back,
    score, blank targets under 0.70 (rows are kept)."""
    scored = gate_blank(round_trip_docs(spark, data_dir), "synthetic", "similarity", THRESHOLD)
    return scored.select("doc_id", "lang", "synthetic", F.round("similarity", 6).alias("similarity"))


@query("augment", sql=f"""
WITH {_ROUND_TRIP_SQL}
SELECT 'real' AS origin, pair_id AS id, src, tgt FROM pairs
UNION ALL
SELECT 'synthetic', CAST(doc_id AS VARCHAR), text, synthetic FROM scored
WHERE similarity >= {THRESHOLD} AND synthetic IS NOT NULL AND synthetic <> ''
""")
def q_augment(spark: SparkSession, data_dir: str) -> DataFrame:
    """Real pairs ∪ accepted synthetic pairs, tagged by origin."""
    real = pairs_of(spark, data_dir).select(F.col("pair_id").alias("id"), "src", "tgt")
    synth = gate_blank(round_trip_docs(spark, data_dir), "synthetic", "similarity", THRESHOLD).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("src"), F.col("synthetic").alias("tgt"), "similarity")
    out = augment(real, synth, "src", "tgt", None, "similarity", "id")
    return out.select("origin", "id", "src", "tgt")


@query("dense_cosine", sql="""
SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
       / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))
              * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def q_dense_cosine(spark: SparkSession, data_dir: str) -> DataFrame:
    """Vector n (original) against vector n+1 (round trip): normalise, dot."""
    e = load_table(spark, data_dir, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    j = dense_cosine(a.join(b, "vec_id"), "a", "b", "similarity")
    return j.select("vec_id", F.round("similarity", 6).alias("similarity"))


_THS = [round(0.1 * k, 1) for k in range(1, 10)]


@query("gate_stats", sql=f"""
WITH sims AS (
  SELECT a.label, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
       / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))
              * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
ths AS (SELECT unnest(CAST({_THS} AS DOUBLE[])) AS threshold)
SELECT s.label, t.threshold, count(*) FILTER (WHERE s.similarity >= t.threshold) AS accepted,
       count(*) FILTER (WHERE NOT (s.similarity >= t.threshold) OR s.similarity IS NULL) AS rejected,
       round(CAST(count(*) FILTER (WHERE s.similarity >= t.threshold) AS DOUBLE) / count(*), 6) AS acceptance_rate,
       round(avg(s.similarity), 6) AS mean_sim,
       round(quantile_cont(round(s.similarity, 3), 0.1), 6) AS p10,
       round(quantile_cont(round(s.similarity, 3), 0.5), 6) AS p50,
       round(quantile_cont(round(s.similarity, 3), 0.9), 6) AS p90
FROM sims s, ths t GROUP BY s.label, t.threshold
""")
def q_gate_stats(spark: SparkSession, data_dir: str) -> DataFrame:
    """Acceptance per label of the original vector at thresholds 0.1 … 0.9."""
    e = load_table(spark, data_dir, "embeddings")
    a = e.select("vec_id", "label", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    sims = dense_cosine(a.join(b, "vec_id"), "a", "b", "similarity").select("label", "similarity")
    st = gate_stats(sims, ["label"], _THS)
    return st.select("label", "threshold", "accepted", "rejected",
                     *[F.round(c, 6).alias(c) for c in ("acceptance_rate", "mean_sim", "p10", "p50", "p90")])


_PAIRINGS = (("next", 1), ("second", 2))
_ACCEPT = 5


@query("gate_sketch", sql=f"""
WITH sims AS (
  SELECT s.strategy, a.label, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
       / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))
              * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS similarity
  FROM (VALUES ('next', 1), ('second', 2)) s(strategy, k), embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + s.k),
grouped AS (SELECT strategy, label, similarity FROM sims UNION ALL SELECT strategy, NULL, similarity FROM sims),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY strategy, label ORDER BY similarity) AS r,
         count(*) OVER (PARTITION BY strategy, label) AS n FROM grouped),
steps AS (SELECT *, least({BINS} - 1, greatest(0, floor((similarity + 1) * {BINS // 2}))) AS bin FROM ranked),
limits AS (
  SELECT strategy, label, n, coalesce(max(bin) FILTER (WHERE r = n - {_ACCEPT} + 1), 0) AS cut,
         {", ".join(f"max(bin) FILTER (WHERE r = (n * {p} + 99) // 100) AS b{p}" for p in (10, 50, 90))}
  FROM steps GROUP BY strategy, label, n)
SELECT l.strategy, l.label, l.n, {", ".join(f"-1 + (l.b{p} + 0.5) * CAST(2 AS DOUBLE) / {BINS} AS p{p}" for p in (10, 50, 90))},
       -1 + l.cut * CAST(2 AS DOUBLE) / {BINS} AS threshold,
       (SELECT count(*) FROM steps s WHERE s.strategy = l.strategy AND s.label IS NOT DISTINCT FROM l.label
          AND s.bin >= l.cut) AS accepted
FROM limits l
""")
def q_gate_sketch(spark: SparkSession, data_dir: str) -> DataFrame:
    """Similarities by (strategy, label) kept as one written sketch a strategy,
    as runs on different days would; quantiles and the threshold that accepts
    N pairs come from the sketches merged, per label and over all labels."""
    e = load_table(spark, data_dir, "embeddings")
    a = e.select("vec_id", "label", F.col("embedding").alias("a"))
    kept = []
    for strategy, k in _PAIRINGS:
        b = e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias("b"))
        sims = dense_cosine(a.join(b, "vec_id"), "a", "b", "similarity")
        kept.append(materialize(score_sketch(sims.withColumn("strategy", F.lit(strategy)), ["strategy", "label"]), "gate-sketch"))
    by_label = merge_sketches(kept, ["strategy", "label"])
    overall = merge_sketches(kept, ["strategy"]).withColumn("label", F.lit(None).cast(e.schema["label"].dataType))
    every = by_label.unionByName(overall)
    keys = ["strategy", "label"]
    q, t = sketch_quantiles(every, keys), sketch_threshold(every, keys, _ACCEPT)
    t = t.select(F.col("strategy").alias("_s"), F.col("label").alias("_l"), "threshold", "accepted")
    return (q.join(t, q["strategy"].eqNullSafe(t["_s"]) & q["label"].eqNullSafe(t["_l"]))
             .select(*keys, "n", "p10", "p50", "p90", "threshold", "accepted"))


@query("sentence_similarity")
def q_sentence_similarity(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs gated by the cosine of sentence vectors learned from both sides."""
    pairs = materialize(pairs_of(spark, data_dir).select("pair_id", "src", "tgt"), "vector-pairs")  # each step reads them
    model = fit_sentence_vectors(pairs, ["src", "tgt"])
    scored = vector_similarity(pairs.select("pair_id", "src", "tgt"), model, "src", "tgt")
    gated = gate_blank(scored, "tgt")
    return gated.select("pair_id", F.round("similarity", 4).alias("similarity"), (F.col("tgt") != "").alias("accepted"))


@query("pivot_compose", sql="""
WITH en_tl AS (
  SELECT DISTINCT u.text AS en, a.text AS tl FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
tl_rin AS (
  SELECT a.text AS tl, min(u.text) AS rin FROM conversations a JOIN conversations u
    ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user'
  GROUP BY a.text)
SELECT x.en, x.tl, y.rin FROM en_tl x JOIN tl_rin y ON x.tl = y.tl
""")
def q_pivot_compose(spark: SparkSession, data_dir: str) -> DataFrame:
    """English→Tagalog table ⋈ Tagalog→Rinconada table on the pivot text:
    turns (t, t+1) give (en, tl), turns (t+1, t+2) give (tl, rin)."""
    conv = load_table(spark, data_dir, "conversations")
    en_tl = turn_pairs(conv, "user", "assistant", "en", "tl").select("en", "tl")
    tl_rin = turn_pairs(conv, "assistant", "user", "tl", "rin").select("tl", "rin")
    return compose_pivot(en_tl, tl_rin, "tl").select("en", "tl", "rin")


_PIVOT_SQL_PAIRS = """pairs AS (
  SELECT * FROM (
    SELECT a.conv_id || ':' || a.turn AS pair_id, {sa} AS src, {su} AS tgt
    FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn + 1
    WHERE a.role = 'assistant' AND u.role = 'user') t
  WHERE src IS NOT NULL AND tgt IS NOT NULL AND src <> '' AND tgt <> '')""".format(
    sa=S.strip("a.text"), su=S.strip("u.text"))
_PFWD_SQL, _PFWD = S.em_ctes("pf", "pairs", "pair_id", "src", "tgt", EM_ITERS, BAND)
_PBWD_SQL, _PBWD = S.em_ctes("pb", "pairs", "pair_id", "tgt", "src", EM_ITERS, BAND)


@query("pivot_round_trip", sql=f"""
WITH {_PIVOT_SQL_PAIRS},
{_PFWD_SQL},
{_PBWD_SQL},
{S.best_cte('bf', _PFWD)},
{S.best_cte('bb', _PBWD)},
{S.turn_pairs_cte('en_tl')},
tl AS (SELECT DISTINCT tgt AS tl FROM en_tl),
tlk AS (SELECT tl, md5(tl) AS tl_key FROM tl),
{S.translate_cte('fwd', 'tlk', 'tl_key', 'tl', 'bf')},
syn AS (SELECT t.tl_key, t.tl, f.translation AS rin FROM tlk t JOIN fwd f ON f.tl_key = t.tl_key),
{S.translate_cte('back', 'syn', 'tl_key', 'rin', 'bb')},
rt AS (SELECT s.tl_key AS pair_id, s.tl, s.rin, b.translation AS back FROM syn s JOIN back b ON b.tl_key = s.tl_key),
{S.token_cosine_cte('rsim', 'rt', 'tl', 'back')},
scored AS (SELECT r.tl, CASE WHEN s.similarity >= {THRESHOLD} THEN r.rin ELSE '' END AS rin, s.similarity
           FROM rt r JOIN rsim s ON s.pair_id = r.pair_id)
SELECT DISTINCT e.src AS en, e.tgt AS tl, s.rin, round(s.similarity, 6) AS similarity
FROM en_tl e JOIN scored s ON s.tl = e.tgt
""")
def q_pivot_round_trip(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pivot generator: English→Tagalog pairs; Tagalog translated to Rinconada
    and back with lexicons learned on (Tagalog, Rinconada) turn pairs; the
    similarity is taken on the pivot text; then composed to (en, tl, rin)."""
    conv = load_table(spark, data_dir, "conversations")
    tl_rin = clean_pairs(turn_pairs(conv, "assistant", "user"))
    fwd, bwd = fit_lexicons(tl_rin, "pair_id", "src", "tgt", EM_ITERS, BAND, best=1)
    en_tl = clean_pairs(turn_pairs(conv)).select(F.col("src").alias("en"), F.col("tgt").alias("tl"))
    tl = en_tl.select("tl").distinct().withColumn("tl_key", F.md5("tl"))
    syn = materialize(translate(tl, "tl", fwd, "rin", key="tl_key"), "prt-forward")
    back = translate(syn.select("tl_key", "rin"), "rin", bwd, "back", key="tl_key")
    sims = token_cosine(syn.join(back, "tl_key"), "tl_key", "tl", "back")
    scored = gate_blank(syn.join(sims, "tl_key"), "rin", "similarity", THRESHOLD)
    out = compose_pivot(en_tl, scored.select("tl", "rin", "similarity"), "tl")
    return out.select("en", "tl", "rin", F.round("similarity", 6).alias("similarity")).distinct()


def _reverse_words():
    """Toy translator plug-in: reverse the space-separated words."""
    def f(s):
        return [" ".join(reversed(x.split(" "))) for x in s]
    return f


def _length_embedder():
    """Toy sentence encoder plug-in: (number of words, number of characters)."""
    def f(s):
        return [[len(x.split()), len(x)] for x in s]
    return f


@query("plugin_map", sql=f"""
WITH {S.turn_pairs_cte()}
SELECT pair_id, array_to_string(list_reverse(string_split(src, ' ')), ' ') AS translation,
       len(list_filter(regexp_split_to_array(src, '{WS_CLASS}+'), lambda x: x <> '')) AS n_words,
       length(src) AS n_chars
FROM pairs
""")
def q_plugin_map(spark: SparkSession, data_dir: str) -> DataFrame:
    """Caller plug-ins: a batched translator (reverse the words) and a
    row-wise length embedder, both run in Arrow batches."""
    from ..operators.similarity import embed
    pairs = pairs_of(spark, data_dir)
    out = translate(pairs.select("pair_id", "src"), "src", _reverse_words, "translation", batch_size=128)
    out = embed(out, "src", _length_embedder, "_v", batch_size=128)
    return out.select("pair_id", "translation", F.col("_v")[0].cast("long").alias("n_words"),
                      F.col("_v")[1].cast("long").alias("n_chars"))


@query("map_rows", sql="SELECT doc_id, length(text) AS n_chars FROM documents")
def q_map_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    """A caller's function of one value, mapped over every document."""
    docs = load_table(spark, data_dir, "documents")
    return docs.select("doc_id", map_rows(len, T.LongType())("text").alias("n_chars"))


_BULK_BODY = f"""{S.turn_pairs_cte()},
{_FWD_SQL},
{S.best_cte('best', _FWD)},
{S.doc_lines_cte()},
{S.translate_cte('tr', 'lines', 'line_id', 'line', 'best')}"""

# Parquet output keeps an empty translation as ''.
BULK_PARQUET_SQL = f"""
WITH {_BULK_BODY}
SELECT l.line_id, l.line AS en, t.translation AS tl FROM lines l JOIN tr t ON t.line_id = l.line_id
"""


@query("bulk_translate", sql=f"""
WITH {_BULK_BODY}
SELECT l.line_id, nullif(l.line, '') AS en, nullif(t.translation, '') AS tl
FROM lines l JOIN tr t ON t.line_id = l.line_id
""")
def q_bulk_translate(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document line translated (no filter), written as TSV (en, tl)
    with quoting, read back.  As in the reference's pandas round trip, an
    empty translation (a line without word tokens) reads back as missing."""
    from ..sources.csv import scan_csv, sink_tsv
    from .corpus import doc_lines, scratch_path
    pairs = pairs_of(spark, data_dir)
    lex = fit_lexicon(pairs, "pair_id", "src", "tgt", EM_ITERS, BAND, best=1)
    lines = doc_lines(spark, data_dir).select("line_id", F.col("line").alias("en"))
    out = translate(lines, "en", lex, "tl", key="line_id")
    path = scratch_path(spark, "bulk")
    sink_tsv(out.select("line_id", "en", "tl"), path)
    return scan_csv(spark, path, "line_id string, en string, tl string", sep="\t", na_values=())


@query("score_report", sql=f"""
WITH RECURSIVE {S.turn_pairs_cte()},
split AS (
  SELECT pair_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(pair_id AS VARCHAR)), pair_id)
                  <= ceil(CAST({TEST_SIZE} AS DOUBLE) * count(*) OVER ()) AS is_test
  FROM pairs),
train AS (SELECT p.* FROM pairs p JOIN split s ON s.pair_id = p.pair_id WHERE NOT s.is_test),
test AS (SELECT p.* FROM pairs p JOIN split s ON s.pair_id = p.pair_id WHERE s.is_test),
{S.em_ctes('lx', 'train', 'pair_id', 'src', 'tgt', EM_ITERS, BAND)[0]},
{S.best_cte('best', S.em_ctes('lx', 'train', 'pair_id', 'src', 'tgt', EM_ITERS, BAND)[1])},
{S.translate_cte('tr', 'test', 'pair_id', 'src', 'best')},
tall AS (
  SELECT 'direct' AS strategy, 'lexicon' AS model, t.pair_id, x.translation AS hyp, t.tgt AS ref
  FROM test t JOIN tr x ON x.pair_id = t.pair_id
  UNION ALL
  SELECT 'direct', 'copy', pair_id, src, tgt FROM test),
{S.bleu_ctes('b', 'tall', 'pair_id', 'hyp', 'ref', 'strategy, model')},
{S.meteor_ctes('m', 'tall', 'pair_id', 'hyp', 'ref', 'strategy, model')},
tall_k AS (SELECT strategy, model, strategy || '/' || model || '/' || pair_id AS k, hyp, ref FROM tall),
{S.lcs_ctes('r', 'tall_k', 'k', 'hyp', 'ref')},
cnt AS (SELECT strategy, model, count(*) AS n_pairs FROM tall GROUP BY ALL),
met AS (SELECT strategy, model, avg(meteor) AS meteor FROM m_sent GROUP BY ALL),
rl AS (SELECT t.strategy, t.model, avg(s.rougeL) AS rougeL FROM r_sent s JOIN tall_k t ON t.k = s.k GROUP BY ALL)
SELECT c.strategy, c.model, c.n_pairs, round(b.bleu, 6) AS bleu, round(m.meteor, 6) AS meteor,
       round(r.rougeL, 6) AS rougeL
FROM cnt c JOIN b ON b.strategy = c.strategy AND b.model = c.model
JOIN met m ON m.strategy = c.strategy AND m.model = c.model
JOIN rl r ON r.strategy = c.strategy AND r.model = c.model
""")
def q_score_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """Evaluation of the held-out split: lexicon learned on the train split,
    test sources translated; compared with copying the source; BLEU, METEOR
    and ROUGE-L per (strategy, model)."""
    pairs = pairs_of(spark, data_dir).select("pair_id", "src", "tgt")
    split = split_exact(pairs, "pair_id", TEST_SIZE, SEED)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test").drop("split")
    lex = fit_lexicon(train, "pair_id", "src", "tgt", EM_ITERS, BAND, best=1)
    hyp = translate(test, "src", lex, "hyp", key="pair_id")
    tall = (hyp.select(F.lit("direct").alias("strategy"), F.lit("lexicon").alias("model"), "pair_id", "hyp",
                       F.col("tgt").alias("ref"))
            .unionByName(test.select(F.lit("direct").alias("strategy"), F.lit("copy").alias("model"), "pair_id",
                                     F.col("src").alias("hyp"), F.col("tgt").alias("ref"))))
    rep = M.score_report(tall, "pair_id", "hyp", "ref", ["strategy", "model"], ["bleu", "meteor", "rougeL"])
    return rep.select("strategy", "model", "n_pairs", *[F.round(c, 6).alias(c) for c in ("bleu", "meteor", "rougeL")])
