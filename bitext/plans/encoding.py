"""Vocabulary and encoding plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import ids_to_text, mask_out_of_vocab, take_primary, unmask_labels
from ..operators import subwords as W
from ..operators import vocab as V
from ..operators.pairs import clean_pairs, turn_pairs
from ..operators.runs import batch_number
from ..operators.counting import StageCounts
from ..operators.split import SEED, TEST_SIZE, split_exact
from ..operators.synth import split_augmented
from ..sources.contracts import require_columns
from ..session import materialize
from ..sources.tables import load_table
from . import sqlparts as S
from .registry import query

DOC_VOCAB = 60_000
PAIR_VOCAB = 60_000
MAX_LEN = 64      # fixed value: Marian max_length of the reference
BATCH = 16        # effective training batch of the reference


def pairs_of(spark: SparkSession, data_dir: str) -> DataFrame:
    return clean_pairs(turn_pairs(load_table(spark, data_dir, "conversations")))


@query("fit_vocab", sql=f"""
WITH {S.vocab_cte('vocab', [('documents', 'text')], DOC_VOCAB)}
SELECT token, id, count FROM vocab
""")
def q_fit_vocab(spark: SparkSession, data_dir: str) -> DataFrame:
    docs = load_table(spark, data_dir, "documents")
    return V.fit_vocab(docs, ["text"], DOC_VOCAB)


_PAIR_VOCAB_SQL = S.vocab_cte("vocab", [("pairs", "src"), ("pairs", "tgt")], PAIR_VOCAB)


def _encoded_pairs_sql(max_length, padding: bool, src_prefix: str | None = None,
                       tgt_prefix: str | None = None) -> str:
    enc_s = S.encode_cte("es", "pairs", "pair_id", "src", "vocab", max_length,
                         prefix_id=None if src_prefix is None else -1)
    enc_t = S.encode_cte("et", "pairs", "pair_id", "tgt", "vocab", max_length,
                         prefix_id=None if tgt_prefix is None else -1)
    if src_prefix is not None:
        enc_s = enc_s.replace("CAST(-1 AS INTEGER)", f"CAST(({src_prefix}) AS INTEGER)")
    if tgt_prefix is not None:
        enc_t = enc_t.replace("CAST(-1 AS INTEGER)", f"CAST(({tgt_prefix}) AS INTEGER)")
    if padding:
        ids = f"list_resize(s.ids, {max_length}, 0)"
        labels = (f"list_transform(list_resize(t.ids, {max_length}, 0), "
                  f"lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)")
    else:
        ids, labels = "s.ids", "t.ids"
    return f"""{enc_s},
{enc_t},
encoded AS (SELECT s.pair_id, {ids} AS input_ids, {labels} AS labels FROM es s JOIN et t ON s.pair_id = t.pair_id)"""


@query("encode_pairs", sql=f"""
WITH {S.turn_pairs_cte()},
{_PAIR_VOCAB_SQL},
{_encoded_pairs_sql(MAX_LEN, True)}
SELECT pair_id, {S.ids_text('input_ids')} AS input_ids,
       {S.ids_text("list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END)")} AS attention_mask,
       {S.ids_text('labels')} AS labels
FROM encoded
""")
def q_encode_pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    """Marian-style encoding: 64 ids per side with </s>, padded, labels masked."""
    pairs = pairs_of(spark, data_dir)
    vocab = materialize(V.fit_vocab(pairs, ["src", "tgt"], PAIR_VOCAB), "vocab")
    enc = V.encode_pairs(pairs, "pair_id", "src", "tgt", vocab, MAX_LEN, padding=True)
    return enc.select("pair_id", ids_to_text("input_ids").alias("input_ids"),
                      ids_to_text("attention_mask").alias("attention_mask"),
                      ids_to_text("labels").alias("labels"))


@query("encode_ragged", sql=f"""
WITH {S.turn_pairs_cte()},
{_PAIR_VOCAB_SQL},
{_encoded_pairs_sql(None, False)}
SELECT pair_id, {S.ids_text('input_ids')} AS input_ids, {S.ids_text('labels')} AS labels,
       len(input_ids) AS n_input, len(labels) AS n_labels
FROM encoded
""")
def q_encode_ragged(spark: SparkSession, data_dir: str) -> DataFrame:
    """Whole-text encoding without a length limit (ragged arrays)."""
    pairs = pairs_of(spark, data_dir)
    vocab = materialize(V.fit_vocab(pairs, ["src", "tgt"], PAIR_VOCAB), "vocab")
    enc = V.encode_pairs(pairs, "pair_id", "src", "tgt", vocab, None, padding=False)
    return enc.select("pair_id", ids_to_text("input_ids").alias("input_ids"),
                      ids_to_text("labels").alias("labels"),
                      F.size("input_ids").alias("n_input"), F.size("labels").alias("n_labels"))


@query("pad_batch", sql=f"""
WITH {S.turn_pairs_cte()},
{_PAIR_VOCAB_SQL},
{_encoded_pairs_sql(None, False)},
batched AS (SELECT *, CAST((row_number() OVER (ORDER BY pair_id) - 1) // {BATCH} AS BIGINT) AS batch_id FROM encoded),
lens AS (SELECT batch_id, max(len(input_ids)) AS li, max(len(labels)) AS ll FROM batched GROUP BY batch_id)
SELECT b.pair_id, b.batch_id, {S.ids_text('list_resize(b.input_ids, l.li, 0)')} AS input_ids,
       {S.ids_text("list_transform(list_resize(b.input_ids, l.li, 0), lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END)")} AS attention_mask,
       {S.ids_text('list_resize(b.labels, l.ll, -100)')} AS labels
FROM batched b JOIN lens l ON b.batch_id = l.batch_id
""")
def q_pad_batch(spark: SparkSession, data_dir: str) -> DataFrame:
    """Dynamic padding: batches of 16 pairs in key order, each padded to its
    own longest row (labels with -100)."""
    pairs = pairs_of(spark, data_dir)
    vocab = materialize(V.fit_vocab(pairs, ["src", "tgt"], PAIR_VOCAB), "vocab")
    enc = V.encode_pairs(pairs, "pair_id", "src", "tgt", vocab, None, padding=False)
    batched = batch_number(enc, [], ["pair_id"], BATCH)
    padded = V.pad_batch(batched, "batch_id", "input_ids", V.PAD_ID, "labels")
    return padded.select("pair_id", "batch_id", ids_to_text("input_ids").alias("input_ids"),
                         ids_to_text("attention_mask").alias("attention_mask"),
                         ids_to_text("labels").alias("labels"))


SRC_LANG, TGT_LANG = "en_XX", "rin_XX"  # language tokens added to the vocabulary


@query("lang_token", sql=f"""
WITH {S.turn_pairs_cte()},
{_PAIR_VOCAB_SQL},
vocab2 AS (SELECT * FROM vocab UNION ALL SELECT '{SRC_LANG}', CAST((SELECT max(id) + 1 FROM vocab) AS INTEGER), 0),
vocab3 AS (SELECT * FROM vocab2 UNION ALL SELECT '{TGT_LANG}', CAST((SELECT max(id) + 1 FROM vocab2) AS INTEGER), 0),
{_encoded_pairs_sql(MAX_LEN, False, f"SELECT id FROM vocab3 WHERE token = '{SRC_LANG}'",
                    f"SELECT id FROM vocab3 WHERE token = '{TGT_LANG}'").replace(' vocab v ON', ' vocab3 v ON')}
SELECT pair_id, {S.ids_text('input_ids')} AS input_ids, {S.ids_text('labels')} AS labels,
       (SELECT max(id) FROM vocab3) AS max_id
FROM encoded
""")
def q_lang_token(spark: SparkSession, data_dir: str) -> DataFrame:
    """Language tokens appended to the vocabulary (max id + 1 each) and used as
    the first id of each side (source and forced target language)."""
    pairs = pairs_of(spark, data_dir)
    vocab = V.add_lang_token(V.add_lang_token(V.fit_vocab(pairs, ["src", "tgt"], PAIR_VOCAB), SRC_LANG), TGT_LANG)
    vocab = materialize(vocab, "vocab")
    ids = {r["token"]: r["id"] for r in vocab.where(F.col("token").isin(SRC_LANG, TGT_LANG)).collect()}
    max_id = vocab.agg(F.max("id")).first()[0]
    s = V.encode(pairs, "pair_id", "src", vocab, "input_ids", MAX_LEN, prefix_id=ids[SRC_LANG])
    t = V.encode(pairs, "pair_id", "tgt", vocab, "labels", MAX_LEN, prefix_id=ids[TGT_LANG])
    return s.join(t, "pair_id").select("pair_id", ids_to_text("input_ids").alias("input_ids"),
                                       ids_to_text("labels").alias("labels"),
                                       F.lit(max_id).cast("int").alias("max_id"))


@query("decode_identity", sql=f"""
WITH {S.turn_pairs_cte()},
{_PAIR_VOCAB_SQL},
t AS (SELECT pair_id, ({S.tokens('tgt')})[1:{MAX_LEN - 1}] AS t FROM pairs),
x AS (SELECT pair_id, pos, t[pos + 1] AS tok FROM (SELECT pair_id, t, unnest(range(len(t))) AS pos FROM t)),
g AS (SELECT x.pair_id, string_agg(x.tok, ' ' ORDER BY x.pos) AS text
      FROM x JOIN vocab v ON v.token = x.tok AND v.id > 2 GROUP BY x.pair_id)
SELECT t.pair_id, coalesce(g.text, '') AS text FROM t LEFT JOIN g ON g.pair_id = t.pair_id
""")
def q_decode_identity(spark: SparkSession, data_dir: str) -> DataFrame:
    """Masked labels → unmask (-100 → pad) → decode with special ids skipped:
    the in-vocabulary tokens of the (truncated) target come back."""
    pairs = pairs_of(spark, data_dir)
    vocab = materialize(V.fit_vocab(pairs, ["src", "tgt"], PAIR_VOCAB), "vocab")
    enc = V.encode_pairs(pairs, "pair_id", "src", "tgt", vocab, MAX_LEN, padding=True)
    unmasked = enc.select("pair_id", unmask_labels("labels", V.PAD_ID).alias("labels"))
    return V.decode(unmasked, "pair_id", "labels", vocab, "text")


@query("prepare_corpus", sql=f"""
WITH {S.turn_pairs_cte()},
split AS (
  SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || CAST(pair_id AS VARCHAR)), pair_id)
                  <= ceil(CAST({TEST_SIZE} AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
  FROM pairs),
train AS (SELECT p.* FROM pairs p JOIN split s ON s.pair_id = p.pair_id WHERE s.split = 'train'),
{S.vocab_cte('vocab', [('train', 'src'), ('train', 'tgt')], PAIR_VOCAB)},
{_encoded_pairs_sql(MAX_LEN, True)}
SELECT e.pair_id, s.split, {S.ids_text('e.input_ids')} AS input_ids, {S.ids_text('e.labels')} AS labels
FROM encoded e JOIN split s ON s.pair_id = e.pair_id
""")
def q_prepare_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    """Whole preparation: contract → clean → orient → exact 90/10 split →
    vocabulary from the train split only (no leakage) → encode both splits."""
    conv = require_columns(load_table(spark, data_dir, "conversations"),
                           ["conv_id", "turn", "role", "text"])
    pairs = clean_pairs(turn_pairs(conv)).select("pair_id", "src", "tgt")
    split = split_exact(pairs, "pair_id", TEST_SIZE, SEED)
    split = materialize(split, "split")
    vocab = materialize(V.fit_vocab(split.where(F.col("split") == "train"), ["src", "tgt"], PAIR_VOCAB), "vocab")
    enc = V.encode_pairs(split, "pair_id", "src", "tgt", vocab, MAX_LEN, padding=True)
    return enc.join(split.select("pair_id", "split"), "pair_id").select(
        "pair_id", "split", ids_to_text("input_ids").alias("input_ids"), ids_to_text("labels").alias("labels"))


@query("prepare_counts", sql=f"""
WITH {S.turn_pairs_cte("every", clean=False)}, {S.turn_pairs_cte()}
SELECT 'pairs' AS stage, count(*) AS n_rows FROM every UNION ALL
SELECT 'clean', count(*) FROM pairs UNION ALL
SELECT 'split', count(*) FROM pairs UNION ALL
SELECT 'test', CAST(ceil(CAST({TEST_SIZE} AS DOUBLE) * count(*)) AS BIGINT) FROM pairs UNION ALL
SELECT 'train', count(*) - CAST(ceil(CAST({TEST_SIZE} AS DOUBLE) * count(*)) AS BIGINT) FROM pairs
""")
def q_prepare_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows of the preparation's stages, counted by the jobs that write them."""
    counts = StageCounts()
    paired = counts.watch(turn_pairs(load_table(spark, data_dir, "conversations")), "pairs")
    pairs = materialize(counts.watch(clean_pairs(paired), "clean").select("pair_id", "src", "tgt"), "counted-pairs")
    split = split_exact(pairs, "pair_id", TEST_SIZE, SEED)
    materialize(counts.watch(split, "split", {s: F.col("split") == s for s in ("test", "train")}), "counted-split")
    return counts.table(spark)


@query("mask_out_of_vocab", sql=f"""
WITH {S.turn_pairs_cte()},
{_PAIR_VOCAB_SQL},
vsize AS (SELECT count(*) AS v FROM vocab),
vocab3 AS (SELECT * FROM vocab UNION ALL SELECT '{TGT_LANG}', CAST((SELECT max(id) + 1 FROM vocab) AS INTEGER), 0),
{_encoded_pairs_sql(MAX_LEN, False, None, f"SELECT id FROM vocab3 WHERE token = '{TGT_LANG}'").replace(' vocab v ON', ' vocab3 v ON')}
SELECT pair_id, {S.ids_text("list_transform(list_resize(labels, " + str(MAX_LEN) + ", 0), lambda x: CASE WHEN x = 0 OR x >= v THEN -100 ELSE x END)")} AS labels
FROM encoded JOIN vsize ON TRUE
""")
def q_mask_out_of_vocab(spark: SparkSession, data_dir: str) -> DataFrame:
    """Evaluation-time label masking: padding and ids at or above the base
    vocabulary size (the added language token) become -100."""
    pairs = pairs_of(spark, data_dir)
    base = materialize(V.fit_vocab(pairs, ["src", "tgt"], PAIR_VOCAB), "vocab")
    vocab_size = base.count()
    vocab = materialize(V.add_lang_token(base, TGT_LANG), "vocab-lang")
    lang_id = vocab.where(F.col("token") == TGT_LANG).first()["id"]
    t = V.encode(pairs, "pair_id", "tgt", vocab, "labels", MAX_LEN, prefix_id=lang_id)
    from ..functions.ids import pad_fixed
    t = t.withColumn("labels", mask_out_of_vocab(pad_fixed("labels", MAX_LEN, V.PAD_ID), V.PAD_ID, vocab_size))
    return t.select("pair_id", ids_to_text("labels").alias("labels"))


#: Padding for the byte-level vocabulary, whose own ids end at 50256.
SUBWORD_END, SUBWORD_PAD = 50_256, 50_257


@query("subword_round_trip", sql="SELECT doc_id, coalesce(text, '') AS text, true AS same FROM documents")
def q_subword_round_trip(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every whole document to sub-word ids and back."""
    docs = load_table(spark, data_dir, "documents").select("doc_id", "text")
    enc = W.encode_subwords(docs, "text", "ids")
    dec = enc.select("doc_id", F.coalesce("text", F.lit("")).alias("was"), W.subword_text(F.col("ids")).alias("text"))
    return dec.select("doc_id", "text", (F.col("was") == F.col("text")).alias("same"))


@query("subword_pairs")
def q_subword_pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    """The pairs as a trainer with a sub-word vocabulary wants them (no SQL
    form: tests compare the ids with a second library)."""
    enc = W.encode_subword_pairs(pairs_of(spark, data_dir), "src", "tgt", MAX_LEN, SUBWORD_PAD, SUBWORD_END)
    return enc.select("pair_id", "input_ids", "attention_mask", "labels")


@query("augmented_split_real", sql=f"""
WITH {S.turn_pairs_cte('real')},
{S.turn_pairs_cte('made', 'assistant', 'user')},
t AS (SELECT 'real' AS origin, pair_id AS id FROM real UNION ALL SELECT 'synthetic', pair_id FROM made),
o AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY md5('{SEED}:' || id), id) AS r,
             count(*) OVER (PARTITION BY origin) AS n FROM t)
SELECT origin, id, CASE WHEN origin = 'real' AND r <= ceil({TEST_SIZE} * n) THEN 'test' ELSE 'train' END AS split FROM o
""")
def q_augmented_split_real(spark: SparkSession, data_dir: str) -> DataFrame:
    """Evaluation on real rows after augmentation; the turns that answer an
    assistant stand in for the synthetic side."""
    conv = load_table(spark, data_dir, "conversations")
    both = [clean_pairs(turn_pairs(conv, a, b)).select(F.lit(o).alias("origin"), F.col("pair_id").alias("id"))
            for o, a, b in (("real", "user", "assistant"), ("synthetic", "assistant", "user"))]
    return split_augmented(both[0].unionByName(both[1]), "id", "real", test_size=TEST_SIZE, seed=SEED)


@query("take_primary", sql="SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding) AS n FROM embeddings")
def q_take_primary(spark: SparkSession, data_dir: str) -> DataFrame:
    """Predictions given as a tuple (here a vector and its ranks): the first counts."""
    e = load_table(spark, data_dir, "embeddings")
    first = take_primary(F.array("embedding", F.transform("embedding", lambda x: x * 0)))
    return e.select("vec_id", F.round(first[0].cast("double"), 6).alias("first"), F.size(first).cast("long").alias("n"))
