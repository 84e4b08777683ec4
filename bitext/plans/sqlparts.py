"""SQL fragments shared by the DuckDB oracle queries (same rules as the
Spark expressions in ``bitext.functions``)."""

from ..functions.text import STRIP_RE

STRIP = STRIP_RE
# Written out here, not imported, so that the check is independent.
WORDS = r"[^\p{L}\p{M}\p{N}]+"
ROUGE_WORDS = "[^a-z0-9]+"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP}', '', 'g')"


def tokens(expr: str, split: str = WORDS) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '{split}'), lambda x: x <> '')"


def turn_pairs_cte(name: str = "pairs", src_role: str = "user", tgt_role: str = "assistant",
                   clean: bool = True) -> str:
    """CTE: cleaned conversation turn pairs (pair_id, src, tgt)."""
    where = ""
    if clean:
        where = ("WHERE src IS NOT NULL AND tgt IS NOT NULL AND src <> '' AND tgt <> ''")
    return f"""{name} AS (
  SELECT * FROM (
    SELECT u.conv_id || ':' || u.turn AS pair_id, u.conv_id, u.turn,
           {strip('u.text') if clean else 'u.text'} AS src, {strip('a.text') if clean else 'a.text'} AS tgt
    FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = '{src_role}' AND a.role = '{tgt_role}') t
  {where})"""


def token_cosine_cte(name: str, pairs: str, a: str, b: str) -> str:
    """CTE: (pair_id, similarity) token-count cosine of columns a and b."""
    return f"""{name}_tok AS (
  SELECT pair_id, 0 AS side, unnest({tokens(a)}) AS token FROM {pairs}
  UNION ALL
  SELECT pair_id, 1 AS side, unnest({tokens(b)}) AS token FROM {pairs}),
{name}_cnt AS (
  SELECT pair_id, token, CAST(sum(1 - side) AS DOUBLE) AS ca, CAST(sum(side) AS DOUBLE) AS cb
  FROM {name}_tok GROUP BY pair_id, token),
{name}_sum AS (
  SELECT pair_id, sum(ca * cb) AS ab, sum(ca * ca) AS aa, sum(cb * cb) AS bb
  FROM {name}_cnt GROUP BY pair_id),
{name} AS (
  SELECT p.pair_id,
         coalesce(CASE WHEN s.aa > 0 AND s.bb > 0 THEN s.ab / sqrt(s.aa * s.bb) ELSE 0.0 END, 0.0) AS similarity
  FROM {pairs} p LEFT JOIN {name}_sum s ON p.pair_id = s.pair_id)"""


# ---------------------------------------------------------------- text / lines
def doc_lines_cte(name: str = "lines") -> str:
    """CTE: (line_id, doc_id, lang, line) — documents split on line breaks,
    stripped, blank lines dropped; line_id = '<doc_id>:<line number>'."""
    return f"""{name} AS (
  SELECT doc_id || ':' || k AS line_id, doc_id, lang, line FROM (
    SELECT doc_id, lang, k, {strip('ls[k + 1]')} AS line FROM (
      SELECT doc_id, lang, ls, unnest(range(len(ls))) AS k FROM (
        SELECT doc_id, lang, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS ls FROM documents)))
  WHERE line IS NOT NULL AND line <> '')"""


# ---------------------------------------------------------------- vocabulary
SPECIALS_SQL = "SELECT '<pad>' AS token, 0 AS id, 0 AS count UNION ALL SELECT '<unk>', 1, 0 UNION ALL SELECT '</s>', 2, 0"


def vocab_cte(name: str, sources: list[tuple[str, str]], size: int) -> str:
    """CTE: (token, id INT, count BIGINT): specials + top-`size` tokens.
    `sources` = [(cte, text expression)]."""
    union = "\n  UNION ALL ".join(f"SELECT unnest({tokens(expr)}) AS token FROM {cte}" for cte, expr in sources)
    return f"""{name}_tok AS (
  {union}),
{name}_top AS (
  SELECT token, count(*) AS count FROM {name}_tok GROUP BY token
  ORDER BY count DESC, token ASC LIMIT {size}),
{name} AS (
  SELECT token, CAST(id AS INTEGER) AS id, CAST(count AS BIGINT) AS count FROM ({SPECIALS_SQL})
  UNION ALL
  SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token ASC) + 2 AS INTEGER), count FROM {name}_top)"""


def encode_cte(name: str, rows: str, key: str, text_expr: str, vocab: str,
               max_length: int | None, add_eos: bool = True, prefix_id: int | None = None) -> str:
    """CTE: (key, ids INT[]) — tokens → ids (unknown → 1), truncation, </s>."""
    reserve = (1 if add_eos else 0) + (1 if prefix_id is not None else 0)
    toks = tokens(text_expr)
    if max_length is not None:
        toks = f"({toks})[1:{max(max_length - reserve, 0)}]"
    ids = f"coalesce(g.ids, CAST([] AS INTEGER[]))"
    if prefix_id is not None:
        ids = f"list_concat([CAST({prefix_id} AS INTEGER)], {ids})"
    if add_eos:
        ids = f"list_concat({ids}, [CAST(2 AS INTEGER)])"
    return f"""{name}_t AS (SELECT {key}, {toks} AS t FROM {rows}),
{name}_x AS (SELECT {key}, pos, t[pos + 1] AS token FROM (SELECT {key}, t, unnest(range(len(t))) AS pos FROM {name}_t)),
{name}_g AS (
  SELECT x.{key}, list(coalesce(v.id, CAST(1 AS INTEGER)) ORDER BY x.pos) AS ids
  FROM {name}_x x LEFT JOIN {vocab} v ON v.token = x.token GROUP BY x.{key}),
{name} AS (SELECT r.{key}, {ids} AS ids FROM {name}_t r LEFT JOIN {name}_g g ON g.{key} = r.{key})"""


def ids_text(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


# ---------------------------------------------------------------- lexicon EM
def em_ctes(prefix: str, pairs: str, key: str, src: str, tgt: str, iterations: int,
            band: int | None) -> tuple[str, str]:
    """CTEs of IBM Model 1 (banded or not); returns (sql, name of final lexicon CTE
    with columns e, f, p)."""
    if band is None:
        lo, hi = "0", "ls - 1"
    else:
        c = "CAST(floor((CAST(j AS DOUBLE) + 0.5) * ls / lt) AS BIGINT)"
        lo, hi = f"greatest(0, {c} - {band})", f"least(ls - 1, {c} + {band})"
    parts = [f"""{prefix}_tk AS (
  SELECT {key}, s, t, len(s) AS ls, len(t) AS lt FROM (
    SELECT {key}, {tokens(src)} AS s, {tokens(tgt)} AS t FROM {pairs}) WHERE len(s) > 0 AND len(t) > 0),
{prefix}_links AS MATERIALIZED (
  SELECT {key}, j, s[i + 1] AS e, f FROM (
    SELECT {key}, j, f, s, unnest(range({lo}, {hi} + 1)) AS i FROM (
      SELECT {key}, s, ls, lt, j, t[j + 1] AS f FROM (
        SELECT {key}, s, t, ls, lt, unnest(range(lt)) AS j FROM {prefix}_tk))))"""]
    prev = None
    for it in range(1, iterations + 1):
        if prev is None:
            w = f"SELECT {key}, j, e, f, 1.0 AS w FROM {prefix}_links"
        else:
            w = (f"SELECT l.{key}, l.j, l.e, l.f, coalesce(x.p, 0.0) AS w FROM {prefix}_links l "
                 f"LEFT JOIN {prev} x ON x.e = l.e AND x.f = l.f")
        parts.append(f"""{prefix}_w{it} AS ({w}),
{prefix}_c{it} AS (
  SELECT e, f, sum(post) AS c FROM (
    SELECT e, f, w / sum(w) OVER (PARTITION BY {key}, j) AS post FROM {prefix}_w{it}) GROUP BY e, f),
{prefix}_lex{it} AS (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS p FROM {prefix}_c{it})""")
        prev = f"{prefix}_lex{it}"
    return ",\n".join(parts), prev


def best_cte(name: str, lex: str) -> str:
    """CTE: (e, f) top-1 translation per source token (p rounded to 9 places desc, f asc)."""
    return f"""{name} AS MATERIALIZED (
  SELECT e, f FROM (
    SELECT e, f, row_number() OVER (PARTITION BY e ORDER BY round(p, 9) DESC, f ASC) AS rk FROM {lex})
  WHERE rk = 1)"""


def translate_cte(name: str, rows: str, key: str, text_expr: str, best: str) -> str:
    """CTE: (key, translation) — token-by-token, unknown copied, '' for no tokens."""
    return f"""{name}_t AS (SELECT {key}, {tokens(text_expr)} AS t FROM {rows}),
{name}_x AS (SELECT {key}, pos, t[pos + 1] AS tok FROM (SELECT {key}, t, unnest(range(len(t))) AS pos FROM {name}_t)),
{name}_g AS (
  SELECT x.{key}, string_agg(coalesce(b.f, x.tok), ' ' ORDER BY x.pos) AS tr
  FROM {name}_x x LEFT JOIN {best} b ON b.e = x.tok GROUP BY x.{key}),
{name} AS (SELECT r.{key}, coalesce(g.tr, '') AS translation FROM {name}_t r LEFT JOIN {name}_g g ON g.{key} = r.{key})"""


# ---------------------------------------------------------------- metrics
def language_model_ctes(name: str, rows: str, text_expr: str) -> str:
    """CTEs ending in {name}: (context, word, count, logp); context null: the word alone."""
    return f"""{name}_t AS (SELECT {tokens(text_expr)} AS t FROM {rows}),
{name}_c AS MATERIALIZED (
  SELECT context, word, count(*) AS count FROM (
    SELECT unnest(list_concat(['<s>'], t)) AS context, unnest(list_concat(t, ['</s>'])) AS word
    FROM {name}_t WHERE len(t) > 0) GROUP BY ALL),
{name}_w AS (SELECT word, CAST(sum(count) AS BIGINT) AS count FROM {name}_c GROUP BY word),
{name} AS MATERIALIZED (
  SELECT context, word, count, ln(CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY context)) AS logp FROM {name}_c
  UNION ALL
  SELECT NULL, word, count, ln(CAST(count + 1 AS DOUBLE) / (SELECT sum(count) + count(*) + 1 FROM {name}_w)) FROM {name}_w)"""


def beam_ctes(name: str, rows: str, key: str, text_expr: str, lex: str, model: str, beam: int, weight: float,
              backoff: float, least: float) -> str:
    """CTEs ending in {name}: (key, rank, translation, score).  One step of the
    recursion is one position of all texts."""
    lm = f"{weight} * coalesce(g.logp, ln({backoff}) + "
    return f"""{name}_none AS (SELECT -ln(sum(count) + count(*) + 1) AS own FROM {model}_w),
{name}_best AS (
  SELECT e, f, p, row_number() OVER (PARTITION BY e ORDER BY round(p, 9) DESC, f ASC) AS rk FROM {lex}),
{name}_t AS (SELECT {key}, {tokens(text_expr)} AS t FROM {rows}),
{name}_x AS (SELECT {key}, pos, t[pos] AS tok, len(t) AS m FROM (
  SELECT {key}, t, unnest(range(1, len(t) + 1)) AS pos FROM {name}_t)),
{name}_lat AS MATERIALIZED (
  SELECT x.{key}, x.pos, x.m, coalesce(b.f, x.tok) AS w, coalesce(b.rk, 1) AS ck,
         CASE WHEN b.f IS NULL THEN 0.0 ELSE ln(greatest(b.p, {least})) END AS lp,
         CASE WHEN b.f IS NULL THEN n.own ELSE coalesce(u.logp, n.own) END AS own
  FROM {name}_x x CROSS JOIN {name}_none n LEFT JOIN {name}_best b ON b.e = x.tok AND b.rk <= {beam}
  LEFT JOIN {model} u ON u.context IS NULL AND u.word = b.f),
{name}_b({key}, pos, rk, last, score, tr) AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT), CAST(1 AS BIGINT), '<s>', CAST(0.0 AS DOUBLE), '' FROM {name}_lat
  UNION ALL
  SELECT {key}, pos, rk, w, score, tr FROM (
    SELECT b.{key}, l.pos, l.w, b.score + (l.lp + {lm}l.own)) AS score,
           CASE WHEN b.pos = 0 THEN l.w ELSE b.tr || ' ' || l.w END AS tr,
           row_number() OVER (PARTITION BY b.{key} ORDER BY round(b.score + (l.lp + {lm}l.own)), 9) DESC, b.rk, l.ck) AS rk
    FROM {name}_b b JOIN {name}_lat l ON l.{key} = b.{key} AND l.pos = b.pos + 1
    LEFT JOIN {model} g ON g.context = b.last AND g.word = l.w) WHERE rk <= {beam}),
{name}_end AS (SELECT {key}, max(pos) AS m FROM {name}_lat GROUP BY {key}),
{name}_s AS (
  SELECT b.{key}, b.rk, b.tr, b.score + {lm}coalesce(u.logp, n.own)) AS score
  FROM {name}_b b JOIN {name}_end e ON e.{key} = b.{key} AND e.m = b.pos CROSS JOIN {name}_none n
  LEFT JOIN {model} g ON g.context = b.last AND g.word = '</s>' LEFT JOIN {model} u ON u.context IS NULL AND u.word = '</s>'),
{name} AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, rk) AS rank, tr AS translation, score
  FROM {name}_s)"""


def bleu_tokens(expr: str) -> str:
    from ..functions.bleu_tok import PUNCT_CLASS, RULES, UNESCAPE
    from ..functions.text import WS_CLASS
    s = expr
    s = f"replace({s}, '<skipped>', '')"
    s = f"replace({s}, '-' || chr(10), '')"
    s = f"replace({s}, chr(10), ' ')"
    for a, b in UNESCAPE:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in RULES:
        s = f"regexp_replace({s}, '{pat}', '{rep.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    return f"list_filter(regexp_split_to_array({s}, '{WS_CLASS}+'), lambda x: x <> '')"


def bleu_per_ctes(prefix: str, rows: str, key: str, hyp: str, ref: str, groups: str = "") -> str:
    """CTEs: {prefix}_tk (groups, key, h, r) and {prefix}_per (groups, key, n, gram, hc, rc)."""
    g = f"{groups}, " if groups else ""
    sel = []
    for side, col in ((0, "h"), (1, "r")):
        for n in range(1, 5):
            sel.append(f"SELECT {g}{key}, {n} AS n, unnest(list_transform(range(1, len({col}) - {n} + 2), "
                       f"lambda i: array_to_string({col}[i:i + {n - 1}], ' '))) AS gram, {side} AS side FROM {prefix}_tk")
    union = "\n    UNION ALL ".join(sel)
    return f"""{prefix}_tk AS (SELECT {g}{key}, {bleu_tokens(hyp)} AS h, {bleu_tokens(ref)} AS r FROM {rows}),
{prefix}_per AS (
  SELECT {g}{key}, n, gram, CAST(sum(1 - side) AS BIGINT) AS hc, CAST(sum(side) AS BIGINT) AS rc FROM (
    {union}) GROUP BY ALL)"""


def bleu_ctes(prefix: str, rows: str, key: str, hyp: str, ref: str, groups: str = "") -> str:
    """CTEs ending in {prefix} (groups…, bleu, bp, sys_len, ref_len, correct_n, total_n)."""
    g = f"{groups}, " if groups else ""
    gb = f"GROUP BY {groups}" if groups else ""
    jn = " AND ".join(f"c.{x.strip()} = l.{x.strip()}" for x in groups.split(",")) if groups else "TRUE"
    corr = ", ".join(f"CAST(coalesce(sum(least(hc, rc)) FILTER (WHERE n = {n}), 0) AS BIGINT) AS correct_{n}"
                     for n in range(1, 5))
    tot = ", ".join(f"CAST(sum(greatest(len(h) - {n - 1}, 0)) AS BIGINT) AS total_{n}" for n in range(1, 5))
    logs = []
    zeros = "0"
    for n in range(1, 5):
        zeros = f"{zeros} + (CASE WHEN correct_{n} = 0 THEN 1 ELSE 0 END)"
        logs.append(f"ln(CASE WHEN correct_{n} > 0 THEN 100.0 * correct_{n} / total_{n} "
                    f"ELSE 100.0 / (pow(2.0, {zeros}) * total_{n}) END)")
    any_zero = " OR ".join(f"total_{n} = 0" for n in range(1, 5))
    nothing = " + ".join(f"correct_{n}" for n in range(1, 5)) + " = 0"
    gsel = f"{', '.join('l.' + x.strip() for x in groups.split(','))}, " if groups else ""
    return f"""{bleu_per_ctes(prefix, rows, key, hyp, ref, groups)},
{prefix}_corr AS (SELECT {g}{corr} FROM {prefix}_per {gb}),
{prefix}_len AS (SELECT {g}CAST(sum(len(h)) AS BIGINT) AS sys_len, CAST(sum(len(r)) AS BIGINT) AS ref_len, {tot}
  FROM {prefix}_tk {gb}),
{prefix}_st AS (
  SELECT {gsel}sys_len, ref_len, {', '.join(f'total_{n}' for n in range(1, 5))},
         {', '.join(f'coalesce(correct_{n}, 0) AS correct_{n}' for n in range(1, 5))}
  FROM {prefix}_len l LEFT JOIN {prefix}_corr c ON {jn}),
{prefix} AS (
  SELECT {g}CASE WHEN ({nothing}) OR ({any_zero}) THEN 0.0
              ELSE bp * exp(({' + '.join(logs)}) / 4) END AS bleu,
         bp, sys_len, ref_len, {', '.join(f'correct_{n}' for n in range(1, 5))}, {', '.join(f'total_{n}' for n in range(1, 5))}
  FROM (SELECT *, CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len)
                       ELSE 0.0 END AS bp FROM {prefix}_st))"""


def meteor_ctes(prefix: str, rows: str, key: str, hyp: str, ref: str, groups: str = "") -> str:
    """CTEs ending in {prefix}_sent (groups…, key, meteor) — exact stage."""
    g = f"{groups}, " if groups else ""
    kk = f"{g}{key}"
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in kk.split(","))
    on_m = " AND ".join(f"m.{c.strip()} = p.{c.strip()}" for c in kk.split(","))
    on_l = " AND ".join(f"l.{c.strip()} = s.{c.strip()}" for c in kk.split(","))
    lsel = ", ".join(f"l.{c.strip()}" for c in kk.split(","))
    return f"""{prefix}_t AS (SELECT {kk}, {tokens(hyp)} AS h, {tokens(ref)} AS r FROM {rows}),
{prefix}_h AS (
  SELECT {kk}, pos, tok, row_number() OVER (PARTITION BY {kk}, tok ORDER BY pos DESC) AS k FROM (
    SELECT {kk}, pos, h[pos + 1] AS tok FROM (SELECT {kk}, h, unnest(range(len(h))) AS pos FROM {prefix}_t))),
{prefix}_r AS (
  SELECT {kk}, pos, tok, row_number() OVER (PARTITION BY {kk}, tok ORDER BY pos DESC) AS k FROM (
    SELECT {kk}, pos, r[pos + 1] AS tok FROM (SELECT {kk}, r, unnest(range(len(r))) AS pos FROM {prefix}_t))),
{prefix}_m AS (
  SELECT {', '.join('a.' + c.strip() for c in kk.split(','))}, a.pos AS hpos, b.pos AS rpos
  FROM {prefix}_h a JOIN {prefix}_r b ON {on} AND a.tok = b.tok AND a.k = b.k),
{prefix}_s AS (
  SELECT {', '.join('m.' + c.strip() for c in kk.split(','))}, count(*) AS m, count(p.hpos) AS cont
  FROM {prefix}_m m LEFT JOIN {prefix}_m p ON {on_m} AND p.hpos = m.hpos - 1 AND p.rpos = m.rpos - 1
  GROUP BY ALL),
{prefix}_sent AS (
  SELECT {lsel},
    CASE WHEN coalesce(s.m, 0) > 0 AND len(l.h) > 0 AND len(l.r) > 0 THEN
      (1 - {GAMMA} * pow(CAST(s.m - s.cont AS DOUBLE) / s.m, {BETA})) *
      ((CAST(s.m AS DOUBLE) / len(l.h)) * (CAST(s.m AS DOUBLE) / len(l.r)) /
       ({ALPHA} * (CAST(s.m AS DOUBLE) / len(l.h)) + (1 - {ALPHA}) * (CAST(s.m AS DOUBLE) / len(l.r))))
    ELSE 0.0 END AS meteor
  FROM {prefix}_t l LEFT JOIN {prefix}_s s ON {on_l})"""


def meteor_staged_ctes(prefix: str, rows: str, key: str, hyp: str, ref: str, stem: int, cls: int) -> str:
    """meteor_ctes with stages on a word's first ``stem`` and ``cls`` letters
    after the exact one, each on the words left."""
    base = meteor_ctes(prefix, rows, key, hyp, ref)
    sides, out = {"h": f"{prefix}_h", "r": f"{prefix}_r"}, []
    matches = [f"SELECT * FROM {prefix}_m0"]
    for n, size in enumerate((stem, cls), 1):
        done = " UNION ALL ".join(matches)
        for side in "hr":
            out.append(f"""{prefix}_{side}{n} AS (
  SELECT {key}, pos, c, row_number() OVER (PARTITION BY {key}, c ORDER BY pos DESC) AS k FROM (
    SELECT x.{key}, x.pos, left(x.tok, {size}) AS c FROM {sides[side]} x
    WHERE NOT EXISTS (SELECT 1 FROM ({done}) d WHERE d.{key} = x.{key} AND d.{side}pos = x.pos)))""")
        out.append(f"""{prefix}_m{n} AS MATERIALIZED (
  SELECT a.{key}, a.pos AS hpos, b.pos AS rpos FROM {prefix}_h{n} a JOIN {prefix}_r{n} b
  ON a.{key} = b.{key} AND a.c = b.c AND a.k = b.k)""")
        matches.append(f"SELECT * FROM {prefix}_m{n}")
    out.append(f"{prefix}_m AS MATERIALIZED ({' UNION ALL '.join(matches)})")
    head, tail = base.split(f"{prefix}_m AS (", 1)
    first, rest = tail.split(f"),\n{prefix}_s AS (", 1)
    return f"{head}{prefix}_m0 AS MATERIALIZED ({first}),\n" + ",\n".join(out) + f",\n{prefix}_s AS ({rest}"


ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def lcs_ctes(prefix: str, rows: str, key: str, hyp: str, ref: str) -> str:
    """Recursive CTE: {prefix}_sent (key, lcs, rougeL) — row-by-row LCS DP with a
    running max over the reference positions."""
    return f"""{prefix}_t AS (SELECT {key}, {tokens(hyp, ROUGE_WORDS)} AS h, {tokens(ref, ROUGE_WORDS)} AS r FROM {rows}),
{prefix}_cells AS (SELECT {key}, unnest(range(len(r) + 1)) AS j FROM {prefix}_t),
{prefix}_dp({key}, i, j, v) AS (
  SELECT {key}, 0, j, 0 FROM {prefix}_cells
  UNION ALL
  SELECT {key}, i, j, max(cand) OVER (PARTITION BY {key} ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  FROM (
    SELECT d.{key}, d.i + 1 AS i, d.j,
           CASE WHEN d.j = 0 THEN 0
                WHEN t.r[d.j] = t.h[d.i + 1] THEN lag(d.v) OVER (PARTITION BY d.{key} ORDER BY d.j) + 1
                ELSE d.v END AS cand
    FROM {prefix}_dp d JOIN {prefix}_t t ON t.{key} = d.{key} WHERE d.i < len(t.h))),
{prefix}_lcs AS (SELECT {key}, max(v) AS lcs FROM {prefix}_dp GROUP BY {key}),
{prefix}_sent AS (
  SELECT t.{key}, CAST(coalesce(l.lcs, 0) AS BIGINT) AS lcs,
    CASE WHEN len(t.h) > 0 AND len(t.r) > 0 AND coalesce(l.lcs, 0) > 0 THEN
      2 * (CAST(l.lcs AS DOUBLE) / len(t.h)) * (CAST(l.lcs AS DOUBLE) / len(t.r)) /
      ((CAST(l.lcs AS DOUBLE) / len(t.h)) + (CAST(l.lcs AS DOUBLE) / len(t.r)))
    ELSE 0.0 END AS rougeL
  FROM {prefix}_t t LEFT JOIN {prefix}_lcs l ON l.{key} = t.{key})"""
