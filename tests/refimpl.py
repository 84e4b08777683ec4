"""Independent pure-Python implementations used as brute-force oracles in
tests (written from the public definitions of the metrics and of IBM Model 1)."""

import math
import re
from collections import Counter, defaultdict

import regex


def tokens(s):
    return [t for t in regex.split(r"[^\p{L}\p{M}\p{N}]+", s.lower()) if t]


def ascii_tokens(s):
    return [t for t in re.split(r"[^a-z0-9]+", s.lower()) if t]


def tok13a(line):
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def bleu_stats(hyps, refs):
    correct, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for h, r in zip(hyps, refs):
        ht, rt = tok13a(h), tok13a(r)
        sys_len += len(ht)
        ref_len += len(rt)
        for n in range(1, 5):
            hc = Counter(tuple(ht[i:i + n]) for i in range(len(ht) - n + 1))
            rc = Counter(tuple(rt[i:i + n]) for i in range(len(rt) - n + 1))
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += max(len(ht) - n + 1, 0)
    return correct, total, sys_len, ref_len


def corpus_bleu(hyps, refs):
    correct, total, sys_len, ref_len = bleu_stats(hyps, refs)
    if not any(correct):
        return 0.0
    precisions, smooth = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            break
        if correct[n] == 0:
            smooth *= 2
            precisions[n] = 100.0 / (smooth * total[n])
        else:
            precisions[n] = 100.0 * correct[n] / total[n]
    bp = 1.0 if sys_len >= ref_len else (math.exp(1 - ref_len / sys_len) if sys_len > 0 else 0.0)
    logs = [math.log(p) if p > 0 else -9999999999 for p in precisions]
    return bp * math.exp(sum(logs) / 4)


def meteor_exact(h, r, alpha=0.9, beta=3.0, gamma=0.5):
    ht, rt = tokens(h), tokens(r)
    hyp, ref = list(enumerate(ht)), list(enumerate(rt))
    matches = []
    for i in range(len(hyp))[::-1]:
        for j in range(len(ref))[::-1]:
            if hyp[i][1] == ref[j][1]:
                matches.append((hyp[i][0], ref[j][0]))
                hyp.pop(i)
                ref.pop(j)
                break
    matches.sort()
    m = len(matches)
    if m == 0 or not ht or not rt:
        return 0.0
    p, rc = m / len(ht), m / len(rt)
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    chunks, i = 1, 0
    while i < m - 1:
        if matches[i + 1][0] == matches[i][0] + 1 and matches[i + 1][1] == matches[i][1] + 1:
            i += 1
            continue
        i += 1
        chunks += 1
    return (1 - gamma * (chunks / m) ** beta) * fmean


def lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


def rouge_l(h, r):
    ht, rt = ascii_tokens(h), ascii_tokens(r)
    if not ht or not rt:
        return 0.0
    x = lcs(ht, rt)
    if x == 0:
        return 0.0
    p, rc = x / len(ht), x / len(rt)
    return 2 * p * rc / (p + rc)


def ibm1(pairs, iterations, band=None):
    """Banded IBM Model 1 by brute force: returns {(e, f): p}."""
    t = None
    for _ in range(iterations):
        c = defaultdict(float)
        for s, tt in pairs:
            s, tt = tokens(s), tokens(tt)
            if not s or not tt:
                continue
            for j, f in enumerate(tt):
                if band is None:
                    win = range(len(s))
                else:
                    ctr = math.floor((j + 0.5) * len(s) / len(tt))
                    win = range(max(0, ctr - band), min(len(s) - 1, ctr + band) + 1)
                w = [1.0 if t is None else t.get((s[i], f), 0.0) for i in win]
                z = sum(w)
                for i, wi in zip(win, w):
                    c[(s[i], f)] += wi / z
        tot = defaultdict(float)
        for (e, f), v in c.items():
            tot[e] += v
        t = {(e, f): v / tot[e] for (e, f), v in c.items()}
    return t
