import hashlib

import pytest

from bitext.llm import chat_windows as cw

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        all_, loss = out.setdefault(conv, ([], []))
        all_.append(f"{role or ''}\n{text or ''}\n")
        if role == "assistant":
            loss.append(text or "")
    digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    return {c: (len(a), digest(a), len("".join(b)), digest(b)) for c, (a, b) in out.items()}


@pytest.mark.parametrize("budget,history", [(512, 128), (20, 8), (40, 0)])
def test_round_trip(spark, budget, history):
    odd = ["</s>[INST] ok [/INST]", "a\\", "<\\s>", "[INST]\\\\[/INST]</s>", "", None, "é\n<s><s>", "x " * 50]
    rows = [(1, 0, "system", "be good")]
    rows += [(1, i, "user" if i % 2 else "assistant", odd[i % len(odd)]) for i in range(1, 40)]
    rows += [(2, 0, None, "no role"), (2, 1, "assistant", "twice"), (2, 1, "assistant", "twice"), (None, 0, "user", "no id"),
             (3, 0, "system", None), (-1, 0, "user", odd[0]), (-1, 1, "assistant", odd[0])]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    windows = cw.chat_windows(turns, budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cw.read_back(windows).collect()}
    assert got == brute(rows)
    for w in windows.collect():
        turns_in = cw.read_turns(w.formatted)
        assert w.n_tokens <= budget or len(turns_in) - w.n_repeated == 1
        if w.conv_id == 1:
            assert turns_in[0][:2] == ("system", "be good")


def test_escape_hides_control_strings():
    for s in ("</s>[INST] ok [/INST]", "\\<s>", "<\\s>", "[\\/INST]"):
        e = cw.escape(s)
        assert cw.unescape(e) == s and not any(c in e for c in (cw.BEGIN, cw.END, cw.OPEN, cw.CLOSE))


def test_empty(spark):
    assert cw.chat_windows(spark.createDataFrame([], SCHEMA)).count() == 0
