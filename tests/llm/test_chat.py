import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.chat import BUDGET, escape, op3_chat_formatting, read_turns, unescape, windows

SCHEMA = "conv_id long, turn long, role string, text string, window string, n_repeated int"
TRICKY = ["<|im_end|>", "<%|im_start|>x", "<<|<%%|", "a\nb", "", None, "é日<|", "%3C<%", "\\ $1 <|"]


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for c in range(30):
        n = rng.choice([1, 2, 5, 60, 200])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool\n<x>", None])
            text = rng.choice(TRICKY) if rng.random() < 0.2 else "w" * rng.choice([1, 30, 400, 900, 9000 if c % 7 == 0 else 50])
            out.append((c, t // 2 if c % 5 == 0 else t, role, text, "w", 3))
    out += [(50, 0, "system", "s" * 9000, "w", 1), (50, 1, "user", "u", "w", 1), (50, 2, "assistant", "a" * 3000, "w", 1), (None, None, "user", "x", None, None), (None, 1, "assistant", "y", None, None)]
    rng.shuffle(out)
    return out + out[:3]


def brute(turns):
    by = {}
    for c, t, role, text, *_ in turns:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, own in by.items():
        own.sort()
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        out[c] = (len(own), h("".join(f"{x[2]}\n{x[3]}\n" for x in own)), len(loss), h(loss))
    return out


def test_query_against_brute_force(spark, tables):
    data = rows()
    probe = "<|im_end|><|im_start|>assistant ok"
    want = brute(data + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    got = op3_chat_formatting(spark, tables(conversations=(data, SCHEMA))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("budget,history", [(BUDGET, 256), (200, 50)])
def test_windows_keep_budget_system_and_history(spark, budget, history):
    data = rows(2)
    out = windows(spark.createDataFrame(data, SCHEMA), budget, history, 8)
    out = out.withColumns({"all": read_turns(F.col("formatted"), F.lit(0)), "new": read_turns(F.col("formatted"), F.col("n_repeated"))}).collect()
    cost = lambda t: (len(t.text.encode()) + 3) // 4 + 4
    said = {}
    for r in sorted(out, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.window)):
        before = said.setdefault(r.conv_id, [])
        assert len(r.new) >= 1 and len(r["all"]) == len(r.new) + r.n_repeated
        system = [t for t in before[:1] if t.role == "system"]
        sys_cost = sum(map(cost, system))
        repeated = r["all"][: r.n_repeated]
        assert repeated[: len(system)] == system
        kept = repeated[len(system) :]
        assert kept == (before[len(before) - len(kept) :] if kept else []) and sum(map(cost, kept)) <= history
        room = max(budget - history - sys_cost, budget // 4)
        assert sum(map(cost, r.new)) <= room or len([t for t in r.new if t.role != "system"]) == 1 or r.window == 0
        before += r.new
        targets = [t.text for t in r.new if t.role == "assistant" and t.text]
        assert len(targets) == len(r.loss_spans)


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = [t or "" for t in TRICKY] + ["".join(rng.choice("<%|a\n") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "<|" not in r.e for r in got) and len({r.e for r in got}) == len(set(texts))


def test_empty_table(spark, tables):
    assert windows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.conv_id for r in op3_chat_formatting(spark, tables(conversations=([], SCHEMA))).collect()] == [-1]


def greedy(turns, budget, history):
    """Number of greedy turn-aligned spans of a conversation's turns (role, tokens) in order."""
    head = turns[0][1] if turns[0][0] == "system" else 0
    stride = max(budget - history - head, min(budget // 4, budget - head), 1)
    n = start = 0
    used = None
    for role, cost in turns[1 if head else 0 :]:
        if used is None or used + cost > stride:
            n, used = n + 1, 0
        used += cost
    return max(n, 1)


def test_spans_are_greedy_and_hold_the_budget(spark):
    rng, data = random.Random(4), []
    for c in range(40):
        turns = [("system" if t == 0 and c % 2 else "user", rng.choice([5, 60, 300, 700, 1500])) for t in range(rng.choice([1, 3, 20, 90]))]
        data += [(c, t, role, "x" * (4 * (n - 4))) for t, (role, n) in enumerate(turns)]
    out = windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    cost = lambda x: (len(x) + 3) // 4 + 4
    for c in range(40):
        own = [(role, cost(text)) for k, _, role, text in data if k == c]
        head = own[0][1] if own[0][0] == "system" else 0
        got = [r for r in out if r.conv_id == c]
        assert len(got) == greedy(own, BUDGET, 256)
        for r in got:
            new = r.formatted.count("<|im_start|>") - r.n_repeated - (r.window == 0 and head > 0)
            assert r.n_tokens <= BUDGET or new == 1 and r.n_tokens <= head + max(n for _, n in own)


def test_a_long_conversation_restarts_only_at_stretches(spark):
    rng = random.Random(6)
    own = [("user", rng.choice([8, 90, 200])) for _ in range(4000)]
    frame = spark.createDataFrame([(1, t, role, "x" * (4 * (n - 4))) for t, (role, n) in enumerate(own)], "conv_id long, turn long, role string, text string")
    best, total = greedy(own, BUDGET, 256), sum(n for _, n in own)
    got = windows(frame).count()
    assert best <= got <= best + total // (768 * 64) + 1


@pytest.mark.parametrize("kind,ids", [("string", ["a", "b-1", "", "12"]), ("date", None), ("double", [0.5, -1.25, 3.0, 1e9])])
def test_ids_of_any_type(spark, kind, ids):
    import datetime

    ids = ids or [datetime.date(2024, 1, d) for d in range(1, 5)]
    frame = spark.createDataFrame([(i, t, "user", f"{i} {t}") for i in [*ids, None] for t in range(3)], f"conv_id {kind}, turn long, role string, text string")
    out = windows(frame)
    assert out.schema["conv_id"].dataType == frame.schema["conv_id"].dataType
    assert sorted((str(r.conv_id), r.formatted.count("<|im_start|>")) for r in out.collect()) == sorted((str(i), 3) for i in [*ids, None])


def test_given_token_counts(spark):
    frame = spark.createDataFrame([(1, t, "user", "word", 600 if t else None) for t in range(4)], "conv_id long, turn long, role string, text string, n int")
    out = sorted(windows(frame, tokens_col="n").collect(), key=lambda r: r.window)
    assert [(r.window, r.n_tokens) for r in out] == [(0, 608), (2, 604), (3, 604)]
