"""Chat windows: exact round trip, budgets, masks."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidefeed.llm import chat_format as C
from tidefeed.llm.queries import INJECTED

SCHEMA = "conv_id long, turn long, role string, text string, window int, parts string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 << 70 if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def got(windows):
    return {r["conv_id"]: tuple(r)[1:5] for r in C.digests(windows).collect()}


TEXT = st.lists(st.sampled_from(["<", "|", "\\", "im_end", ">", "\n", "a ", "é", "<|im_start|>", "<|im_end|>\n"]), max_size=12).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", None, ""]), TEXT)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.none(), st.integers(-3, 600)), ROLE, st.one_of(st.none(), TEXT)), max_size=40))
def test_round_trip(spark, rows):
    windows = C.format_windows(frame(spark, rows), budget=20, history_turns=2, history_tokens=12)
    assert got(windows) == expected(rows)
    for w in windows.collect():
        assert w["text"].count(C.START) == w["text"].count(C.END) == len(w["turns"])


def test_windows_of_one_conversation(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, n, "assistant" if n % 2 == 0 else "user", f"w{n} " * 10) for n in range(1, 40)]
    windows = C.format_windows(frame(spark, rows), budget=60, history_turns=2, history_tokens=40).orderBy("window").collect()
    # 7 tokens of the system turn and 15 of each other turn: three new turns fit, or two repeated ones and a new one
    assert len(windows) == 1 + 36 and all(w["text"].startswith(f"{C.START}system\nbe kind{C.END}\n") for w in windows)
    learnt = []
    for w in windows:
        roles = [w["text"][t["at"]:t["at"] + t["chars"]].split("\n")[0][len(C.START):] for t in w["turns"]]
        repeated = [t["repeated"] for t in w["turns"]]
        assert repeated[1:] == sorted(repeated[1:], reverse=True) and sum(repeated) <= 3
        assert sum(r == "assistant" and not old for r, old in zip(roles, repeated)) == len(w["loss"])
        learnt += [w["text"][s["at"]:s["at"] + s["chars"]] for s in w["loss"]]
    assert learnt == [x for _, _, r, x in rows if r == "assistant"]


def laid(turns, budget, history_turns, history_tokens, block):
    """Windows of one conversation turn by turn: places of repeated and of new turns."""
    out, at = [], 0
    system = turns[0][0] == "system"
    while at < len(turns):
        fixed = [0] if system and at else []
        room = max(0, min(history_tokens, budget - turns[at][1] - sum(turns[i][1] for i in fixed)))
        old = []
        while len(old) < history_turns and at - len(old) - 1 >= system and sum(turns[i][1] for i in old) + turns[at - len(old) - 1][1] <= room:
            old.insert(0, at - len(old) - 1)
        new = [at]
        while (at := at + 1) < len(turns) and at % block and sum(turns[i][1] for i in fixed + old + new) + turns[at][1] <= budget:
            new.append(at)
        out.append((fixed + old, new))
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.booleans(), st.integers(0, 3), st.sampled_from([4, 16, 256]))
def test_windows_fit_the_budget(spark, words, system, history, block):
    roles = ["system" if system and not n else "assistant" if n % 2 else "user" for n in range(len(words))]
    rows = [(1, n, role, "w " * size) for n, (role, size) in enumerate(zip(roles, words))]
    turns = [(role, size + C.TEMPLATE_TOKENS) for role, size in zip(roles, words)]
    old, C.BLOCK = C.BLOCK, block
    try:
        windows = C.format_windows(frame(spark, rows), budget=50, history_turns=history, history_tokens=30).orderBy("window").collect()
    finally:
        C.BLOCK = old
    plan = laid(turns, 50, history, 30, block)
    assert [w["window"] for w in windows] == [new[0] + 1 for _, new in plan]
    for w, (again, new) in zip(windows, plan):
        texts = [w["text"][t["at"]:t["at"] + t["chars"]] for t in w["turns"]]
        assert [t["repeated"] for t in w["turns"]] == [True] * len(again) + [False] * len(new)
        assert texts == [f"{C.START}{roles[i]}\n{'w ' * words[i]}{C.END}\n" for i in again + new]
        assert sum(turns[i][1] for i in again + new) <= 50 or len(new) == 1 and again == [0] * (system and new[0] > 0)


def test_turns_far_apart_and_repeated(spark):
    rows = [(5, t, "assistant", "same") for t in (0, 0, 300, 300, 10**12, None)] + [(None, 1, "user", "x"), (6, 1, "user", INJECTED)]
    windows = C.format_windows(frame(spark, rows))
    assert got(windows) == expected(rows)
    assert C.format_windows(frame(spark, rows).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = C.digests(C.format_windows(frame(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_escape_is_reversible(spark):
    rows = [("".join(x),) for x in (["<|"], ["<\\|"], ["<\\\\|a<|"], ["<<||"], ["\\n\n\\s"], ["plain"], [""])]
    df = spark.createDataFrame(rows, "t string")
    out = df.select("t", C.unescape(C.escape(F.col("t"))).alias("a"), C.unescape_role(C.escape_role(F.col("t"))).alias("b"),
                    C.escape(F.col("t")).contains("<|").alias("bad"), C.escape_role(F.col("t")).contains("\n").alias("line"))
    assert all(r["t"] == r["a"] == r["b"] and not r["bad"] and not r["line"] for r in out.collect())
