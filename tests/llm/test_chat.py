"""Snapshot collapse against brute force."""

import random

import __spark_entry__ as entry
import check
from assayer.llm import chat


def brute(rows):
    conv = {}
    for c, turn, role, text in set(rows):
        conv.setdefault(c, []).append((turn, role, text))
    return conv


def test_random_prefixes(spark):
    rnd, rows, want = random.Random(2), [], {}
    talks = [[(("user", "assistant", None)[k % 3], rnd.choice(["a", "b", "", None])) for k in range(rnd.randint(1, 6))]
             for _ in range(12)]
    cid = 0
    for t in talks:
        for k in rnd.sample(range(1, len(t) + 1), min(3, len(t))):
            for i, (role, text) in enumerate(t[:k]):
                rows.append((cid, i * 300, role, text))
            want[cid] = t[:k]
            cid += 1
    rows += rnd.sample(rows, 10)  # repeated rows
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.render(df).collect()}
    whole = {}
    for c, t in want.items():
        whole.setdefault(tuple(t), []).append(c)
    keep = {min(cs): (t, len(cs)) for t, cs in whole.items()
            if not any(len(o) > len(t) and o[:len(t)] == t for o in whole)}
    assert set(got) == set(keep)
    for c, (t, copies) in keep.items():
        assert got[c].copies == copies and got[c].n_turns == len(t)
        assert got[c].text == "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in t)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (None, None, "system", "s"), (1, 0, "user", "x"), (1, 1, "assistant", "y" * 200_000),
            (2, 0, "user", "x"), (3, 5, "user", None), (4, 5, "user", ""), (5, 0, "user", "b"), (5, 0, "user", "a"),
            (6, None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(got) == {None, 1, 3, 4, 5, 6}
    assert got[None].text.startswith("<|im_start|>system") and got[5].n_turns == 2
    parts = chat.render(df, part_turns=1).collect()
    assert sorted(r.part for r in parts if r.conv_id == 5) == [0, 1] and len(parts) == 9
    assert chat.render(df.limit(0)).count() == 0


def test_long_conversation_over_blocks(spark):
    rows = [(1, i, "user", str(i)) for i in range(700)] + [(2, i, "user", str(i)) for i in range(600)] + [
        (3, i, "user", str(i)) for i in range(599)] + [(3, 599, "user", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat.render(df).collect()} == {1: 700, 3: 600}


def test_query(spark, data):
    assert check.compare(spark, check.connect(data), data, "op1_chat_snapshots",
                         entry.oracle_sql()["op1_chat_snapshots"]).startswith("ok")


def test_main_path_is_native(spark, data):
    plan = entry.queries()["op1_chat_snapshots"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
