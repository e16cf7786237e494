"""Chat windows: reversible template, digests, masks, budgets, odd rows."""

import hashlib
from collections import defaultdict

import pytest

from subsight.llm import chat as C
from subsight.plans.registry import Query

from ..conftest import SF001, SF01
from ..oracle_check import compare, duck

SCHEMA = "conv_id long, turn long, role string, text string, window string, pos int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def plain(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t is not None, t or 0, r or "", x or ""))
    done = {}
    for c, turns in out.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        done[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(),
                   len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return done


ROWS = [(1, 0, "system", "Be kind."), (1, 1, "user", "</s>[INST] x ~1 ~0 ~"), (1, 2, "assistant", "[/INST]</s><s>~"), (1, 3, "user", None),
        (1, 4, "assistant", ""), (2, None, None, "no role"), (2, 0, "assistant", "w " * 5000), (2, 1, "user", "\U0001F600 <s>"),
        (None, 0, "user", "null conversation"), (3, 0, "we[ird<~role", "t"), (4, 1, "user", "tie b"), (4, 1, "user", "tie a"), (4, 1, "user", "tie a"),
        *((5, i, ("system", "user", "assistant")[i % 2 + 1 if i else 0], f"turn {i} " + "word " * (i * 7 % 90)) for i in range(120)),
        *((6, i, "assistant", "") for i in range(600))]


def test_digests(spark):
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in C.digests(C.read_back(C.windows(frame(spark, ROWS)))).collect()}
    assert got == plain(ROWS)
    empty = frame(spark, ROWS).limit(0)
    assert C.digests(C.read_back(C.windows(empty))).collect() == []


@pytest.mark.parametrize("budget,history", [(64, 2), (64, 0), (200, 3), (10**9, 2)])
def test_windows(spark, budget, history):
    ws, over = defaultdict(list), 0
    for r in C.windows(frame(spark, ROWS), budget, history).collect():
        ws[r["conv_id"]].append(r)
    for conv, rows in ws.items():
        rows.sort(key=lambda r: r["window"])
        mine = sorted((t is not None, t or 0, r or "", x or "") for c, t, r, x in ROWS if c == conv)
        done = 0
        cost = [len(x.split()) + C.TURN_COST for _, _, _, x in mine]
        system = mine[0][2] == "system"
        for r in rows:
            bodies = [p + "</s>" for p in r["text"].split("</s>")[:-1]]
            new = bodies[r["n_repeated"]:]
            assert new
            kept = cost[0] if system else 0
            fresh = sum(cost[max(done, int(system)):done + len(new)])
            # the longest history that fits, besides the system turn
            back = [b for b in range(history + 1) if b <= done - system and kept + fresh + sum(cost[done - b:done]) <= budget]
            assert r["n_repeated"] == max(back, default=0) + (system and done > 0)
            total = kept + fresh + sum(cost[done - max(back, default=0):done])
            assert total <= budget or len(new) - (system and done == 0) == 1  # over it by one long turn alone
            over += total > budget
            if system:
                assert bodies[0].startswith("<s>system[INST]Be kind." if conv == 1 else "<s>system[INST]")
            targets = [b for b in new if b.startswith("<s>assistant[INST]")]
            assert [r["text"][s["start"]:s["start"] + s["length"]] for s in r["loss"]] == [b[18:-11] for b in targets]
            done += len(new)
        assert done == len(mine)
    longest = max(len((x or "").split()) + C.TURN_COST for _, _, _, x in ROWS)
    assert over > 0 if budget < longest else over == 0


def test_windows_of_a_table_keep_to_the_budget(spark):
    t = spark.read.parquet(f"{SF01}/conversations.parquet")
    cost = 0
    for r in C.windows(t).collect():
        bodies = r["text"].split("</s>")[:-1]
        total = sum(len(text_of(b).split()) + C.TURN_COST for b in bodies)
        assert total <= C.BUDGET or len(bodies) - r["n_repeated"] == 1
        cost = max(cost, total)
    assert cost > C.BUDGET / 2


def text_of(body):
    return body.split("[INST]", 1)[1][:-7].replace("~2", "[").replace("~1", "<").replace("~0", "~")


def test_sql(spark):
    q = Query("op10_chat_formatting", C.op10_chat_formatting, C.ORACLE_SQL)
    for sf in (SF001, SF01):
        problems, n = compare(spark, q.name, q, sf, duck(sf))
        assert not problems and n


def test_no_python_in_the_plan(spark):
    plan = C.op10_chat_formatting(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
