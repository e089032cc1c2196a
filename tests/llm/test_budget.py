"""Windows stay within their budget, by a plain loop over each conversation."""

import random

import pytest

from gridproof.llm import chat_windows


def windows_by_rule(turns, budget, history):
    cost = [-(-len(t or "") // 4) + 4 for _, t in turns]
    system = turns[0][0] == "system"
    out, at = [], 0
    while at < len(turns):
        shown, used = [], cost[at]
        headed = system and at > 0 and (cost[0] + used <= budget or used > budget)
        if headed:
            shown, used = [0], used + cost[0]
        if headed or not system or at == 0:
            before = []
            for k in range(at - 1, max(at - 1 - history, -1 + system), -1):
                if used + cost[k] > budget:
                    break
                before, used = [k, *before], used + cost[k]
            shown += before
        end = at + 1
        while end < len(turns) and used + cost[end] <= budget:
            used += cost[end]
            end += 1
        out.append((len(shown), len(shown) + end - at, used, cost[at] > budget, shown + list(range(at, end))))
        at = end
    return out


@pytest.mark.parametrize("history", [0, 2, 3])
def test_windows_keep_to_the_budget(spark, history):
    rng = random.Random(7)
    talks = {k: [("system" if k % 2 and not i else ("user", "assistant")[i % 2], f"{i}" * rng.choice([0, 3, 90, 250, 400, 800 if k < 4 else 90, 1200 if k < 6 else 60])) for i in range(rng.randint(1, 14))] for k in range(30)}
    talks[50] = [("user", "u" * 784), ("assistant", "a" * 784)]  # 200 tokens each
    talks[51] = [("system", "s" * 784), ("user", "u" * 784), ("assistant", "a" * 1400)]
    table = spark.createDataFrame([(k, i, r, t) for k, turns in talks.items() for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat_windows.chat_windows(table, 256, history).collect()
    assert all(w.n_tokens <= 256 or w.oversized and w.n_turns - w.n_context == 1 for w in got)
    assert any(w.oversized for w in got) and sum(not w.oversized for w in got) > 30
    for k, turns in talks.items():
        want = windows_by_rule(turns, 256, history)
        mine = sorted((w for w in got if w.conv_id == k), key=lambda w: w.window)
        assert [(w.n_context, w.n_turns, w.n_tokens, w.oversized) for w in mine] == [x[:4] for x in want]
        assert [w.formatted for w in mine] == ["".join(f"### {turns[i][0]}: {turns[i][1]}</turn>\n" for i in x[4]) for x in want]
        assert "".join(w.formatted[m.start : m.start + m.length] for w in mine for m in w["mask"]) == "".join(t for r, t in turns if r == "assistant")
