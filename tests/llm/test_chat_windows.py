"""op5: windows against a plain version; columns with clashing names."""

import random

import regex
from pyspark.sql import functions as F

from wavelake.llm import chat


def tokens(text):
    return len(regex.findall(r"\p{L}{1,4}|\p{N}|[^\s\p{L}\p{N}]", text))


def plain_windows(turns, budget, history, history_tokens, count):
    """Lists of turn numbers, and how many at the start of each are repeated."""
    n = [count(t) + chat.TURN_TOKENS for _, t in turns]
    head = [0] if turns[0][0] == "system" else []
    first, out = len(head), []
    room = budget - sum(n[i] for i in head)
    body = [first] if first < len(turns) else []
    fresh = 0
    for i in range(first + 1, len(turns)):
        if sum(n[k] for k in body) + n[i] > room:
            out.append((head + body, 0 if not out else len(head) + fresh))
            back = []
            for j in range(i - 1, max(first, i - history) - 1, -1):
                if sum(n[j:i]) <= history_tokens and sum(n[j : i + 1]) <= room:
                    back.insert(0, j)
                else:
                    break
            body, fresh = [*back, i], len(back)
        else:
            body.append(i)
    out.append((head + body, 0 if not out else len(head) + fresh))
    return out


def written(turns, mine, fixed):
    esc = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>")
    text, mask = "", []
    for k, i in enumerate(mine):
        role, said = turns[i]
        text += f"<|{esc(role)}|>"
        if role == "assistant" and k >= fixed:
            mask.append((len(text), len(text) + len(esc(said))))
        text += esc(said) + "<|end|>\n"
    return text, mask


def test_windows(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "internationally", "x" * 60, "42", "<|end|>", "\\", "Grüße", "a-b"])
    talks = {c: [("system", " ".join(word() for _ in range(rng.randrange(9))))] * (c % 3 == 0) + [(("user", "assistant", "tool")[rng.randrange(3)], " ".join(word() for _ in range(rng.choice([0, 3, 9, 40])))) for _ in range(rng.randrange(1, 25))] for c in range(60)}
    rows = [(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for budget, history, most, own in ((120, 2, 40, tokens), (60, 4, 200, tokens), (10_000, 2, 40, tokens), (150, 3, 90, len)):
        column = None if own is tokens else F.char_length("text")
        got = {(r.conv_id, r.window): (r.formatted, [tuple(m) for m in r["mask"]], r.n_repeated) for r in chat.windows(table, budget, history, most, column).collect()}
        want = {}
        for c, turns in talks.items():
            for k, (mine, fixed) in enumerate(plain_windows(turns, budget, history, most, own)):
                want[c, k] = (*written(turns, mine, fixed), fixed)
        assert got == want


def test_clashing_columns(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id bigint, turn bigint, role string, text string")
    more = table.withColumns({c: F.lit("z") for c in ("n", "p", "i", "t", "s0", "room", "cuts", "window", "mask", "formatted", "parts")})
    assert chat.chat_report(more).collect() == chat.chat_report(table).collect()
