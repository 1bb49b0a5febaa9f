"""Windows against the tokenizer: their counted tokens are the true ones, and the budget holds."""

import random

from tokenizers import Tokenizer

from sylva.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["hi", "</s>", "[INST]", "\\", "\n", "  ", "ß", "it's", "12", "<s>", "日本", "a,b", "\t", "-", " end ", "[/INST] x"]


def made(spark, rows):
    return chat.windows(spark.createDataFrame(rows, SCHEMA), queries.tokenizer()).collect()


def conversations():
    rng = random.Random(9)
    rows = []
    for c in range(25):
        for k in range(rng.choice((1, 2, 9, 40))):
            role = "system" if k == 0 and c % 3 else ("user", "assistant", None, "</s>")[rng.choice((0, 0, 1, 1, 2, 3))]
            rows.append((c, k, role, "".join(rng.choice(PIECES) for _ in range(rng.choice((0, 1, 5, 60, 300, 900))))))
    return rows


def test_counted_tokens_are_the_windows_own(spark):
    plain = Tokenizer.from_file(queries.tokenizer())
    found = made(spark, conversations())
    assert len(found) > 60
    for r in found:
        assert len(plain.encode(r.text, add_special_tokens=False).ids) == r.n_tokens, r.text


def test_no_window_with_several_new_turns_is_over_the_budget(spark):
    found = made(spark, conversations())
    assert all(r.n_tokens <= chat.BUDGET for r in found if r.n_turns - r.repeated > 1)
    assert any(r.repeated > 1 for r in found)


def test_windows_are_as_a_plain_loop_makes_them(spark):
    plain = Tokenizer.from_file(queries.tokenizer())
    rows = conversations()
    got = {}
    for r in made(spark, rows):
        got.setdefault(r.conv_id, {})[r.window] = (r.text, r.repeated)
    for c in {r[0] for r in rows}:
        turns = [(role or "", text) for _, _, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        lines = [chat.line(*t)[0] for t in turns]
        size = [len(plain.encode(x, add_special_tokens=False).ids) for x in lines]
        want, at = [], 0
        while at < len(turns):
            system = [0] if at and turns[0][0] == "system" else []
            lead = sum(size[k] for k in system)
            back, total = at, 0
            while back > len(system) and total + size[back - 1] <= min(chat.HISTORY, chat.BUDGET - lead - size[at]):
                back -= 1
                total += size[back]
            end = at + 1
            while end < len(turns) and lead + sum(size[back:end]) + size[end] <= chat.BUDGET:
                end += 1
            shown = [*system, *range(back, end)]
            want.append(("".join(lines[k] for k in shown), len(shown) - (end - at)))
            at = end
        assert [got[c][k] for k in sorted(got[c])] == want


def test_empty_table_and_clashing_columns(spark):
    assert made(spark, []) == []
    df = spark.createDataFrame([(1, 0, "user", "a", "x", 1, "y"), (1, 1, "assistant", "b", None, 2, None)], SCHEMA + ", window string, loss int, n_tokens string")
    got = chat.digests(chat.windows(df, queries.tokenizer())).collect()
    assert [(r.n_turns, r.loss_chars) for r in got] == [(2, 1)]
