import itertools
import random

import pytest

from seqloom.llm import chat_format as cf


def cheapest(roles):
    """Least cost over all ways to label the turns."""
    best = float("inf")
    for labels in itertools.product(cf.LABELS, repeat=len(roles)):
        cost, state = 0.0, "^"
        for role, label in zip(roles, labels, strict=True):
            cost += cf.RELABEL[role][label] + cf.step(state, label)[0]
            state = label
        best = min(best, cost + cf.ending(state)[0])
    return best


def parsed(rendered):
    turns = []
    for part in rendered.split(cf.CLOSE)[:-1]:
        head, _, text = part.partition("|>\n")
        turns.append((head.removeprefix("<|"), text))
    return turns


ROLES = {"s": "system", "u": " User", "a": "GPT", "?": "narrator"}


@pytest.mark.parametrize("block", [4096, 3, 1])
def test_repairs_are_legal_and_cheapest(spark, block):
    rnd = random.Random(2)
    convs = {i: "".join(rnd.choice("suaua?") for _ in range(rnd.randrange(1, 8))) for i in range(150)}
    rows = [(c, t, ROLES[r], f"t{t}", 1) for c, roles in convs.items() for t, r in enumerate(roles)]
    rnd.shuffle(rows)
    got = {}
    for r in sorted(cf.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int"), block_turns=block).collect(),
                    key=lambda r: (r.conv, r.part)):
        old = got.setdefault(r.conv, [r.cost, "", 0, 0, 0, 0])
        old[1] += r.rendered
        for k, v in enumerate((r.n_turns, r.n_merged, r.n_relabelled, r.n_inserted), 2):
            old[k] += v
    assert set(got) == set(convs)
    for c, (cost, rendered, n, merged, _, inserted) in got.items():
        assert cost == pytest.approx(cheapest(convs[c])), convs[c]
        turns = parsed(rendered)
        names = [name for name, _ in turns]
        body = names[1:] if names[0] == "system" else names
        assert body == ["user", "assistant"] * (len(body) // 2) and body, (convs[c], names)
        said = [x for _, text in turns for x in text.split("\n") if x]
        assert said == [f"t{t}" for t in range(len(convs[c]))] and n == len(convs[c])
        assert len(turns) == n - merged + inserted


def test_blocks_agree(spark):
    rows = [(0, t, "user" if t % 3 else "assistant", f"x{t}") for t in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = [r.rendered for r in cf.format_chats(df).collect()]
    parts = [r.rendered for r in sorted(cf.format_chats(df, block_turns=7).collect(), key=lambda r: r.part)]
    assert parsed("".join(parts)) and len(parts) == 8
    assert cf.format_chats(df).first().cost == cf.format_chats(df, block_turns=7).first().cost
    assert [t for _, t in parsed("".join(parts))] and "".join(whole).count("x49") == 1


def test_nulls_ties_and_markers(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "a <|end|> b"), (1, None, "system", "first"), (None, 1, "user", "no id"), (2, 5, "user", "same"), (2, 5, "user", "same")]
    got = {r.conv: parsed(r.rendered) for r in cf.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[None] == [("user", "no id"), ("assistant", "")]
    assert got[2] == [("user", "same\nsame"), ("assistant", "")]
    assert got[1][0] == ("system", "first") and "a < |end|> b" in "".join(t for _, t in got[1])
