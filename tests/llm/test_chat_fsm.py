import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import _store
from lodestar.llm.chat_fsm import Machine, Template, chat_digests, formatted_turns, with_probe

TEXT = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "[INST]", "</s>", "<<SYS>>", "<", "[", "\\", "\n", "user", "a", "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
@settings(max_examples=400, deadline=None)
def test_reading_back_is_exact(turns):
    t = Template()
    formatted = "".join(s for role, text in turns for s, _ in t.segments(role, text))
    assert t.read(formatted) == turns
    assert formatted.count(t.open) == formatted.count(t.close) == len(turns)


@pytest.mark.parametrize(("roles", "problem"), [
    (["system", "user", "assistant"], None), (["user", "assistant", "user"], None), (["assistant"], "turn 0: assistant after the start"), (["user", "user"], "turn 1: user after user"), (["system"], "ends after system"), (["user", "tool"], "turn 1: tool after user"), ([""], "turn 0: no role after the start"),
])
def test_machine(roles, problem):
    m = Machine(Template())
    for r in roles:
        m.step(r)
    assert m.end() == problem


def test_digests(spark):
    _store.ship(spark)
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "[INST] ok"), (1, 2, "user", None), (1, 3, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_digests(with_probe(df)).collect()}
    want = [(r, t or "") for _, _, r, t in sorted(rows, key=lambda x: x[1])]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (9, hashlib.sha256("yes </s>é".encode()).hexdigest())
    assert got[-1].n_turns == 2 and got[-1].problem is None
    told = formatted_turns(df).orderBy("position").collect()
    assert [s.text for s in told[1].segments if s.loss] == ["yes <\\/s>"]
    assert got[1].formatted_chars == sum(len(s.text) for t in told for s in t.segments)
