import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from filescape.llm import chat

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, example int, last int"


def expected(turns):
    told = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
    loss = "".join(text or "" for _, role, text in turns if role == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(told), len(loss), sha(loss)


def run(spark, rows):
    df = spark.createDataFrame([(*row, 1, 2) for row in rows], CONVERSATIONS)
    return chat.expand_replies(df), {r[0]: tuple(r[1:5]) for r in chat.round_trip(chat.expand_replies(df)).collect()}


def test_examples_and_masks(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b\\<s>"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e"), (2, 0, "user", None)]
    examples, found = run(spark, rows)
    seen = {(r.conv_id, r.example): r for r in examples.collect()}
    assert sorted(seen) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    first = seen[1, 1]
    assert first.formatted == "<s>[INST] user [/INST] a</s><s>[INST] assistant [/INST] b\\\\<\\s></s>"
    assert first.formatted[first.loss_start - 1 :][: first.loss_length] == "b\\\\<\\s>"
    assert (first.n_context, seen[1, 2].n_context, seen[1, 3].n_context) == (1, 3, 5)
    assert not seen[1, 3].has_target and seen[1, 3].loss_length == 0
    assert found[2] == expected([(0, "user", None)])


def test_nulls_ties_and_repeats(spark):
    turns = [(None, None, None), (0, "assistant", "x"), (0, "assistant", "x"), (0, "user", "[/INST] </s>"), (1, "assistant", None)]
    _, found = run(spark, [(None, *turn) for turn in turns])
    assert found == {None: expected(turns)}
    _, empty = run(spark, [])
    assert empty == {}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>", ""]), st.text("<>/s[]INT \\\nä", max_size=14)), min_size=1, max_size=8))
def test_any_text_comes_back(spark, turns):
    numbered = [(i, *turn) for i, turn in enumerate(turns)]
    _, found = run(spark, [(5, *turn) for turn in numbered])
    assert found == {5: expected(numbered)}
