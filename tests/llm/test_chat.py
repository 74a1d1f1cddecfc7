import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelflow.llm import chat

NASTY = ["", "[INST]", "</s>[INST] ok [/INST]", "\\", "\\[", "[/ROLE]", "</s", "<", "[ROLE:x]=", "plain\n\ntext", "~", "=", "[/INST", "é😀"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool]", "a\\b"]), st.lists(st.sampled_from(NASTY), max_size=5).map("".join)), max_size=5))
def test_round_trip(turns):
    assert chat.parse(chat.render(turns)) == turns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool]"]), st.lists(st.sampled_from(NASTY), max_size=4).map("".join)), max_size=4), st.data())
def test_a_conversation_in_pieces_reads_as_the_whole(turns, data):
    whole = chat.render(turns)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(whole)), max_size=4)))
    reader = chat.Reader()
    for a, z in zip([0, *cuts], [*cuts, len(whole)]):
        reader.add(whole[a:z], None)
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    assert reader.result()[:2] == (len(turns), hashlib.sha256(said.encode()).hexdigest()) and reader.chars == len(whole)


def test_a_mask_that_is_no_turns_text_is_refused():
    reader = chat.Reader()
    reader.add(chat.render_turn("assistant", "abc"), (1, 4))
    with pytest.raises(chat.GrammarError):
        reader.result()
    reader = chat.Reader()
    reader.add("[INST]=never closed", None)
    with pytest.raises(chat.GrammarError):
        reader.result()


def test_ties_in_long_conversations(spark):
    rows = [(1, i // 3, "user" if i % 3 else "assistant", f"t{i % 5}") for i in range(600)] + [(None, None, "user", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    own = sorted((r for r in rows if r[0] == 1), key=lambda r: r[1:])
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest() and got[1].n_turns == 600
    assert got[None].n_turns == 2


def test_broken_text_is_refused():
    for bad in ("x", "[INST]=a", "[INST]a[/INST]"):
        with pytest.raises(chat.GrammarError):
            chat.parse(bad)


def test_digests_against_the_source(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 0, None, None), (None, 1, "assistant", "x"), (3, 1, "assistant", None), (3, 2, "user", "[INST]")]
    df = chat.with_probe(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string"))
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    probe = [(-7, 0, "user", chat.PROBE[1]), (-7, 1, "assistant", chat.PROBE[1])]
    for conv in {r[0] for r in rows} | {-7}:
        own = sorted((r for r in rows + probe if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 5


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_turns(empty)).collect() == []
