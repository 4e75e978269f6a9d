import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import chat_format as cf

TEXT = st.text(alphabet=st.sampled_from(list("<|\\>im_endstar é\n")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_escape_is_reversible_and_hides_controls(text):
    assert cf.unescape(cf.escape(text)) == text
    assert "<|" not in cf.escape(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|x"]), TEXT), max_size=6))
def test_render_reads_back(turns):
    text, segments, _ = cf.render(turns, cf.Template())
    back, loss = cf.read_back(text, segments)
    assert back == turns and loss == "".join(t for r, t in turns if r == "assistant")
    assert text.count("<|im_end|>") == len(turns)
    assert cf.parse(text, cf.Template()) == turns


def test_machine():
    why = lambda *roles: cf.render([(r, "") for r in roles], cf.Template())[2]
    assert why("system", "user", "assistant") == ""
    assert why("user", "assistant", "user", "assistant") == ""
    assert "turn 1" in why("user", "user") and "turn 0" in why("assistant") and why("user") == "ends in user" and why() == "ends in start"


def test_edges(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, None, None, "z", 0), (None, 0, "user", "n", 0), (2, 0, "user", "same", 0), (2, 0, "user", "same", 0), (3, 0, "user", "é" * 200_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in cf.format_conversations(df).collect()}
    assert got[1].formatted == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>\nz<|im_end|>\n"
    assert got[2].formatted.count("same") == 2 and len(got[3].formatted) > 200_000 and got[None].formatted
    assert [got[1].formatted[s.start : s.end] for s in got[1].segments if s.loss] == ["b"]
    assert cf.format_conversations(df.limit(0)).count() == 0


def test_only_text_of_the_template_is_parsed():
    text, _, _ = cf.render([("user", cf.HOSTILE)], cf.Template())
    for bad in (text[:-1], "x" + text, text + "<|im_start|>"):
        with pytest.raises(ValueError):
            cf.parse(bad, cf.Template())


def test_turns_of_a_long_conversation_leave_one_by_one(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(5000)] + [(8, 0, "user", "x")]
    out = cf.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    own = [r for r in out if r.conv_id == 7]
    assert [r.turn_no for r in own] == list(range(5000)) and [r.last for r in own].count(True) == 1 and own[-1].last and own[-1].order_error == ""
    assert own[4999].segments[0].start == sum(len(r.formatted) for r in own[:4999])
    assert [r.order_error for r in out if r.conv_id == 8] == ["ends in user"]
