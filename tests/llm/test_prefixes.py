"""Every example holds its whole context, and the loss mask tells its reply."""

from cohortspark.llm import chat


def test_examples_hold_whole_contexts(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "ä<b"), (1, 2, "assistant", "x & 😀"), (1, 3, "user", "q"), (1, 4, "assistant", "z"), (1, 5, "user", "end"), (2, 0, "user", "alone")]
    made = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = {(r.conv_id, r.example): r for r in made.collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (2, 0)}
    mark = lambda role, text: f'<turn role="{role}">{text}</turn>\n'
    first = mark("system", "s") + mark("user", "ä&lt;b") + '<turn role="assistant">'
    assert rows[1, 0].context == first and rows[1, 0].target == "x &amp; 😀" and rows[1, 0].n_context == 2
    assert rows[1, 1].context == first + "x &amp; 😀</turn>\n" + mark("user", "q") + '<turn role="assistant">' and rows[1, 1].target == "z"
    assert rows[1, 2].context == rows[1, 1].context + "z</turn>\n" + mark("user", "end") and not rows[1, 2].trainable and rows[1, 2].length == 0
    assert rows[2, 0].context == mark("user", "alone")
    for r in rows.values():
        assert (r.context + r.target)[r.start : r.start + r.length] == r.target and r.start == len(r.context)
