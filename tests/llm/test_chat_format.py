import hashlib

from hypothesis import given
from hypothesis import strategies as st

from pitlake.llm import chat_format as chat

ROWS = [
    (1, 0, "system", "be <kind> \\ #"), (1, 1, "user", "hi"), (1, 2, "assistant", "### user ###\nno</turn>\n"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"),
    (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"), (None, 1, "user", "x"), (None, 2, "assistant", "é漢"), (4, None, None, "y\\"), (4, 1, "assistant", "\\###"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        replies = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        sizes = [len(chat.opened(r)) + len(chat.closed(t)) for *_, r, t in turns]
        chars = sum(sum(sizes[:i + 1]) for i, t in enumerate(turns) if t[2] == "assistant" or i == len(turns) - 1)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest(), chars))
    return sorted(out, key=str)


def test_read_back_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = chat.read_back(chat.expand(df)).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_examples_hold_their_context_and_one_span(spark):
    got = {(r.conv_id, r.example): r for r in chat.expand(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    one = got[1, 1]
    assert chat.turns_of(one.text) == [("system", "be <kind> \\ #"), ("user", "hi"), ("assistant", "### user ###\nno</turn>\n"), ("user", ""), ("assistant", "")]
    assert chat.unescape(got[1, 0].text[got[1, 0].loss_start:got[1, 0].loss_end]) == "### user ###\nno</turn>\n"
    assert got[1, 2].loss_start is None and got[2, 0].loss_start is None and len(got) == 3 + 1 + 2 + 1 + 1


def test_long_conversation(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7)) for i in range(300)]
    assert list(map(tuple, chat.read_back(chat.expand(spark.createDataFrame(rows, SCHEMA))).collect())) == brute(rows)


@given(st.lists(st.tuples(st.text(alphabet="\\#<>/turn \nabé", max_size=8), st.text(alphabet="\\#<>/turn \nabé", max_size=20)), max_size=5))
def test_template_is_reversible(turns):
    assert chat.turns_of("".join(chat.opened(r) + chat.closed(t) for r, t in turns)) == turns


def test_empty(spark):
    assert chat.read_back(chat.expand(spark.createDataFrame([], SCHEMA))).count() == 0
