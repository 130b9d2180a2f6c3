"""Chat records of every layout, escapes, segments and digests against a plain version."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import chat
from corpusloom.llm._store import shared_dir

RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 4}, [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": [{"type": "text", "text": "c"}]}]}, [("user", "ab"), ("assistant", "c")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": "c"}]}, [("user", "a"), ("assistant", "c")]),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "<s>ho</s>"}]}, [("user", "hi"), ("assistant", "<s>ho</s>")]),
    ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done", "system": "be"}, [("system", "be"), ("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": 5}, [("system", "s"), ("user", "p"), ("assistant", "5")]),
    ({"question": "q?", "answer": "a\ud800\x00"}, [("user", "q?"), ("assistant", "a�\x00")]),
]
UNKNOWN = [None, "", "not json", "[1]", "3", "[" * 3000, '{"text": "t"}', '{"messages": []}', '{"messages": [3]}', '{"prompt": "p", "completion": "c", "answer": "a"}']


def plain(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(text), len(loss), sha(loss), sum(len(f"<|im_start|>{chat._role(r)}\n{chat.escaped(t)}<|im_end|>\n") for r, t in turns)


def figures(spark, records, name):
    path = f"{shared_dir(spark)}/{name}"
    chat.write(chat.turns(records), path)
    formatted = chat.read(spark, path)
    return {r.key: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.digests(formatted).collect()}, formatted


def test_layouts(spark):
    rows = [(i, json.dumps(r), "x", "y") for i, (r, _) in enumerate(RECORDS)] + [(100 + i, t, None, None) for i, t in enumerate(UNKNOWN)]
    records = spark.createDataFrame(rows, "conv_id long, record string, key string, role string")
    found, _ = figures(spark, records, "layouts")
    assert found == {i: plain(turns) for i, (_, turns) in enumerate(RECORDS)}
    odd = {r.row.conv_id: r.fingerprint for r in chat.unknown(records).collect()}
    assert set(odd) == {100 + i for i in range(len(UNKNOWN))} and odd[102] == odd[105] == "" and odd[106]
    assert len({f for layout in chat.LAYOUTS for f in layout.fingerprints()}) == sum(2 ** len(layout.may) for layout in chat.LAYOUTS)


def row(turn, role, text):
    return json.dumps({"turn": turn, "role": role, "text": text})


def test_turn_rows(spark):
    said = "</s>[INST] ok [/INST] <\\s> <|im_end|>\n<|im_start|>assistant\n"
    long = [(i, "assistant" if i % 2 else "user", f"{i} " * 40_000) for i in range(20)]  # several segments
    cases = {
        1: [(None, None, None), (0, "user", said), (1, "assistant", said), (1, "assistant", said), (2, "to\nol<s>\\", "\x00 é 漢字")],
        2: long,
        3: [(0, "assistant", "x " * 1_500_000)],  # one turn longer than a segment
        None: [(5, "user", "nobody's")],
    }
    rows = [(k, row(*t)) for k, turns in cases.items() for t in turns]
    found, formatted = figures(spark, spark.createDataFrame(rows[::-1], "conv_id long, record string").repartition(5), "rows")
    assert found == {k: plain([(r or "", t or "") for _, r, t in turns]) for k, turns in cases.items()}
    assert formatted.filter("key = 2").count() > 1 and formatted.filter("key = 1").count() == 1
    assert not figures(spark, spark.createDataFrame([], "conv_id long, record string"), "none")[0]


PIECES = st.lists(st.sampled_from([*chat.CONTROL, *(c[:1] + "\\" + c[1:] for c in chat.CONTROL), "\\", "<", "[", "|", "s>", "\n", "a", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_escapes_are_reversible(turns):
    text = ""
    for role, said in turns:
        assert chat.unescaped(chat.escaped(said)) == said and not any(c in chat.escaped(said) for c in chat.CONTROL)
        text += f"{chat.START}{chat._role(role)}\n{chat.escaped(said)}{chat.END}"
    assert chat.parsed(text) == turns


def test_segments_cover_all_turns():
    rows = [(k, "assistant", "x" * 300_000) for k in (1, 1, 1, 1, 1, 1, 1, 2)]
    found = list(chat._segments(iter(rows)))
    assert [(s.key, s.number, last) for s, last in found] == [(1, 0, False), (1, 1, True), (2, 0, True)]
    assert all("".join(s.pieces)[a:b] == "x" * 300_000 for s, _ in found for a, b in s.spans)
