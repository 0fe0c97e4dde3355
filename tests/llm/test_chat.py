import hashlib
import json

from hypothesis import given, settings, strategies as st

from vigilflow.llm import chat

TEXTS = st.text(alphabet=st.sampled_from("<|\\>im_startend\n aé🙂%"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_markup_is_reversible(turns):
    text, spans = chat.render([{"role": r, "text": t} for r, t in turns])
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)


def test_odd_records_get_no_turns_and_end_no_job(spark):
    deep = "[" * 900 + "]" * 900
    odd = ['{"messages": ["hi"]}', '{"messages": [null]}', '{"messages[]": 1}', '{"messages[.]": 1}', deep, '{"messages": ' + deep + "}", '{"messages": [[]]}',
           '{"messages": [{"role": "user", "content": "a"}, null]}', '{"a.b": {"c": [1, {}]}}', '{"messages": [{}]}']
    frame = spark.createDataFrame([(t,) for t in odd], "record string")
    got = chat.canonical(frame).collect()
    assert len(got) == len(odd) and all(r["layout"] is None and r["turns"] == [] for r in got)
    paths = [chat.field_paths(v) for v in ({"m": []}, {"m": ["x"]}, {"m": [[]]}, {"m[.]": 1}, {"m[]": 1}, {"m": {"n": 1}}, {"m.n": 1}, {"m": {}}, {"m{}": 1})]
    assert len({frozenset(p) for p in paths}) == len(paths)


def test_layouts_are_found_by_their_paths(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        "shared": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        "prompt": {"prompt": "a", "response": "b"},
        "completion": {"completion": "b", "prompt": "a"},
        "instruction": {"instruction": "a", "input": "x", "output": "b"},
    }
    rows = [(name, json.dumps(r)) for name, r in records.items()]
    rows += [("empty list", '{"messages": []}'), (None, '{"question": "a"}'), (None, "broken"), (None, ""), (None, None), (None, "[1]")]
    frame = spark.createDataFrame(rows, "want string, record string")
    got = chat.canonical(frame).collect()
    assert len(got) == len(rows)
    by = {r["want"]: [tuple(t) for t in r["turns"]] for r in got if r["want"]}
    assert by["messages"] == [("user", "a"), ("assistant", "")]
    assert by["shared"] == by["prompt"] == by["completion"] == [("user", "a"), ("assistant", "b")]
    assert by["instruction"] == [("user", "a\n\nx"), ("assistant", "b")]
    assert by["empty list"] == []
    for row in got:
        assert row["layout"] == {"empty list": "messages"}.get(row["want"], row["want"])
        assert row["layout"] or row["turns"] == []


def test_one_fingerprint_per_tree_of_paths(spark):
    texts = ['{"a": 1, "b": [{"c": "x"}]}', '{"b": [{"c": null}, {"c": 2.5}], "a": "y"}', '{"a": 1, "b": [{"d": "x"}]}']
    frame = chat.canonical(spark.createDataFrame([(t, "x") for t in texts], "record string, layout string"))
    prints = [r["fingerprint"] for r in frame.collect()]
    assert frame.columns == ["record", "fingerprint", "layout", "turns"]
    assert prints[0] == prints[1] != prints[2]


def test_field_paths():
    value = {"a": 1, "b": [{"c": "x"}, {"d": [[2]]}], "e": [], "f": {}, "g.h": None}
    assert chat.field_paths(value) == {"a", "b[].c", "b[].d[][]", "e[.]", "f{}", "g\\.h"}


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "x<|im_end|>" * 2_000_000  # 22 MB
    rows = [
        (1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (1, 5, "assistant", long),
        (2, 0, "assistant", ""), (None, 1, "tool", "t"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.formatted(chat.canonical(chat.as_records(frame)), "conv_id")
    got = {r["conv_id"]: r for r in chat.read_back(chats, "conv_id").collect()}
    whole = "\nfirst\n" + "user\n\n" * 2 + f"assistant\n{long}\n"
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    empty = spark.createDataFrame([], frame.schema)
    assert chat.read_back(chat.formatted(chat.canonical(chat.as_records(empty)), "conv_id"), "conv_id").count() == 0
