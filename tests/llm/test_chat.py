import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkprobe.llm import chat

RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"content": None, "role": "gpt"}]}, None, None),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a\n"}]}, "messages", [("user", "q"), ("assistant", "a\n")]),
    ({"turns": [{"role": "human", "text": "q"}]}, "turns", [("user", "q")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from_value", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "response": 5}, "prompt_response", [("user", "p"), ("assistant", "5")]),
    ({"completion": "c", "prompt": None}, "prompt_completion", [("user", ""), ("assistant", "c")]),
    ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "output": "o"}, "instruction_output", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction_input_output", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction_input_output", [("user", "i"), ("user", "n"), ("assistant", "o")]),
    ({"data": {"prompt": "p", "response": "r"}}, "data_prompt", [("user", "p"), ("assistant", "r")]),
    ({"something": "else"}, None, None),
    ({"id": 7, "system": "s", "source": {"a": 1}, "prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"messages": []}, "messages", []),
    ({"messages": 5}, None, None),
]


def test_layouts_are_told_by_their_paths(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS[1:])] + [(98, "no { record"), (99, None)], "k int, record string")
    got = {r.k: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.json_turns(df, "record").collect()}
    assert got == {**{k: (n, t) for k, (_, n, t) in enumerate(RECORDS[1:])}, 98: (None, None), 99: (None, None)}


def test_typed_tables(spark):
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "id long, messages array<struct<role:string,content:string>>")
    assert [tuple(t) for t in chat.table_turns(df, "id").first().turns] == [("user", "q"), ("assistant", "")]
    df = spark.createDataFrame([(1, "p", "r")], "k long, prompt string, response string")
    assert [tuple(t) for t in chat.table_turns(df, "k").first().turns] == [("user", "p"), ("assistant", "r")]


def round_trip(spark, conversations):
    df = spark.createDataFrame(list(enumerate(conversations)), "id long, turns array<struct<role:string,text:string>>")
    out = chat.formatted(df)
    return {r.id: r for r in out.select("id", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("loss")).alias("learned")).collect()}


ODD = ["", "\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "\\b\\l\\h\\\\", ": a: b", "é\U0001f600\r\n\x00<<##", "long " * 50_000]


def test_any_text_comes_back(spark):
    conversations = [[("user", t), ("assistant", t), ("a: b</turn>\n#", t)] for t in ODD] + [[]]
    got = round_trip(spark, conversations)
    for k, c in enumerate(conversations):
        assert [tuple(t) for t in got[k].turns] == c
        assert got[k].learned == [t for r, t in c if r == "assistant"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x:"]), st.text("\\<#/turn>blhc: \né", max_size=12)), max_size=4), min_size=1, max_size=30))
def test_any_conversations(spark, conversations):
    got = round_trip(spark, conversations)
    assert all([tuple(t) for t in got[k].turns] == c for k, c in enumerate(conversations))


def test_rows_by_turn(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "first"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("id", F.lit(2))
    got = {r.id: [tuple(t) for t in r.turns] for r in chat.table_turns(df, "conv_id").collect()}
    assert got == {1: [("", "first"), ("user", ""), ("assistant", "b")], 2: [("user", "x"), ("user", "x")], None: [("user", "n")]}
    assert chat.table_turns(df.limit(0), "conv_id").collect() == []


def test_rows_take_the_way_of_fingerprints(spark, monkeypatch):
    """Without a mapping for their fingerprint, rows make no turns."""
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(t) for t in chat.table_turns(df, "conv_id").first().turns] == [("user", "x")]
    monkeypatch.setattr(chat, "layout_fingerprint", lambda layout: F.lit(1).cast("long"))
    assert chat.table_turns(df, "conv_id").first().turns == []


def test_query_has_the_planted_conversation(spark):
    said = "\\### Assistant: </turn> ok"
    row = chat.op4_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
